import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.functions.matching import best_sector, matched, sector_scores


def one(spark, column, **row):
    names = list(row)
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'int'}" for n, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema or "x int").select(column(*[F.col(n) for n in names]).alias("y")).first()["y"]


@pytest.mark.parametrize(("url", "want"), [
    ("https://WWW.Example.com/a/b/?utm_source=x&id=7#top", "https://example.com/a/b?id=7"),
    ("http://x.example.com/fr/825?page=2&ref=x", "http://x.example.com/fr/825?page=2"),
    ("https://x.example.com/", "https://x.example.com/"),
    ("https://x.example.com/a?UTM_Source=1", "https://x.example.com/a"),
    ("https://x.example.com/a?q=a b&e=", "https://x.example.com/a?q=a+b&e="),
    ("https://www.www.example.com/a", "https://www.example.com/a"),
    ("https://x.example.com/a?q=%zz~*", "https://x.example.com/a?q=%25zz~%2A"),
    ("", ""),
])
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical, url=url) == want


def test_canonical_url_special_hosts(spark):
    keep = lambda u: U.canonical(u, ("app.example.com",), {"d.example.com": r"^(/a/RA\d+)(?:/.*)?$"})
    assert one(spark, keep, url="https://app.example.com/x#news/1") == "https://app.example.com/x#news/1"
    assert one(spark, keep, url="https://d.example.com/a/RA25/some-slug") == "https://d.example.com/a/RA25"


@pytest.mark.parametrize(("text", "words", "want"), [
    ("CSN Cimentos compra; csn e AÇO PLANO", ["CSN", "CSN Cimentos", "aço plano", "aco plano"], ["CSN Cimentos", "CSN", "aço plano"]),
    ("steelmaking e steel", ["steel", "steelmaking"], ["steelmaking", "steel"]),
    ("Vale S.A. lucra", ["Vale S.A."], []),
    ("oversteel", ["steel"], []),
    ("", ["steel"], []),
    (None, ["steel"], []),
    ("x", [], []),
])
def test_keywords(spark, text, words, want):
    assert one(spark, lambda t: matched(t, words), text=text) == want


@pytest.mark.parametrize(("text", "want"), [("aaaa bbbb, cccc", "aaaa bbbb..."), ("aaaaaaaaaaaa bb", "aaaaaaaaaaa..."), ("a bbbbbbbbbbbbb", "a bbbbbbbbb..."), ("short", "short"), ("", "")])
def test_truncate(spark, text, want):
    assert one(spark, lambda t: X.truncate(t, 11), text=text) == want


def test_titles(spark):
    names = ["Daily", "Example News"]
    assert one(spark, lambda t: X.clean_title(t, names), t="Steel up | Daily - Example News") == "Steel up"
    assert one(spark, lambda t: X.clean_title(t, names), t="Daily") == "Daily"
    assert one(spark, lambda t: X.clean_title(t, names), t="| Daily") == "| Daily"
    assert one(spark, U.slug_title, u="https://x.example.com/a/projeto-cine-%C3%A1rea/") == "Projeto cine área"


def test_paywall(spark):
    check = lambda ps: X.looks_paywalled(ps, "subscribe")
    assert one(spark, check, ps=["a" * 300] * 2) is True
    assert one(spark, check, ps=["a" * 100] * 3) is True
    assert one(spark, check, ps=["a" * 200] * 3) is False
    assert one(spark, check, ps=["a" * 200] * 3 + ["Subscribe now"]) is True


def test_related_and_footer(spark):
    assert one(spark, X.cut_related, t="corpo Leia também: outra") == "corpo "
    assert one(spark, X.strip_footer, t="Texto. O post X apareceu primeiro em Y.") == "Texto."
    assert one(spark, X.strip_footer, t='Texto. O post <a href="https://x.y">X</a> apareceu primeiro em <a href="u">Y</a>.') == "Texto."


def test_times(spark):
    utc = lambda *a: dt.datetime(*a)
    assert one(spark, X.parse_time, t="2024-01-30T10:00:00Z") == utc(2024, 1, 30, 10)
    assert one(spark, X.parse_time, t="2024-01-30T10:00:00-03:00") == utc(2024, 1, 30, 13)
    assert one(spark, X.parse_time, t="Tue, 30 Jan 2024 10:00:00 +0000") == utc(2024, 1, 30, 10)
    assert one(spark, X.parse_time, t="0001-01-01T00:00:00Z") is None
    assert one(spark, X.parse_time, t="soon") is None
    assert one(spark, lambda t: X.date_header(X.parse_time(t), "pt"), t="2024-03-05T00:00:00Z") == "5 de março de 2024"


def test_sectors(spark):
    sectors = {"cement": ["cement"], "paper": ["pulp"], "steel": ["steel"]}
    pick = lambda t: best_sector(sector_scores(t, F.array().cast("array<string>"), sectors), "steel")
    assert [one(spark, pick, t=t) for t in ("nothing", "pulp and cement", "pulp, pulp")] == ["steel", "cement", "paper"]


PAGE = """<html><head><title>T &amp; U</title></head><body><nav><p>menu</p></nav><div class="share">x</div><article><h1>Head</h1>
<p>One <b>bold</b> <a href="/x">link</a><p>Two<br>lines</p><ul><li>a<li>b</ul><blockquote>q</blockquote>
<img src="//i.example.com/1.png" alt="A"><img src="http://no.example.com/2.png"><figure><img src="https://i.example.com/3.png"><figcaption>cap</figcaption></figure>
<p><a href="/only">only a link</a></p><script>var t="</p>";</script></article></body></html>"""


def test_sanitize_and_blocks(spark):
    row = spark.createDataFrame([(PAGE,), (None,), ("",)], "html string").select(H.sanitize("html").alias("s"), "html").select("s", H.blocks("s").alias("b")).collect()
    assert row[0]["s"].split("\n") == ["<h3>Head</h3>", "<p>One <strong>bold</strong> link</p>", "<p>Two<br>lines</p>", "<ul><li>a</li><li>b</li></ul>", "<blockquote><p>q</p></blockquote>", '<img src="https://i.example.com/1.png" alt="A" class="reader-img">', '<img src="https://i.example.com/3.png" alt="" class="reader-img">', '<p class="reader-caption"><em>cap</em></p>', "<p>only a link</p>"]
    assert [b["type"] for b in row[0]["b"]] == ["h3", "text", "text", "list_item", "list_item", "blockquote", "image", "image", "text"]
    assert row[1]["s"] is None and row[2]["s"] == ""


def test_blocks(spark):
    html = "<h2>Section</h2><div>one <img src='x.png'>block</div><strong>bold text</strong><p>abc</p><h6>small</h6><ul><li>a</li><li><ul><li>in</li></ul></li></ul><img src='data:image/gif;x'>loose text"
    got = spark.createDataFrame([(html,)], "h string").select(H.blocks("h").alias("b")).first()["b"]
    assert [(b["type"], b["text"] or b["src"], b["bold"]) for b in got] == [("h3", "Section", False), ("image", "x.png", None), ("text", "one block", False), ("text", "bold text", True), ("h4", "small", False), ("list_item", "a", False), ("list_item", "in", False), ("text", "loose text", False)]


def test_labels(spark):
    at = lambda h: spark.range(1).select(X.window_label(F.lit(h)).alias("y")).first()["y"]
    assert [at(h) for h in (6, 24, 48, 72, 168)] == ["6h", "24h (1d)", "48h (2d)", "72h (3d)", "7d"]


def test_container(spark):
    page = '<div class="post"><div class="content"><p>Body text</p><div class="more"><p>noise</p></div><p>More news today</p><p>gone</p></div></div>'
    rules = {"m.example.com": {"selectors": ["div.post .content"], "remove": ["div.more"], "stop": r"\s*more\s+news\b"}}
    df = spark.createDataFrame([(page, "m.example.com"), (PAGE, "other"), ("<p>none</p>", "other")], "html string, d string")
    got = [r[0] for r in df.select(H.extract_container(F.col("html"), F.col("d"), rules)).collect()]
    assert got[0] == "<p>Body text</p>" and got[1].startswith("<h3>Head</h3>") and got[2] == ""
    assert df.limit(2).select(H.container_paragraphs("html").alias("p")).collect()[1]["p"] == ["One bold link", "Two lines"]


def test_metadata(spark):
    get = lambda c: spark.createDataFrame([(h,) for h in pages], "html string").select(c.alias("y")).collect()
    pages = ['<meta content="D&amp;C" property="og:description"><meta name="description" content="x">', '<meta name="description" content="x">', "<p>no</p>"]
    assert [r["y"] for r in get(H.page_description(F.col("html")))] == ["D&C", "x", ""]
    pages = ['<title>a</title><meta property="og:title" content="O">', "<title> a &lt; b </title>", ""]
    assert [r["y"] for r in get(H.page_title(F.col("html")))] == ["O", "a < b", ""]


def test_dom_items(spark):
    items = '[{"t":"p","v":" a<b "},{"t":"ol","lis":["x"," ","y"]},{"t":"img","src":"http://n"},{"t":"h4","v":""},{"t":"?","v":"z"}]'
    assert one(spark, lambda j: H.dom_items_to_html(F.from_json(j, schemas.DOM_ITEMS)), j=items) == "<p>a&lt;b</p>\n<ol><li>x</li><li>y</li></ol>"
    assert one(spark, lambda j: H.dom_items_to_html(F.from_json(j, schemas.DOM_ITEMS)), j="not json") == ""


def test_plain_text_to_html(spark):
    assert one(spark, H.text_to_html, t="first line\nsecond line\n\n\n\nnext block") == "<p>first line second line</p>\n<p>next block</p>"
    assert one(spark, H.text_to_html, t="first line\ntiny\nsecond line") == "<p>first line</p>\n<p>second line</p>"
    assert one(spark, H.text_to_html, t="  ") == ""
    assert one(spark, X.split_glued_sentences, t="the offers.Platts assessed U.S. steel") == "the offers.\nPlatts assessed U.S. steel"


def test_all_character_references_as_the_standard_has_them(spark):
    import html
    import random
    from html.entities import html5

    from newsflow.functions import text as X

    rng, names = random.Random(1), sorted(html5)
    parts = lambda: rng.choice(["&" + rng.choice(names), f"&#{rng.randrange(0x120000)};", f"&#x{rng.randrange(0x3000):X}", " a ", "&", ";", "amp;"])
    texts = ["a&ccedil;o plano &#8217;x&#8217;", "&amp;lt; &lt;", "&notit; &copy2020 &nada; & &#; &#xD800; &#0; &#128; &#x81; &#99999999999999999999; &#x0000000041;", ""] + ["".join(parts() for _ in range(8)) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.unescape(F.col("t"))).collect()
    assert [t for _, t in sorted(got)] == [html.unescape(t) for t in texts]


def test_sanitized_pages_end_where_other_articles_begin(spark):
    from newsflow.functions import html as H

    page = "<p>Body text</p><h3>Related articles</h3><p>Other story</p>"
    inside = f"<html><article>{page}</article></html>"
    df = spark.createDataFrame([(page, inside, "d")], "page string, inside string, d string")
    got = df.select(H.sanitize(F.col("page")), H.extract_container(F.col("inside"), F.col("d"), {})).first()
    assert list(got) == ["<p>Body text</p>"] * 2
    mixed = "<div>short<figure><img src='//x/y.png' alt='a&amp;b'><figcaption>Cap</figcaption></figure>loose text, long enough<ul><li>one</li><li></li></ul><h2>T</h2><p>a <b> bold </b><br><nav>no</nav></p><blockquote>q</blockquote></div>"
    got = spark.createDataFrame([(mixed,)], "page string").select(H.sanitize(F.col("page"))).first()[0].split("\n")
    assert got == ['<img src="https://x/y.png" alt="a&amp;b" class="reader-img">', '<p class="reader-caption"><em>Cap</em></p>', "<p>loose text, long enough</p>", "<ul><li>one</li></ul>", "<h3>T</h3>", "<p>a <strong>bold</strong><br></p>", "<blockquote><p>q</p></blockquote>"]


def test_pasted_paragraphs_are_trimmed_of_blanks_alone(spark):
    rows = [("  1 a 0 \n \n 1 b 1  \n\n\n2 c",), ("0 one \n 1 two ",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(X.split_body(F.col("t"))).collect()]
    assert got == [["1 a 0", "1 b 1", "2 c"], ["0 one", "1 two"], None]


def test_page_facts_are_those_of_the_single_functions(spark):
    pages = ['<title> a &lt; b&nbsp;</title><meta name="date" content="2024-01-02T03:04:05Z"><p>x &amp; <b>y</b></p><script><p>no</p></script><p> </p>', "", None, '<meta property="og:title" content="O &Aacute;&NotEqualTilde;"><time datetime="2024-05-06">']
    h = F.col("h")
    df = spark.createDataFrame([(p,) for p in pages], "h string")
    one = df.select(H.page_facts(h).alias("f")).select("f.*").collect()
    apart = df.select(H.page_title(h), H.page_description(h), H.page_published(h), F.coalesce(H.paragraph_texts(h, -1), F.array().cast("array<string>"))).collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in apart] and one[3]["title"] == "O Á≂̸"


def test_repeats_are_found_in_an_array_computed_once(spark):
    df = spark.createDataFrame([("a a b a  a",), ("",), (None,)], "t string")
    got = df.select(X.distinct_from_previous(F.split("t", " ")).alias("y"))
    assert [r["y"] for r in got.collect()] == [["a", "b", "a", "", "a"], [""], None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_paragraphs_are_cleaned_once(spark):
    df = spark.createDataFrame([("a  b .\na b.\n\nCopyright\nc",)], "t string")
    got = df.select(X.clean_paragraphs(F.split("t", "\n"), ["^copyright"]).alias("y"))
    assert got.first()["y"] == ["a b.", "c"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_replace(") == 2


def test_reference_to_the_byte_order_mark(spark):
    assert one(spark, X.unescape, t="a&#65279;b&#xFEFF;&#x1F600;&#65534;") == "a﻿b﻿\U0001f600"


def test_a_worker_holds_few_pages_at_once(spark):
    pages = [None if i % 7 == 0 else f"<body><p>page {i}</p><ul><li>a</li></ul></body>" for i in range(1000)]
    for udf, own in ((H.container_paragraphs, lambda x: x[0]), (H.dom_walk, lambda x: x[0]["v"]), (H.blocks, lambda x: x[0]["text"])):
        parts = list(udf.func(iter([pa.array(pages), pa.array([], pa.string())])))
        assert max(map(len, parts)) <= H.PAGES_AT_ONCE
        whole = [x for p in parts for x in p.to_pylist()]
        assert [None if x is None else own(x) for x in whole] == [None if i % 7 == 0 else f"page {i}" for i in range(1000)]
        got = spark.createDataFrame(list(enumerate(pages)), "i int, h string").coalesce(1).select("i", udf("h").alias("x")).orderBy("i").collect()
        assert [None if r.x is None else own(r.x) for r in got] == [None if x is None else own(x) for x in whole]


def test_images_of_a_page_are_numbered_in_order():
    pages = ["<body>" + "".join(f"<p>text {i}</p><img src='{i}.png'>" for i in range(n)) + "</body>" for n in (0, 3, 700)]
    got = [x for p in H.dom_walk.func(iter([pa.array(pages)])) for x in p.to_pylist()]
    for items, n in zip(got, (0, 3, 700), strict=True):
        assert [(x["idx"], x["src"]) for x in items if x["t"] == "img"] == [(i, f"{i}.png") for i in range(n)]
