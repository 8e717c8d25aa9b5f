import html
import re
import time

from pyspark.sql import functions as F

from newsflow.llm import page_text
from newsflow.llm.page_text import read_page
from newsflow.llm.queries import op13_page_text

ARTICLE = """<header><h1>Big
 title</h1></header><p>First&nbsp;para <a href="x>y">link</a> more text that is long enough.<p>Second <br>line &lt;b&gt; &copy 2020<ul><li>one<li>two</ul>
<div class="ad-slot">Buy</div><table><tr><td>a<td>b<tr><td>c</table><blockquote><p>Quoted</blockquote><form><input><p>Subscribe</form><aside>See also</aside>
<ul class="x"><li><a href=1>r1</a><li><a href=2>r2</a><li><a href=3>r3</a></ul>"""
TEXT = "Big title\nFirst para link more text that is long enough.\nSecond line <b> © 2020\none\ntwo\na b\nc\nQuoted"
COMMENT = "I agree, and this comment is much longer than the article itself, really. " * 20
AROUND = """<html><head><title>T &amp; x</title><script>if(a<b){"</p>"}</script><style>p{}</style></head><body class="has-sidebar"><div id="header">Site name</div>
<nav><ul><li><a href=1>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="layout with-sidebar">@<div class="sidebar">Side</div></div>
<footer>foot</footer><!-- x <p>no</p>"""


def page(inside, comments=True):
    tail = f'<section id="comments"><article class="comment">{COMMENT}</article></section>' if comments else ""
    return AROUND.replace("@", inside + tail)


def test_what_is_left_out():
    assert read_page(page(f'<main><article class="post-12 comment-open">{ARTICLE}</article></main>')).text({}) == TEXT
    assert read_page(page(f'<div class="entry">{ARTICLE}</div>')).text({}) == TEXT.replace("Big title\n", "")  # a header outside an article
    assert read_page(page(f'<form action="/"><main>{ARTICLE}</main></form>', False)).text({}) == TEXT


def test_odd_pages():
    text = lambda x: read_page(x).text({})
    assert text(None) == text("") == text("<p></p>") == text("<!-- <p>a</p>") == text("<script>a") == ""
    assert text("plain a < b & c &amp; d\n\n e") == "plain a < b & c & d e"
    assert text('<p>x</p><p title="unclosed>rest</p>') == "x\nrest"
    assert text("<p>cut off <b>in a tag</b> <a href='x") == "cut off in a tag"
    assert text('<div class="sidebar">all there is</div>') == "all there is"
    assert text("<P>A</P><DIV>b<BR/>c</DIV>tail") == "A\nb c\ntail"
    began = time.time()
    deep = read_page("<div>" * 20_000 + "x" + "<p>y" * 20_000).text({})
    assert deep.count("y") == 20_000 and time.time() - began < 10


def test_hosts_vote(spark):
    # on the host's short pages a box of its template outweighs the article; the host's other pages say which path is right
    story = lambda n: '<div class="story s%d">' % n + "<p>long story text</p>" * 20 + "</div>"
    box = '<div class="box">' + "A box that the template repeats. " * 5 + "</div>"
    rows = [(i, f"https://A.example.org/{i}", box + story(i), "x") for i in range(20)]
    rows += [(100, "http://a.example.org/short", box + '<div class="story s9"><p>Short.</p></div>', "x"), (101, "http://b.example.org/", box + "<div class=s><p>Short.</p></div>", "x")]
    rows += [(102, None, None, "x"), (None, "no url", "<p>some text", "x"), (103, "http://a.example.org/other", "<section><p>Other template.</section>", "x"), (0, "https://A.example.org/0", box + story(0), "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").withColumn("host", F.lit(1)).withColumn("paths", F.lit(2))
    got = page_text.extract_pages(df.repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[i] == "\n".join(["long story text"] * 20) for i in range(20)) and texts[100] == "Short."
    assert texts[101].startswith("A box") and texts[102] == "" and texts[None] == "some text" and texts[103] == "Other template."
    assert page_text.extract_pages(df.limit(0)).count() == 0
    won = {r["host"]: r for r in page_text.winning_paths(df).collect()}
    assert won["a.example.org"]["n"] == 23 and [tuple(p) for p in won["a.example.org"]["paths"]] == [("div.#.story", 21)]


def test_the_query_by_the_tables_form(spark):
    got = {r["page_id"]: r for r in op13_page_text(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search("(?s)<article>(.*)</article>", p["html"])[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:h1|p)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want) and got[p["page_id"]]["url"] == p["url"]
