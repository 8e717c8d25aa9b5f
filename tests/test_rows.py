import datetime as dt
import random

from pyspark.sql import functions as F

from newsflow.operators import dedupe, lookup, store
from newsflow.plans import scan

T0 = dt.datetime(2024, 1, 1)
WRITES = "url string, seq bigint, domain string, source_name string, title string, snippet string, published_at timestamp, found_at timestamp, matched_keywords array<string>, body string"


def replay(writes):
    """What row-at-a-time upserts leave."""
    rows = {}
    for w in sorted(writes, key=lambda w: w[1]):
        url, _, domain, name, title, snippet, published, found, words, body = w
        old = rows.get(url)
        if old is None:
            rows[url] = [domain, name, title, snippet, published, found, words, body]
            continue
        old[2:4] = [title, snippet]
        old[4] = published or old[4]
        old[6] = words
        if len(body or "") > len(old[7] or ""):
            old[7] = body
    return rows


def random_writes(rng, n):
    return [(f"u{rng.randrange(6)}", i + 1, f"d{i}", f"n{i}", f"t{i}", f"s{i}", rng.choice([None, T0 + dt.timedelta(hours=i)]), T0 + dt.timedelta(minutes=i), [f"k{i}"], rng.choice("abc") * rng.randrange(4)) for i in range(n)]


def rows_of(df):
    return {r["url"]: [r["domain"], r["source_name"], r["title"], r["snippet"], r["published_at"], r["found_at"], r["matched_keywords"], r["body"]] for r in df.collect()}


def test_upserts_equal_a_replay(spark):
    rng = random.Random(1)
    for _ in range(6):
        writes = random_writes(rng, rng.randrange(1, 40))
        assert rows_of(store.fold_upserts(spark.createDataFrame(writes, WRITES))) == replay(writes)
        cut = rng.randrange(len(writes) + 1)
        stored = store.fold_upserts(spark.createDataFrame(writes[:cut], WRITES))
        merged = store.upsert(stored, spark.createDataFrame(writes[cut:], WRITES))
        assert rows_of(merged) == replay(writes)
        before = {w[0] for w in writes[:cut]}
        assert all(r["is_new"] == (r["url"] not in before) for r in merged.select("url", "is_new").collect())


def counted(rows, dated, undated):
    """The counter that a loop over arrivals would keep."""
    counts, out = {}, []
    for seq, key, at in rows:
        if counts.get(key, 0) < (undated if at is None else dated):
            counts[key] = counts.get(key, 0) + 1
            out.append(seq)
    return out


def test_admission_equals_a_counter(spark):
    rng = random.Random(2)
    cases = [[(i, "d", T0 if i < 25 else None) for i in range(75)]]
    cases += [[(i, rng.choice("ab"), rng.choice([None, T0])) for i in range(rng.randrange(60))] for _ in range(8)]
    for n, rows in enumerate(cases):
        caps = (20, 60) if n == 0 else (3, 7)
        df = spark.createDataFrame(rows, "seq bigint, k string, published_at timestamp")
        assert sorted(r["seq"] for r in dedupe.admit(df, "k", dated=caps[0], undated=caps[1]).collect()) == counted(rows, *caps)
    assert len(counted(cases[0], 20, 60)) == 60


def test_first_dated(spark):
    df = spark.createDataFrame([("u", 1, None), ("u", 2, T0), ("u", 3, T0), ("v", 4, None), ("v", 5, None)], "url string, seq bigint, published_at timestamp")
    assert sorted(r["seq"] for r in dedupe.first_dated(df, "url").collect()) == [2, 4]
    assert sorted(r["seq"] for r in dedupe.first_seen(df, "url").collect()) == [1, 4]


def test_numbered_slugs(spark):
    urls = ["/a-b-c-d", "/a-b-c-d-2", "/xiaomi-13", "/xiaomi", "/a-b-c-e-3", "/a-b-c-d-200"]
    df = spark.createDataFrame([(f"https://x.example.com{u}",) for u in urls], "url string")
    stored = spark.createDataFrame([("https://x.example.com/a-b-c-e",)], "url string")
    kept = {r["url"][21:] for r in dedupe.drop_numbered(df, stored).collect()}
    assert kept == {"/a-b-c-d", "/xiaomi-13", "/xiaomi", "/a-b-c-d-200"}


def test_null_times(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(None,), (dt.datetime(2024, 1, 30, 12),), (dt.datetime(2024, 1, 1),), (dt.datetime(2025, 1, 1),)], "t timestamp")
    got = df.select(scan.within_window(F.col("t"), now, 24).alias("a"), scan.listed_in_window(F.col("t"), now, now, 24).alias("b"), scan.recent_or_undated(F.col("t"), now, 24).alias("c")).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, True, True), (False, False, False), (True, True, True)]


def test_source_lists(spark):
    lists = spark.createDataFrame([("a", ["x"]), ("b", []), ("f", ["y"])], "domain string, keywords array<string>")
    items = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "source_domain string, feed_domain string")
    got = {r["source_domain"]: r["source_keywords"] for r in lookup.source_keywords(items, lists).collect()}
    assert got == {"a": ["x"], "b": ["y"], "c": None}


def test_listing_stops_at_the_page_that_crosses(spark):
    df = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 2, False), ("s", 3, False)], "g string, page int, c boolean")
    assert sorted(r["page"] for r in dedupe.until_crossed(df, "g", "page", F.col("c")).collect()) == [1, 2, 2]


ITEM = "seq bigint, url string, title string, summary string, published_at timestamp, source_domain string, feed_domain string"


def test_scan_rules(spark):
    at = dt.datetime(2024, 1, 30, 12)
    old = dt.datetime(2023, 1, 1)
    rows = [
        (1, "https://a.example.com/x", "steel up", "", at, "a.example.com", "f"),
        (2, "https://a.example.com/old", "steel up", "", old, "a.example.com", "f"),
        (3, "https://a.example.com/y", "none", "about steel", at, "a.example.com", "f"),
        (4, "https://a.example.com/z", "none", "veja mais: steel", at, "a.example.com", "f"),
        (5, "https://t.example.com/q", "none", "", None, "t.example.com", "t.example.com"),
        (6, "https://b.example.com/any", "none", "", at, "b.example.com", "f"),
        (7, "https://a.example.com/big-steel-deal", "", "", at, "a.example.com", "f"),
        (8, "https://a.example.com/steel/other-slug", "", "", at, "a.example.com", "f"),
        (9, "https://a.example.com/steel/other-slug-b", "", "", None, "a.example.com", "f"),
        (10, "https://news.example.org/articles/1", "steel", "", old, "a.example.com", "f"),
        (11, "https://c.example.com/1", "steel", "", at, "c.example.com", "f"),
    ]
    settings = scan.Settings(keywords=["steel"], topical=("t.example.com",))
    got = {r["seq"]: r["matched_keywords"] for r in scan.candidates(spark.createDataFrame(rows, ITEM), settings, {"b.example.com": ["*"], "c.example.com": ["copper"]}).collect()}
    assert got == {1: ["steel"], 3: ["steel"], 5: ["#topic"], 6: ["#source"], 7: ["steel"], 9: ["steel"], 10: ["steel"]}


def test_final_rules(spark):
    at, now = dt.datetime(2024, 1, 30, 12), dt.datetime(2024, 1, 31)
    base = {"summary": "", "feed_domain": "f", "page_title": "", "matched_keywords": ["steel"]}
    rows = [
        dict(base, seq=1, url="https://a.example.com/x", title="steel", snippet="s", published_at=at, source_domain="a"),
        dict(base, seq=2, url="https://a.example.com/u", title="steel", snippet="s", published_at=None, source_domain="a"),
        dict(base, seq=3, url="https://p.example.com/u", title="steel", snippet="", published_at=None, source_domain="paid"),
        dict(base, seq=4, url="https://a.example.com/v", title="steel", snippet="", published_at=at, source_domain="a"),
        dict(base, seq=5, url="https://a.example.com/steel-of-slugs", title="", snippet="s", published_at=dt.datetime(2024, 1, 31, 1), source_domain="a"),
        dict(base, seq=6, url="https://a.example.com/w", title="copper", snippet="s", published_at=at, source_domain="a"),
        dict(base, seq=7, url="https://news.example.org/1", title="steel", snippet="s", published_at=at, source_domain="a"),
    ]
    schema = ITEM + ", snippet string, page_title string, matched_keywords array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = {r["seq"]: (r["title"], r["published_at"]) for r in scan.finish(df, scan.Settings(keywords=["steel"], paywalled=("paid",))).collect()}
    assert got == {1: ("steel", at), 3: ("steel", now), 5: ("Steel of slugs", now)}


def test_cache_keeps_pages_of_hits_unparsed(spark):
    at = dt.datetime(2024, 1, 30, 12)
    items = spark.createDataFrame([(1, "u1", "steel", "", at, "a", "f"), (2, "u2", "steel", "", at, "a", "f"), (3, "u3", "steel", "", at, "a", "f")], ITEM)
    stored = spark.createDataFrame([("u1", "known", None, "old title"), ("u2", "", None, "")], "url string, snippet string, published_at timestamp, title string")
    hits, rest = scan.with_cache(items, stored)
    assert [(r["seq"], r["snippet"], r["page_title"]) for r in hits.collect()] == [(1, "known", "old title")]
    assert sorted(r["seq"] for r in rest.collect()) == [2, 3]


def test_wrapped_links_have_a_budget_and_come_after_direct_items(spark):
    rng = random.Random(5)
    settings = scan.Settings(keywords=["steel"], resolve_budget=9)
    rows, targets = [], []
    for i in range(400):
        domain = rng.choice(["a.example", "b.example", "b.example", "c.example"])
        wrapped = rng.random() < 0.4
        url = f"{settings.wrapper_prefix}{i}" if wrapped else f"https://{domain}/{i}"
        if wrapped and rng.random() < 0.7:
            targets.append((url, f"https://{rng.choice('cde')}.example/{i}"))
        rows.append((i, url, "steel", "", None if rng.random() < 0.5 else T0, domain, "f"))
    # item by item
    known, used, count, waiting, expected = dict(targets), {}, {}, [], []
    for i, url, _, _, at, domain, _ in rows:
        if url.startswith(settings.wrapper_prefix):
            used[domain] = used.get(domain, 0) + 1
            if used[domain] <= 9:
                waiting.append((i, known.get(url)))
        elif count.get(domain, 0) < (60 if at is None else 20):
            count[domain] = count.get(domain, 0) + 1
            expected.append((i, url))
    for i, target in waiting:
        domain = target and target.split("/")[2]
        if target and count.get(domain, 0) < 20:
            count[domain] = count.get(domain, 0) + 1
            expected.append((i, target))
    got = scan.to_enrich(spark.createDataFrame(rows, ITEM), settings, spark.createDataFrame(targets, "wrapped string, target string")).collect()
    assert sorted((r["seq"], r["url"]) for r in got) == sorted(expected)
    none = scan.to_enrich(spark.createDataFrame(rows, ITEM), settings).collect()
    assert {r["url"] for r in none} == {u for _, u in expected if known.get(u) is None and "/" in u and u in {r[1] for r in rows}}


def test_the_whole_scan_with_side_collectors_and_the_store(spark):
    at, now = dt.datetime(2024, 1, 30, 12), dt.datetime(2024, 1, 31)
    settings = scan.Settings(keywords=["steel"])
    items = [(0, "https://a.example/1", "steel up", "", at, "a.example", "f"), (1, "https://news.example.org/x", "steel down", "", at, "f", "f"), (2, "https://news.example.org/y", "steel", "", at, "f", "f")]
    page = "<html><body><p>" + "A long paragraph about rolled steel and its prices. " * 3 + "</p></body></html>"
    pages = spark.createDataFrame([("https://a.example/1", page), ("https://b.example/2", page)], "url string, html string")
    targets = spark.createDataFrame([("https://news.example.org/x", "https://b.example/2?utm_source=z")], "wrapped string, target string")
    cache = spark.createDataFrame([], "url string, snippet string, published_at timestamp, title string")
    names = spark.createDataFrame([("b.example", "B")], "domain string, name string")
    side = spark.createDataFrame([(0, "https://a.example/1", "a.example", "steel again", "s", at, now, ["steel"], "whole text")], "seq bigint, url string, domain string, title string, snippet string, published_at timestamp, found_at timestamp, matched_keywords array<string>, body string")
    got = scan.run_scan(spark.createDataFrame(items, ITEM), pages, cache, names, settings, targets=targets, collected=[side])
    assert sorted((r["url"], r["title"], r["source_name"]) for r in got.collect()) == [("https://a.example/1", "steel again", "a.example"), ("https://a.example/1", "steel up", "a.example"), ("https://b.example/2", "steel down", "B")]
    old = got.where("domain = 'b.example'").drop("seq").withColumn("title", F.lit("old"))
    after = {r["url"]: (r["title"], r["body"], r["is_new"]) for r in scan.write_scan(old, got).collect()}
    assert after == {"https://a.example/1": ("steel again", "whole text", True), "https://b.example/2": ("steel down", "", False)}
