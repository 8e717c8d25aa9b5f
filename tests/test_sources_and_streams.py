import datetime as dt
import email
import json
import re

from pyspark.sql import functions as F

from newsflow.operators import store
from newsflow.plans import digest
from newsflow.sources import feeds, json_api, plugin
from newsflow.streaming import incremental


def test_rss_rules(spark):
    item = lambda body: f"<item>{body}</item>"
    rows = [
        (1, "f", item("<title>A &amp; B - Some Source</title><link>https://news.example.org/articles/9</link><description>d</description><pubDate>Tue, 30 Jan 2024 10:00:00 +0000</pubDate><source url='https://www.s.example.net/rss'>S</source>")),
        (2, "f", item("<title>x</title><link>https://redir.example.org/r/*https://a.example.com/y?utm_source=1</link><summary>s</summary>")),
        (3, "f", item("<title>no link</title>")),
        (4, "f", "not xml at all"),
    ]
    got = feeds.items_of_entries(feeds.entries(spark.createDataFrame(rows, "seq bigint, feed_domain string, xml string")), wrapper_hosts=("redir.example.org",)).orderBy("seq").collect()
    assert [(r["seq"], r["url"], r["title"], r["summary"], r["source_domain"]) for r in got] == [(1, "https://news.example.org/articles/9", "A & B", "d", "www.s.example.net"), (2, "https://a.example.com/y", "x", "s", "a.example.com")]
    assert got[0]["published_at"] == dt.datetime(2024, 1, 30, 10) and got[1]["published_at"] is None


def test_links_of_a_page(spark):
    html = '<a href="/fr/a-b-c">1</a><a href="/fr/a-b-c?ref=x">2</a><a href="#t">3</a><a href="https://other.example.com/a-b-c">4</a><a href="/tag/a-b-c">5</a><a href="/short">6</a><a href="//x.example.com/q-r-s/">7</a>'
    got = feeds.page_links(spark.createDataFrame([(1, "https://www.x.example.com/", html)], "page_id bigint, url string, html string"))
    assert sorted(r["url"] for r in got.collect()) == ["https://x.example.com/fr/a-b-c", "https://x.example.com/q-r-s"]


def test_json_payloads(spark):
    a = {"Items": [{"Id": "1", "Headline": "", "Name": "N", "Sector": ["Metals"], "Summary": "s", "Content": "c"}, {"Id": "1", "Headline": "again"}, {"Headline": "no id"}]}
    got = json_api.items_a(spark.createDataFrame([(1, json.dumps(a)), (2, "broken")], "seq bigint, json string")).collect()
    assert [(r["id"], r["title"], r["sectors"], r["body"]) for r in got] == [("1", "N", ["Metals"], "s\nc")]
    value = {"result": {"values": [{"type": "newsArticle", "newsArticle": {"id": "7", "title": " t ", "fullText": "f"}}, {"type": "other"}]}}
    got = json_api.items_b(spark.createDataFrame([(1, json.dumps(value)), (2, json.dumps([value, value]))], "seq bigint, json string")).collect()
    assert [(r["id"], r["title"], r["body"]) for r in got] == [("7", "t", "f")]
    cache = {"captured_at": "x", "reports": [{"uuid": str(i % 12)} for i in range(30)]}
    assert [r["uuid"] for r in json_api.reports(spark.createDataFrame([(json.dumps(cache),)], "json string")).orderBy("rank").collect()] == [str(i) for i in range(10)]


def test_url_list(spark):
    df = spark.createDataFrame([("https://a", "t"), ("ftp://b", "t"), (None, "t")], "first string, BODY string")
    assert [(r["url"], r["body"]) for r in feeds.url_list(df).collect()] == [("https://a", "t")]


def test_plugin(spark):
    plugin.register_collector(spark, "letters", "c string", lambda o: list(o["of"]), lambda o, part: iter([(part,), (part * 2,)]))
    assert sorted(r["c"] for r in spark.read.format("letters").option("of", "ab").load().collect()) == ["a", "aa", "b", "bb"]


def test_configuration_tables(spark):
    writes = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("b", None, 2)], "key string, value string, seq bigint")
    table = spark.createDataFrame([("a", "0"), ("c", "9")], "key string, value string")
    assert {(r["key"], r["value"]) for r in store.put(table, writes).collect()} == {("a", "2"), ("c", "9")}
    current = spark.createDataFrame([("x", 1)], "title string, rank int")
    assert store.replace_ranked(current.limit(0).select("title"), [F.col("title")], current).count() == 1


STORED = "url string, seq bigint, domain string, source_name string, title string, snippet string, published_at timestamp, found_at timestamp, matched_keywords array<string>, body string"


def test_stream_equals_batch_and_survives_a_repeated_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 30)
    rows = [(f"u{i % 5}", i, f"d{i}", "n", f"t{i}", "s", None, at + dt.timedelta(minutes=i), ["k"], "x" * (i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, STORED)
    for half in (F.col("seq") < 20, F.col("seq") >= 20):
        df.where(half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    write = incremental.upsert_sink(f"{tmp_path}/t", "2024-01-31 00:00:00")
    seen = []

    def sink(batch, n):
        write(batch, n)
        write(batch, n)  # a batch that is run again must not change the result
        seen.append(n)

    stream = incremental.item_stream(spark, f"{tmp_path}/in", STORED)
    incremental.run_once(stream, sink, f"{tmp_path}/c")
    assert len(seen) > 1
    got = {tuple(map(str, r)) for r in incremental.current(spark, f"{tmp_path}/t").select("url", "domain", "title", "body").collect()}
    want = {tuple(map(str, r)) for r in store.fold_upserts(df).select("url", "domain", "title", "body").collect()}
    assert {(u, t) for u, _, t, _ in got} == {(u, t) for u, _, t, _ in want} and {(u, len(b)) for u, _, _, b in got} == {(u, len(b)) for u, _, _, b in want}


def test_new_checkpoint_goes_on_from_the_table_and_time_moves(spark, tmp_path):
    at = dt.datetime(2024, 1, 30)
    row = lambda u, i, hours: (u, i, "d", "n", f"t{i}", "s", None, at + dt.timedelta(hours=hours), ["k"], "b")
    write = incremental.upsert_sink(f"{tmp_path}/t", retain_hours=72)
    for n, rows in enumerate(([row("old", 1, 0), row("kept", 2, 50)], [row("new", 3, 100)])):
        spark.createDataFrame(rows, STORED).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
        incremental.run_once(incremental.item_stream(spark, f"{tmp_path}/in{n}", STORED), write, f"{tmp_path}/c{n}")
        urls = {r["url"] for r in incremental.current(spark, f"{tmp_path}/t").collect()}
        assert urls == ({"old", "kept"} if n == 0 else {"kept", "new"})  # 100 hours on, the first one is too old


def test_guard_turns_away_overlaps_and_early_runs():
    now = [0.0]
    guard = incremental.RunGuard(20, lambda: now[0])
    inner = []
    assert guard.run(lambda: inner.append(guard.run(lambda: None))) and inner == [False]
    assert not guard.run(lambda: None)
    now[0] = 20.0
    assert guard.run(lambda: None)


def test_mirror_keeps_one_row_a_key(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "url string, seq long, title string")
    for number, batch in ((0, rows(("a", 1, "x"), ("b", 2, "y"))), (1, rows(("a", 1, "z"), ("a", 2, "w"))), (1, rows(("a", 1, "z"), ("a", 2, "w")))):
        store.mirror(batch, f"{tmp_path}/m", number)
    assert {(r["url"], r["title"]) for r in store.mirrored(spark, f"{tmp_path}/m").collect()} == {("a", "w"), ("b", "y")}


def test_ranks_over_partitions(spark):
    from newsflow.operators import dedupe

    got = dedupe.ranked(spark.range(1000).repartition(7).withColumn("row", F.lit(1)), [F.desc("id")]).collect()
    assert {(r["id"], r["rank"]) for r in got} == {(i, 1000 - i) for i in range(1000)}


def test_digest(spark):
    articles = spark.createDataFrame([("u1", "cement news", ["cement"], "first paragraph\n\nsecond paragraph"), ("u2", "steel", [], "<p>steel body</p>")], "url string, title string, matched_keywords array<string>, body string")
    request = spark.createDataFrame([(0, "u2", "+", ""), (1, "u1", "-", ""), (2, "nope", "=", "")], "pos int, url string, take string, sector string")
    items = digest.digest_items(request, articles, {"cement": ["cement"], "steel": ["steel"]}, "steel")
    rows = {r["pos"]: (r["sector"], r["take"], r["section"], r["error"]) for r in items.collect()}
    assert rows == {0: ("steel", "positive", 0, None), 1: ("cement", "negative", 1, None), 2: (None, "neutral", None, "unknown article")}
    blocks = digest.digest_blocks(items).orderBy("section", "n").collect()
    assert [b["text"] for b in blocks] == ["steel body", "first paragraph", "second paragraph"]
    message = email.message_from_bytes(digest.mail(digest.sections(items), "S", "a@example.com", ["b@example.com"], "H"))
    assert message["Subject"] == "S" and [p.get_content_type() for p in message.walk()][1:] == ["text/plain", "text/html"]


def test_a_long_digest_goes_as_several_messages(spark):
    rows = [(i, f"title {i:04d}", "s" + str(i % 2), i % 2) for i in range(3000)]
    items = spark.createDataFrame(rows, "pos int, title string, sector string, section int").selectExpr("*", "true AS found", "'neutral' AS take").repartition(5)
    got = digest.mails(items, "S", "a@example.com", ["b@example.com"], "H", 10_000).orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(len(got))) and len(got) == 9
    assert sum(s["items"] for r in got for s in r["sectors"]) == 3000
    texts = [next(p for p in email.message_from_bytes(bytes(r["message"])).walk() if p.get_content_type() == "text/html").get_payload(decode=True).decode() for r in got]
    assert [int(t) for text in texts for t in re.findall(r"title (\d+)", text)] == [*range(0, 3000, 2), *range(1, 3000, 2)]
    assert digest.mails(items.limit(0), "S", "a@example.com", ["b@example.com"]).count() == 0


def test_blocks_are_read_where_bodies_lie(spark):
    articles = spark.createDataFrame([(f"u{i}", "t", [], "one paragraph\n\n<two> paragraphs") for i in range(9)], "url string, title string, matched_keywords array<string>, body string")
    request = spark.createDataFrame([(i, f"u{i % 9}", "+", "") for i in range(30)], "pos int, url string, take string, sector string")
    blocks = digest.digest_blocks(digest.digest_items(request, articles, {"a": ["x"], "b": ["y"]}, "a"))
    assert blocks.count() == 60 and blocks.where("section = 0 AND sector = 'a'").count() == 60
    assert "Window" not in blocks._jdf.queryExecution().optimizedPlan().toString()  # no sector in one task


def test_reports_of_a_cache_of_several_files(spark):
    part = lambda n, ids: (n, json.dumps({"captured_at": "now", "reports": [{"uuid": i, "title": "t", "href": "/h"} for i in ids]}))
    cache = spark.createDataFrame([part(2, ["d", "a"]), part(0, ["b", "b"]), part(1, ["c", "b"])], "part long, json string")
    assert [(r["rank"], r["uuid"]) for r in json_api.reports(cache).orderBy("rank").collect()] == [(1, "b"), (2, "c"), (3, "d"), (4, "a")]
