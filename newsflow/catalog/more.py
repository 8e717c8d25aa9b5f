"""Further queries: service views, configuration writes, and operators that are special cases of others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsflow.catalog.base import AS_OF, HISTORY, ITEMS, KEYWORDS, TITLE_SQL, canonical_sql, fold_sql, history, items, joined, now, page_items, query, seconds, table
from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.functions.matching import matched
from newsflow.operators import dedupe, lookup, store
from newsflow.plans import scan, views


@query("p11_priority_buckets", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%red%' THEN 0 WHEN lower(p_name) LIKE '%bolt%' THEN 1 ELSE 2 END AS priority FROM part ORDER BY priority, p_retailprice DESC, p_partkey LIMIT 60")
def p11(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("url"), F.col("p_name").alias("title"), F.lit("").alias("body"), F.col("p_retailprice").alias("published_at"))
    return views.refresh_worklist(rows, ["red", "bolt"]).select(F.col("url").alias("p_partkey"), "priority")


@query("o10_newest_first", f"WITH {ITEMS} SELECT seq, url FROM i ORDER BY published_at DESC NULLS LAST, seq")
def o10(spark, sf):
    return items(spark, sf).orderBy(F.desc_nulls_last("published_at"), "seq").select("seq", "url")


@query("q6_consecutive_dedupe", "WITH e AS (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS p FROM events WHERE user_id = 7) SELECT event_id, event_type FROM e WHERE p IS DISTINCT FROM event_type")
def q6(spark, sf):
    return dedupe.changed_from_previous(table(spark, sf, "events").where("user_id = 7"), "user_id", "event_id", "event_type").select("event_id", "event_type")


@query("s4_matcher_pattern")
def s4(spark, sf):
    """The pattern's alternatives come longest first, and no keyword at all matches nothing."""
    return table(spark, sf, "documents").select("doc_id", F.size(matched(F.col("text"), [])).alias("none"), F.size(matched(F.col("text"), KEYWORDS)).alias("some"))


@query("s29_replacement_characters", "SELECT doc_id, length(text) AS n FROM documents")
def s29(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(F.replace(F.concat(F.lit("�"), "text"), F.lit("�"), F.lit(""))).alias("n"))


@query("s31_strip_accents", "SELECT doc_id, md5(lower(strip_accents(text))) AS t FROM documents")
def s31(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("t"))


@query("r24_detail_pages")
def r24(spark, sf):
    rules = {s: {"selectors": ["article"], "remove": ["div.ad", "p.lead"]} for s in ("therin.example.net", "spam-farm.example.org")}
    return table(spark, sf, "pages").select("page_id", F.md5(H.extract_container(F.col("html"), U.site(F.col("url")), rules, ["main"])).alias("t"))


@query("h16_site_rules")
def h16(spark, sf):
    """Removal rules of a site as configuration: parts that are advertising, and everything from "read also"."""
    marked = F.concat(F.lit('<article><p>kept</p><div class="ad">x</div><section><div class="ai-widget">y</div></section>'), F.lit("<p>Read also</p>"), "html", F.lit("</article>"))
    rules = {"x": {"selectors": ["article"], "remove": ["div.ad", "div.ai-widget"], "stop": r"\s*read also\b"}}
    return table(spark, sf, "pages").select("page_id", H.extract_container(marked, F.lit("x"), rules).alias("html"))


@query("u1_extractor_registry")
def u1(spark, sf):
    """One extractor for all sites, driven by a table of selectors."""
    selectors = {"therin.example.net": {"selectors": ["div.content", "article"]}}
    pages = table(spark, sf, "pages").withColumn("body", H.extract_container(F.col("html"), U.site(F.col("url")), selectors))
    return pages.select("page_id", H.page_title(F.col("html")).alias("title"), F.size(H.paragraph_texts(F.col("body"))).alias("paragraphs"))


@query("h13_title_only", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {TITLE_SQL} ELSE '' END AS page_title FROM pages")
def h13(spark, sf):
    """Titles are read from pages only where the feed brought none."""
    rows = table(spark, sf, "pages").withColumn("title", F.when(F.col("page_id") % 2 == 0, "").otherwise("own"))
    return rows.select("page_id", F.when(F.col("title") == "", H.page_title(F.col("html"))).otherwise("").alias("page_title"))


@query("t10_new_flags", f"WITH {HISTORY}, a AS (SELECT DISTINCT url FROM h WHERE seq <= 500) SELECT DISTINCT h.url, a.url IS NULL AS is_new FROM h LEFT JOIN a ON a.url = h.url WHERE seq > 500")
def t10(spark, sf):
    h = history(spark, sf)
    seen = h.where("seq <= 500").select("url").distinct().withColumn("seen", F.lit(True))
    return h.where("seq > 500").select("url").distinct().join(seen, "url", "left").select("url", F.col("seen").isNull().alias("is_new"))


@query("t12_fast_mode", f"""
    WITH {ITEMS} SELECT seq FROM i WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND title <> '' AND regexp_matches({fold_sql('title')}, '\\b(?:the|that)\\b')""")
def t12(spark, sf):
    """One fast run over two days: titles and dates suffice, no page is read."""
    settings = scan.Settings(as_of=AS_OF, hours=48, keywords=["the", "that"], fast=True)
    rows = items(spark, sf).where("title <> ''").withColumn("summary", F.lit(""))
    ready = scan.candidates(rows, settings).where("published_at is not null").withColumn("snippet", F.lit("")).withColumn("page_title", F.lit(""))
    return scan.finish(ready, settings).select("seq")


@query("v_headlines", f"WITH {ITEMS} SELECT seq FROM i WHERE coalesce(published_at, TIMESTAMP '2024-01-01 00:00:00') >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR ORDER BY published_at DESC, seq LIMIT 500")
def v_headlines(spark, sf):
    at = F.coalesce("published_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return items(spark, sf).where(at >= now() - F.make_dt_interval(hours=F.lit(48))).orderBy(at.desc(), "seq").limit(500).select("seq")


@query("v_search", f"WITH {HISTORY}, f AS (SELECT url, arg_max(title, seq) AS title, arg_min(source_name, seq) AS source_name, max(found_at) AS f FROM h GROUP BY url) SELECT url FROM f WHERE contains(title, '9') AND contains(source_name, 'error')")
def v_search(spark, sf):
    stored = store.fold_upserts(history(spark, sf)).withColumn("published_at", F.lit(None).cast("timestamp")).withColumn("matched_keywords", F.array().cast("array<string>")).withColumn("snippet", F.lit(""))
    return views.list_articles(stored, now(), 24 * 400, 100000, ["9", "ERROR"]).select("url")


@query("v_source_names", f"SELECT page_id AS seq, CASE WHEN regexp_extract({canonical_sql('url')}, '^[^:]+://([^/?#]*)', 1) = 'spam-farm.example.org' THEN 'Spam Farm' ELSE regexp_extract({canonical_sql('url')}, '^[^:]+://([^/?#]*)', 1) END AS source_name FROM pages")
def v_source_names(spark, sf):
    names = spark.createDataFrame([("spam-farm.example.org", "Spam Farm")], "domain string, name string")
    return lookup.named(page_items(spark, sf).withColumn("domain", F.col("source_domain")), names).select("seq", "source_name")


@query("v_window_setting", "SELECT 'window' AS key, '720' AS value")
def v_window_setting(spark, sf):
    writes = spark.createDataFrame([("window", 24, 1), ("window", 9000, 2)], "key string, hours int, seq bigint").select("key", views.clamp_hours(F.col("hours")).cast("string").alias("value"), "seq")
    return store.put(writes.limit(0).select("key", "value"), writes)


@query("v_last_found", f"WITH {HISTORY} SELECT url, floor(epoch(max(found_at)))::BIGINT AS last, count(*) AS writes FROM h GROUP BY url")
def v_last_found(spark, sf):
    return history(spark, sf).groupBy("url").agg(seconds(F.max("found_at")).alias("last"), F.count("*").alias("writes"))


@query("v_keyword_counts", f"WITH {ITEMS}, k AS (SELECT unnest(list_distinct(regexp_extract_all({fold_sql('title')}, '\\b(?:that|the|los|der die|der|une)\\b'))) AS keyword FROM i) SELECT keyword, count(*) AS n FROM k GROUP BY keyword")
def v_keyword_counts(spark, sf):
    return items(spark, sf).select(F.explode(matched(F.col("title"), KEYWORDS)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


@query("v_new_per_day", f"WITH {HISTORY}, f AS (SELECT url, min(found_at) AS f FROM h GROUP BY url) SELECT strftime(f, '%Y-%m-%d') AS day, count(*) AS n FROM f GROUP BY 1")
def v_new_per_day(spark, sf):
    first = history(spark, sf).groupBy("url").agg(F.min("found_at").alias("f"))
    return first.groupBy(F.date_format("f", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("n1_limit_by_source", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY published_at DESC NULLS LAST, seq) AS n FROM i) SELECT seq, n FROM r WHERE n <= 3")
def n1_limit(spark, sf):
    w = Window.partitionBy("source_domain").orderBy(F.desc_nulls_last("published_at"), "seq")
    return items(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 3").select("seq", "n")


@query("c7_candidates_joined", f"WITH {ITEMS} SELECT seq, {canonical_sql('url')} AS url FROM i WHERE regexp_matches({fold_sql('title')}, '\\b(?:the)\\b')")
def c7_candidates(spark, sf):
    return items(spark, sf).where(joined(matched(F.col("title"), ["the"])) != "").select("seq", U.canonical(F.col("url")).alias("url"))
