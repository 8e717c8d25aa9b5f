"""Queries over rows: deduplication, caps, ranks, joins, the article store, views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsflow.catalog.base import AS_OF, HISTORY, ITEMS, KEYWORDS, history, items, matched_sql, now, query, seconds, table
from newsflow.functions.matching import matched
from newsflow.operators import dedupe, lookup, store
from newsflow.plans import scan, views

LAST = "epoch_us"


# ---- ranks, caps, order -----------------------------------------------------


@query("n4_first_seen", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM i) SELECT url, seq FROM r WHERE n = 1")
def n4(spark, sf):
    return dedupe.first_seen(items(spark, sf), "url").select("url", "seq")


@query("n5_first_dated", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY published_at IS NULL, seq) AS n FROM i) SELECT url, seq FROM r WHERE n = 1")
def n5(spark, sf):
    return dedupe.first_dated(items(spark, sf), "url").select("url", "seq")


@query("q1_distinct_users", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, event_type FROM r WHERE n = 1")
def q1(spark, sf):
    return dedupe.first_seen(table(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("a7_admission_cap", f"""
    WITH {ITEMS},
    a AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY seq) AS n FROM i),
    b AS (SELECT *, count(*) FILTER (n > 20 AND published_at IS NULL) OVER (PARTITION BY source_domain ORDER BY seq) AS u FROM a)
    SELECT seq, source_domain FROM b WHERE n <= 20 OR (published_at IS NULL AND 20 + u <= 60)""")
def a7(spark, sf):
    return dedupe.admit(items(spark, sf), "source_domain").select("seq", "source_domain")


@query("a7_resolver_budget", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY feed_domain ORDER BY seq) AS n FROM i) SELECT seq FROM r WHERE n <= 80")
def a7b(spark, sf):
    w = Window.partitionBy("feed_domain").orderBy("seq")
    return items(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 80").select("seq")


@query("n1_running_count", f"WITH {ITEMS} SELECT seq, row_number() OVER (PARTITION BY source_domain ORDER BY seq) AS n FROM i")
def n1(spark, sf):
    return items(spark, sf).select("seq", F.row_number().over(Window.partitionBy("source_domain").orderBy("seq")).alias("n"))


@query("n2_publication_rank", "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank, s_suppkey FROM supplier")
def n2(spark, sf):
    return dedupe.ranked(table(spark, sf, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")]).select("rank", "s_suppkey")


@query("n3_adjacent_dedupe", "WITH a AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, len(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1])) AS n FROM a")
def n3(spark, sf):
    from newsflow.functions.text import distinct_from_previous

    return table(spark, sf, "documents").select("doc_id", F.size(distinct_from_previous(F.split("text", " "))).cast("long").alias("n"))


@query("n6_cut_at_sentinel", """
    WITH a AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
    SELECT doc_id, CASE WHEN list_position(w, 'and') > 0 THEN list_position(w, 'and') - 1 ELSE len(w) END AS n FROM a""")
def n6(spark, sf):
    words = F.split("text", " ")
    at = F.array_position(words, "and")
    return table(spark, sf, "documents").select("doc_id", F.size(F.when(at > 0, F.slice(words, F.lit(1), at - 1)).otherwise(words)).cast("long").alias("n"))


@query("n7_stop_after_cutoff", f"""
    WITH {ITEMS}, p AS (SELECT *, seq // 10 AS page FROM i),
    c AS (SELECT lang, page, max(CASE WHEN published_at < TIMESTAMP '{AS_OF}' - INTERVAL 100 HOUR THEN 1 ELSE 0 END) AS crossed FROM (SELECT *, left(feed_domain, 2) AS lang FROM p) GROUP BY lang, page),
    k AS (SELECT lang, page, coalesce(max(crossed) OVER (PARTITION BY lang ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT seq FROM p JOIN k ON left(p.feed_domain, 2) = k.lang AND p.page = k.page WHERE before = 0""")
def n7(spark, sf):
    rows = items(spark, sf).withColumn("page", F.floor(F.col("seq") / 10)).withColumn("lang", F.left("feed_domain", F.lit(2)))
    crossed = F.coalesce(F.col("published_at") < now() - F.make_dt_interval(hours=F.lit(100)), F.lit(False))
    return dedupe.until_crossed(rows, "lang", "page", crossed).select("seq")


@query("n8_changed_from_previous", "WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT event_id FROM e WHERE p IS NULL OR p <> event_type")
def n8(spark, sf):
    return dedupe.changed_from_previous(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("event_id")


@query("o1_listing", f"WITH {ITEMS} SELECT seq, url FROM i WHERE coalesce(published_at, TIMESTAMP '2024-01-30 00:00:00') >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR ORDER BY coalesce(published_at, TIMESTAMP '2024-01-30 00:00:00') DESC, seq LIMIT 500")
def o1(spark, sf):
    at = F.coalesce("published_at", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return items(spark, sf).where(at >= now() - F.make_dt_interval(hours=F.lit(72))).orderBy(at.desc(), "seq").limit(500).select("seq", "url")


@query("o2_latest_run", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def o2(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_orderkey")).limit(1).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("o3_top_publications", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def o3(spark, sf):
    return dedupe.top(table(spark, sf, "supplier"), [F.desc("s_acctbal"), F.col("s_suppkey")], 10).select("s_suppkey", "s_name")


@query("o4_sorted_keywords", "SELECT DISTINCT n_regionkey AS domain, n_name AS keyword FROM nation ORDER BY 1, 2")
def o4(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_regionkey").alias("domain"), F.col("n_name").alias("keyword")).distinct().orderBy("domain", "keyword")


@query("o5_refresh_worklist", f"""
    WITH {HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq DESC) AS n FROM h)
    SELECT url, CASE WHEN title LIKE '%9%' THEN 0 WHEN title LIKE '%7%' THEN 1 ELSE 2 END AS priority FROM r WHERE n = 1 AND length(body) < 30
    ORDER BY priority, published_at DESC NULLS LAST, url LIMIT 60""")
def o5(spark, sf):
    newest = dedupe.first_by(history(spark, sf), "url", [F.desc("seq")])
    return views.refresh_worklist(newest, ["9", "7"], short=30).select("url", "priority")


@query("o6_shortest_first", f"WITH {HISTORY} SELECT seq, length(body) AS n FROM h WHERE length(body) < 12")
def o6(spark, sf):
    return views.shortest_first(history(spark, sf), 12).select("seq", F.col("n").cast("long").alias("n"))


@query("o7_longest_keyword_first")
def o7(spark, sf):
    words = sorted(KEYWORDS, key=len, reverse=True)
    return spark.createDataFrame([(i, w) for i, w in enumerate(words)], "pos int, keyword string")


@query("o8_head_per_source", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_domain ORDER BY published_at DESC NULLS LAST, seq) AS n FROM i) SELECT seq FROM r WHERE n <= 12")
def o8(spark, sf):
    w = Window.partitionBy("source_domain").orderBy(F.desc_nulls_last("published_at"), "seq")
    return items(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 12").select("seq")


@query("o9_first_paragraphs", "SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda p: length(p) > 40)[1:3], ' ') AS t FROM documents")
def o9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda p: F.length(p) > 40), 1, 3), " ").alias("t"))


# ---- sets -------------------------------------------------------------------


@query("q2_union_all", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents UNION ALL SELECT page_id FROM pages)")
def q2(spark, sf):
    both = table(spark, sf, "documents").select(F.col("doc_id").alias("id")).unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("id")))
    return both.agg(F.count("*").alias("n"))


@query("q3_set_intersection", "SELECT p_partkey, len(list_intersect(string_split(p_name, ' '), ['red', 'ring', 'bolt'])) AS n FROM part")
def q3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), F.array(*map(F.lit, ("red", "ring", "bolt"))))).cast("long").alias("n"))


@query("q4_set_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [p_type, 'x']))), ' ') AS names FROM part")
def q4(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.array("p_type", F.lit("x")))), " ").alias("names"))


@query("q5_new_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q5(spark, sf):
    return store.new_rows(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


# ---- joins ------------------------------------------------------------------

MODES = "m AS (SELECT r_name AS domain, CASE r_regionkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'specific' ELSE 'global' END AS mode FROM region), k AS (SELECT r_name AS domain, n_name AS keyword FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 20)"


def modes(spark, sf):
    return table(spark, sf, "region").select(F.col("r_name").alias("domain"), F.element_at(F.array(F.lit("all"), F.lit("specific"), F.lit("global")), (F.col("r_regionkey") % 3 + 1).cast("int")).alias("mode"))


def mode_keywords(spark, sf):
    joined = table(spark, sf, "nation").where("n_nationkey < 20").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("r_name").alias("domain"), F.col("n_name").alias("keyword"))


@query("j1_effective_keywords", f"WITH {MODES} SELECT m.domain, CASE WHEN any_value(mode) = 'all' THEN '*' ELSE coalesce(string_agg(keyword, ',' ORDER BY keyword), '') END AS keywords FROM m LEFT JOIN k USING (domain) WHERE mode <> 'global' GROUP BY m.domain")
def j1(spark, sf):
    return lookup.effective_keywords(modes(spark, sf), mode_keywords(spark, sf)).select("domain", F.array_join("keywords", ",").alias("keywords"))


@query("a3_keywords_of_domain", f"WITH {MODES} SELECT domain, string_agg(keyword, ',' ORDER BY keyword) AS keywords FROM k GROUP BY domain")
def a3(spark, sf):
    return mode_keywords(spark, sf).groupBy("domain").agg(F.array_join(F.sort_array(F.collect_list("keyword")), ",").alias("keywords"))


@query("j2_two_key_lookup", f"""
    WITH {ITEMS}, l AS (SELECT * FROM (VALUES ('src1.example.com', 'the,that'), ('fr.feed.example.com', 'les'), ('src2.example.com', '')) AS v(domain, kw))
    SELECT seq, coalesce(a.kw, b.kw) AS keywords FROM i LEFT JOIN l AS a ON a.domain = source_domain AND a.kw <> '' LEFT JOIN l AS b ON b.domain = feed_domain AND b.kw <> ''""")
def j2(spark, sf):
    lists = spark.createDataFrame([("src1.example.com", ["the", "that"]), ("fr.feed.example.com", ["les"]), ("src2.example.com", [])], "domain string, keywords array<string>")
    return lookup.source_keywords(items(spark, sf), lists).select("seq", F.array_join("source_keywords", ",").alias("keywords"))


@query("j3_cache_lookup", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def j3(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("j4_bodies", "SELECT p.page_id, coalesce(d.text, '') AS body FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id * 7")
def j4(spark, sf):
    bodies = table(spark, sf, "documents").select((F.col("doc_id") / 7).cast("long").alias("page_id"), F.col("text").alias("body"), "doc_id").where("doc_id % 7 = 0").drop("doc_id")
    return table(spark, sf, "pages").select("page_id").join(bodies, "page_id", "left").withColumn("body", F.coalesce("body", F.lit("")))


NUMBERED = "u AS (SELECT doc_id AS seq, 'https://x.example.com/' || CASE WHEN doc_id % 3 = 0 THEN 'x-' ELSE 'a-b-c-' END || (doc_id // 4) || 'q' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '-' || (doc_id % 4) END AS url FROM documents)"


def numbered(spark, sf):
    d = F.col("doc_id")
    url = F.concat(F.lit("https://x.example.com/"), F.when(d % 3 == 0, "x-").otherwise("a-b-c-"), F.floor(d / 4).cast("string"), F.lit("q"), F.when(d % 4 == 0, "").otherwise(F.concat(F.lit("-"), d % 4)))
    return table(spark, sf, "documents").select(d.alias("seq"), url.alias("url"))


@query("j5_numbered_slugs", f"""
    WITH {NUMBERED}, b AS (SELECT *, regexp_extract(url, '^(.*)-\\d{{1,2}}$', 1) AS base FROM u)
    SELECT seq FROM b WHERE NOT (base <> '' AND length(regexp_replace(regexp_extract(base, '([^/]*)$', 1), '[^-]', '', 'g')) >= 3 AND base IN (SELECT url FROM u))""")
def j5(spark, sf):
    rows = numbered(spark, sf)
    return dedupe.drop_numbered(rows, rows.limit(0)).select("seq")


@query("j6_contained_id", "WITH s AS (SELECT page_id, regexp_extract(url, '/(\\d+)', 1) AS id, length(html) AS n FROM pages), m AS (SELECT id, max_by(n, page_id) AS n FROM s WHERE id <> '' GROUP BY id) SELECT p_partkey, coalesce(n, 0) AS stored_length FROM part LEFT JOIN m ON m.id = p_partkey::VARCHAR")
def j6(spark, sf):
    stored = table(spark, sf, "pages").select(F.col("url"), F.col("html").alias("body"), F.col("page_id").alias("found_at"))
    wanted = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    return lookup.contained_id(wanted, stored, r"/(\d+)").select("p_partkey", F.col("stored_length").cast("long").alias("stored_length"))


@query("j7_display_names", "SELECT c_custkey, coalesce(n_name, c_nationkey::VARCHAR) AS source_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 15")
def j7(spark, sf):
    names = table(spark, sf, "nation").where("n_nationkey < 15").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("domain"), F.col("n_name").alias("name"))
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.when(F.col("c_custkey") % 2 == 0, "www.n").otherwise("n"), F.col("c_nationkey")).alias("domain"))
    return lookup.named(rows, names).select("c_custkey", F.regexp_replace("source_name", r"^(www\.)?n(?=\d)", "").alias("source_name"))


@query("j8_dispatch", "SELECT c_custkey, n_name AS extractor, CASE WHEN n_name IS NULL THEN 'no extractor' END AS error FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey < 10")
def j8(spark, sf):
    rules = table(spark, sf, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("extractor"))
    return table(spark, sf, "customer").join(lookup.small(rules), "c_nationkey", "left").select("c_custkey", "extractor", F.when(F.col("extractor").isNull(), "no extractor").alias("error"))


@query("j9_ordered_request", f"""
    WITH {HISTORY}, a AS (SELECT DISTINCT url FROM h), r AS (SELECT pos, 'u' || (pos * 3) AS url, CASE WHEN pos < 20 THEN '+' ELSE '=' END AS take FROM (SELECT unnest(range(40)) AS pos))
    SELECT pos, r.url, take, a.url IS NOT NULL AS found FROM r LEFT JOIN a ON a.url = r.url""")
def j9(spark, sf):
    lists = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda p: F.concat(F.lit("u"), p * 3)).alias("urls"), F.array_repeat(F.lit("+"), 20).alias("takes"), F.array().cast("array<string>").alias("sectors"))
    request = lists.select(F.inline(lookup.zipped_request(F.col("urls"), F.col("takes"), F.col("sectors"))))
    return lookup.requested(request, history(spark, sf).select("url").distinct()).select("pos", "url", "take", "found")


@query("j10_reorder", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, n_nationkey")
def j10(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("r_name", "n_nationkey").select("n_name", "r_name")


@query("j11_source_admin", f"""
    WITH {MODES}, s AS (SELECT r_name AS domain FROM region UNION ALL SELECT 'OTHER')
    SELECT s.domain, coalesce(any_value(mode), 'global') AS mode, CASE WHEN any_value(mode) = 'specific' THEN coalesce(string_agg(keyword, ',' ORDER BY keyword), '') ELSE '' END AS keywords
    FROM s LEFT JOIN m USING (domain) LEFT JOIN k USING (domain) GROUP BY s.domain""")
def j11(spark, sf):
    known = table(spark, sf, "region").select(F.col("r_name").alias("domain")).union(spark.createDataFrame([("OTHER",)], "domain string"))
    return lookup.source_admin(known, modes(spark, sf), mode_keywords(spark, sf)).select("domain", "mode", F.array_join("keywords", ",").alias("keywords"))


@query("j12_merge_replace", "SELECT doc_id, coalesce(l.quality, 9) AS quality FROM documents LEFT JOIN labels l USING (doc_id)")
def j12(spark, sf):
    current = table(spark, sf, "documents").select("doc_id", F.lit(9).alias("quality"))
    return lookup.replaced(current, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


# ---- the store --------------------------------------------------------------

FOLD = f"""
    {HISTORY}, f AS (
    SELECT url, arg_min(domain, seq) AS domain, arg_min(source_name, seq) AS source_name, arg_max(title, seq) AS title, arg_max(snippet, seq) AS snippet,
           floor(epoch(arg_max(published_at, seq) FILTER (published_at IS NOT NULL)))::BIGINT AS published, floor(epoch(arg_min(found_at, seq)))::BIGINT AS found,
           arg_max(kw, seq) AS keywords, arg_max(body, length(body) * 1000000000 - seq) AS body FROM h GROUP BY url)"""


def _article(df):
    return df.select("url", "domain", "source_name", "title", "snippet", seconds("published_at").alias("published"), seconds("found_at").alias("found"), F.array_join("matched_keywords", ",").alias("keywords"), "body")


@query("w1_upsert_fold", f"WITH {FOLD} SELECT * FROM f")
def w1(spark, sf):
    return _article(store.fold_upserts(history(spark, sf)))


@query("w2_batch_upsert", f"WITH {FOLD} SELECT f.*, url NOT IN (SELECT url FROM h WHERE seq <= 600) AS is_new FROM f")
def w2(spark, sf):
    h = history(spark, sf)
    stored = store.fold_upserts(h.where("seq <= 600"))
    merged = store.upsert(stored, h.where("seq > 600"))
    return _article(merged).join(merged.select("url", "is_new"), "url")


@query("w3_save_body", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) >= 100 AND length(text) > 1500 THEN length(text) ELSE 1500 END AS n FROM documents")
def w3(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.select(F.col("doc_id").alias("url"), F.repeat(F.lit("x"), F.lit(1500)).alias("body"))
    return store.save_bodies(stored, d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("url"), F.col("text").alias("new_body"))).select(F.col("url").alias("doc_id"), F.length("body").cast("long").alias("n"))


@query("t11_forced_body", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(text) >= 100 THEN length(text) ELSE 1500 END AS n FROM documents")
def t11(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.select(F.col("doc_id").alias("url"), F.repeat(F.lit("x"), F.lit(1500)).alias("body"))
    return store.save_bodies(stored, d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("url"), F.col("text").alias("new_body")), force=True).select(F.col("url").alias("doc_id"), F.length("body").cast("long").alias("n"))


@query("w4_replace_publications", "SELECT row_number() OVER (ORDER BY s_suppkey DESC) AS rank, s_name AS title FROM supplier")
def w4(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("title"), "s_suppkey")
    return store.replace_ranked(rows, [F.desc("s_suppkey")], rows.limit(0)).select("rank", "title")


@query("w5_retention", f"WITH {HISTORY} SELECT seq FROM h WHERE found_at >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR")
def w5(spark, sf):
    return store.retain(history(spark, sf), now(), 72).select("seq")


@query("a2_affected_rows", f"WITH {HISTORY} SELECT count(*) AS removed FROM h WHERE found_at < TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR")
def a2(spark, sf):
    h = history(spark, sf)
    kept = store.retain(h, now(), 72).withColumn("kept", F.lit(1)).select("seq", "kept")
    return h.join(kept, "seq", "left").agg(F.count_if(F.col("kept").isNull()).alias("removed"))


@query("w6_key_value", "SELECT event_type || (user_id % 10) AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1 HAVING arg_max(event_id % 11, event_id) <> 0")
def w6(spark, sf):
    e = table(spark, sf, "events")
    writes = e.select(F.concat("event_type", F.col("user_id") % 10).alias("key"), F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("value"), (F.col("event_id") + 1).alias("seq"))
    # max_by skips no nulls: a last write without a value deletes the key
    return store.put(writes.limit(0).select("key", "value"), writes)


@query("w7_seed", f"WITH {MODES} SELECT domain, keyword FROM k UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey >= 20")
def w7(spark, sf):
    every = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("domain"), F.col("n_name").alias("keyword"))
    return store.seed(mode_keywords(spark, sf), every, ["domain", "keyword"])


@query("w8_modes_of_keywords", f"WITH {MODES} SELECT m.domain, CASE WHEN m.domain IN (SELECT domain FROM k WHERE keyword LIKE '%1%') THEN 'specific' ELSE mode END AS mode FROM m")
def w8(spark, sf):
    return store.set_modes(modes(spark, sf), mode_keywords(spark, sf).where("keyword like '%1%'"))


@query("w8_promote_empty", f"WITH {MODES} SELECT domain, CASE WHEN mode = 'specific' THEN 'all' ELSE mode END AS mode FROM m")
def w8b(spark, sf):
    m = modes(spark, sf)
    return store.promote_empty(m, mode_keywords(spark, sf).limit(0), [r["domain"] for r in m.select("domain").collect()])


@query("w9_keyword_list", "SELECT p_partkey, array_to_string(list_filter(CASE WHEN list_contains(string_split(p_name, ' '), 'red') THEN string_split(p_name, ' ') ELSE list_append(string_split(p_name, ' '), 'red') END, lambda x: x <> 'ring'), ' ') AS words FROM part")
def w9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_remove(store.add_keyword(F.split("p_name", " "), " red "), "ring"), " ").alias("words"))


@query("w10_run_log", "WITH e AS (SELECT user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'error') SELECT c_custkey AS id, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id), '') AS errors FROM customer LEFT JOIN e ON id = c_custkey AND n <= 5 GROUP BY c_custkey")
def w10(spark, sf):
    runs = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    errors = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("error"))
    return store.finish_run(runs, errors, 5).select("id", F.array_join("errors", ",").alias("errors"))


@query("w11_alerts", "SELECT n_name AS source, 'expired' AS message, '2024' AS ts FROM nation WHERE n_nationkey % 2 = 0")
def w11(spark, sf):
    value = F.to_json(F.struct(F.lit("expired").alias("message"), F.lit("2024").alias("ts")))
    config = table(spark, sf, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "session_alert_").otherwise("other_"), "n_name").alias("key"), value.alias("value"))
    return store.alerts(config)


@query("w13_blank_bodies", f"WITH {HISTORY} SELECT seq, CASE WHEN domain NOT IN ('error', 'view') THEN length(body) END AS n FROM h")
def w13(spark, sf):
    return store.blank_bodies(history(spark, sf), ["error", "view"]).select("seq", F.length("body").cast("long").alias("n"))


@query("p14_cached_body", f"WITH {HISTORY} SELECT seq, length(body) >= 20 AND domain <> 'error' AS from_store FROM h")
def p14(spark, sf):
    h = history(spark, sf)
    return views.cached_body(h.select(F.col("seq").alias("url"), "body", "domain"), ["error"], 20).select(F.col("url").alias("seq"), "from_store")


@query("r15_point_lookup", "SELECT page_id FROM pages WHERE page_id = 7")
def r15(spark, sf):
    from newsflow.functions import urls as U

    stored = table(spark, sf, "pages").withColumn("url", U.canonical(F.col("url")))
    wanted = stored.where("page_id = 7").first()["url"]
    return views.article(stored, wanted + ("&" if "?" in wanted else "?") + "utm_source=x").select("page_id")


# ---- aggregates -------------------------------------------------------------


@query("a1_counts", f"WITH {HISTORY} SELECT count(*) AS n, count(*) FILTER (domain = 'error') AS n_errors FROM h")
def a1(spark, sf):
    return history(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("domain") == "error").alias("n_errors"))


@query("a5_high_water_mark", "SELECT floor(epoch(max(ts)))::BIGINT AS mark FROM events")
def a5(spark, sf):
    return table(spark, sf, "events").agg(seconds(F.max(F.col("ts").cast("timestamp"))).alias("mark"))


@query("a6_run_statistics", f"WITH {ITEMS}, c AS (SELECT * FROM i WHERE {matched_sql('title')} <> '') SELECT (SELECT count(*) FROM i) AS n_raw, count(*) AS n_cand, count(*) FILTER (seq IN (SELECT doc_id FROM labels WHERE quality = 1)) AS n_cache FROM c")
def a6(spark, sf):
    i = items(spark, sf).withColumn("url", F.col("seq").cast("string"))
    stored = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("url"), F.lit("x").alias("snippet"))
    return scan.statistics(i, i.where(F.size(matched(F.col("title"), KEYWORDS)) > 0), stored)


@query("a9_body_lengths", "SELECT lang, sum(length(text)) AS chars, count(*) AS n FROM documents GROUP BY lang")
def a9(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))


@query("a10_tallies", "SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type NOT IN ('error', 'view')) AS done FROM events")
def a10(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").agg(F.count_if(kind == "error").alias("failed"), F.count_if(kind == "view").alias("skipped"), F.count_if(~kind.isin("error", "view")).alias("done"))


@query("a11_ordered_text", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS t FROM conversations GROUP BY conv_id")
def a11(spark, sf):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("t"))
