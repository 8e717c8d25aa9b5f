"""Queries over single expressions: text, URLs, keywords, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsflow.catalog.base import AS_OF, ITEMS, KEYWORDS, TITLE_SQL, canonical_sql, escape_sql, fold_sql, host_sql, items, joined, matched_sql, now, page_items, query, seconds, site_sql, table, text_sql, unescape_sql
from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.functions.matching import best_sector, contains_all, matched, sector_scores
from newsflow.operators.dedupe import first_seen
from newsflow.plans import scan, views


@query("recent_matches", f"""
    WITH p AS (SELECT page_id, {canonical_sql('url')} AS url, {TITLE_SQL} AS title FROM pages),
    m AS (SELECT *, {matched_sql('title')} AS keywords FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM m WHERE keywords <> '')
    SELECT page_id, url, {host_sql('url')} AS domain, title, keywords FROM r WHERE n = 1 ORDER BY page_id DESC LIMIT 100""")
def recent_matches(spark, sf):
    """Pages to canonical URLs, titles, keywords; each URL once; the newest 100."""
    rows = page_items(spark, sf).withColumn("keywords", joined(matched(F.col("title"), KEYWORDS))).where("keywords <> ''")
    return first_seen(rows, "url").select(F.col("seq").alias("page_id"), "url", F.col("source_domain").alias("domain"), "title", "keywords").orderBy(F.desc("page_id")).limit(100)


@query("s1_canonical_url", f"SELECT page_id, {canonical_sql('url')} AS url FROM pages")
def s1(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("url"))


@query("s2_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def s2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("s2_fold_exact", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def s2_exact(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(X.fold_exact("text")).alias("folded"))


@query("s3_decompose")
def s3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(X.decompose("text")).alias("n"))


@query("s5_keyword_match", f"SELECT doc_id, {matched_sql('text')} AS keywords FROM documents")
def s5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", joined(matched(F.col("text"), KEYWORDS)).alias("keywords"))


@query("a4_distinct_matches_in_order")
def a4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(matched(F.col("text"), KEYWORDS), ",").alias("keywords"))


@query("s6_cut_related", """SELECT doc_id, length(regexp_replace(text || ' veja mais: ' || text, '(?is)\\b(?:leia\\s+mais|veja\\s+mais)\\b.*', '')) AS n FROM documents""")
def s6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(X.cut_related(F.concat("text", F.lit(" veja mais: "), "text"), ("leia\\s+mais", "veja\\s+mais"))).alias("n"))


@query("s7_strip_footer", """SELECT doc_id, trim(regexp_replace(regexp_replace(lang || ' O post ' || source || ' apareceu primeiro em ' || lang || '. Fim', '<[^>]+>', ' ', 'g'), '(?is)O\\s+post\\s+.+?\\s+apareceu\\s+primeiro\\s+em\\s+[^.<]+\\.', ' ', 'g')) AS t FROM documents""")
def s7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.strip_footer(F.concat("lang", F.lit(" O post "), "source", F.lit(" apareceu primeiro em "), "lang", F.lit(". Fim"))).alias("t"))


@query("s8_html_to_text", f"SELECT page_id, md5({text_sql('html')}) AS t FROM pages")
def s8(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("t"))


_REFERENCES = "'a&ccedil;&atilde;o &amp;lt; &notit; &copy' || doc_id || ' &#' || (doc_id * 97 % 1200000) || '; &#x' || to_hex(doc_id * 31) || '; &nada; ' || text"


@query("s8_references", f"SELECT doc_id, md5({unescape_sql(_REFERENCES)}) AS t FROM documents")
def s8_references(spark, sf):
    """References by name, number and mistake before every text."""
    d = F.col("doc_id")
    made = F.concat(F.lit("a&ccedil;&atilde;o &amp;lt; &notit; &copy"), d, F.lit(" &#"), d * 97 % 1200000, F.lit("; &#x"), F.hex(d * 31), F.lit("; &nada; "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(X.unescape(made)).alias("t"))


@query("s9_html_to_text_exact")
def s9(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(X.squash(X.unescape_exact(F.regexp_replace("html", "<[^>]+>", " ")))).alias("n"))


@query("s10_truncate", """
    WITH t AS (SELECT doc_id, text, left(text, 360) AS h FROM documents),
    c AS (SELECT *, strpos(reverse(h), ' ') AS back FROM t)
    SELECT doc_id, CASE WHEN length(text) <= 360 THEN text
                        ELSE regexp_replace(CASE WHEN back > 0 AND 360 - back > 216 THEN left(h, 360 - back) ELSE h END, '[ ,;:.\\-]+$', '') || '...' END AS t FROM c""")
def s10(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate(F.col("text")).alias("t"))


@query("s11_summary_snippet")
def s11(spark, sf):
    return items(spark, sf).select("seq", X.snippet(F.col("summary"), "comprehensive up-to-date coverage").alias("snippet"))


@query("s12_clean_title", """SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text || ' | ' || source || ' - Daily', '\\s+', ' ', 'g')), '(?is)^(.*?\\S)(?:\\s*[|–-]\\s*(?:Daily|src0|src1|src2|src3))+$', '\\1')) AS title FROM documents""")
def s12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_title(F.concat("text", F.lit(" | "), "source", F.lit(" - Daily")), ["Daily", "src0", "src1", "src2", "src3"]).alias("title"))


@query("s13_clean_paragraphs", """
    WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '\\s+([,.;:!?])', '\\1', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)(?:copyright)|(?:^licensed)')) AS a FROM documents)
    SELECT doc_id, md5(array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), chr(10))) AS t FROM p""")
def s13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(X.clean_paragraphs(F.split("text", "\n"), ["copyright", "^licensed"]), "\n")).alias("t"))


@query("s14_paywalled", """
    WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
    SELECT doc_id, len(a) < 3 OR length(array_to_string(a, ' ')) < 400 OR regexp_matches(array_to_string(a, ' '), '(?i)licensed under') AS paywalled FROM p""")
def s14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.looks_paywalled(F.split("text", "\n"), "licensed under").alias("paywalled"))


@query("s15_split_body", """
    WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(text, ' '), '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS a, list_filter(list_transform(string_split(trim(text, ' '), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS b FROM documents)
    SELECT doc_id, CASE WHEN len(a) > 1 THEN len(a) ELSE len(b) END AS n FROM p""")
def s15(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(X.split_body(F.col("text"))).cast("long").alias("n"))


@query("s16_slug_title", """
    WITH s AS (SELECT page_id, url, replace(regexp_extract(rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/'), '([^/]*)$', 1), '-', ' ') AS r FROM pages)
    SELECT page_id, CASE WHEN r = '' THEN url ELSE upper(left(r, 1)) || substr(r, 2) END AS title FROM s""")
def s16(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.slug_title(F.col("url")).alias("title"))


@query("s17_path_words", "SELECT page_id, translate(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '-/', '  ') AS words FROM pages")
def s17(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.path_words(F.col("url")).alias("words"))


@query("s20_article_url", "SELECT p_partkey, 'https://example.org/a/' || p_partkey || '/' || replace(p_name, ' ', '%20') AS url FROM part")
def s20(spark, sf):
    from newsflow.sources.json_api import article_url

    return table(spark, sf, "part").select("p_partkey", article_url("https://example.org/a/", F.col("p_name"), F.col("p_partkey").cast("string")).alias("url"))


@query("s21_numbered_base", """
    WITH u AS (SELECT doc_id, 'https://x.example.com/' || CASE WHEN doc_id % 2 = 0 THEN 'a-b-c-d' ELSE 'a-b' END || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-' || (doc_id % 150) END AS url FROM documents),
    b AS (SELECT *, regexp_extract(url, '^(.*)-\\d{1,2}$', 1) AS base FROM u)
    SELECT doc_id, CASE WHEN base <> '' AND length(regexp_replace(regexp_extract(base, '([^/]*)$', 1), '[^-]', '', 'g')) >= 3 THEN base END AS base FROM b""")
def s21(spark, sf):
    slug = F.when(F.col("doc_id") % 2 == 0, "a-b-c-d").otherwise("a-b")
    url = F.concat(F.lit("https://x.example.com/"), slug, F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.col("doc_id") % 150)))
    return table(spark, sf, "documents").select("doc_id", U.numbered_base(url).alias("base"))


@query("s22_split_sentences")
def s22(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(X.split_glued_sentences(F.replace("text", F.lit("\n"), F.lit("")))).alias("n"))


@query("s23_age_label", f"""
    WITH s AS (SELECT event_id, floor(epoch(TIMESTAMP '{AS_OF}'))::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'agora' WHEN s < 3600 THEN 'há ' || (s // 60) || ' min' WHEN s < 86400 THEN 'há ' || (s // 3600) || ' h' ELSE 'há ' || (s // 86400) || ' d' END AS age FROM s""")
def s23(spark, sf):
    return table(spark, sf, "events").select("event_id", X.age_label(F.col("ts").cast("timestamp"), now()).alias("age"))


@query("s24_window_label", "SELECT DISTINCT p_size, CASE WHEN p_size * 6 < 24 THEN (p_size * 6) || 'h' WHEN p_size * 6 = 168 THEN '7d' ELSE (p_size * 6) || 'h (' || (p_size * 6 // 24) || 'd)' END AS label FROM part")
def s24(spark, sf):
    return table(spark, sf, "part").select("p_size", X.window_label(F.col("p_size") * 6).alias("label")).distinct()


@query("s25_parse_time", "SELECT event_id, floor(epoch(ts))::BIGINT AS t FROM events")
def s25(spark, sf):
    at = F.col("ts").cast("timestamp")
    form = F.when(F.col("event_id") % 2 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("Mon, "), F.date_format(at, "d MMM yyyy HH:mm:ss Z")))
    return table(spark, sf, "events").select("event_id", seconds(X.parse_time(form)).alias("t"))


@query("s26_date_header", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%B ') || day(ts) || strftime(ts, ', %Y') AS header FROM events")
def s26(spark, sf):
    day = F.to_date(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").select(F.date_format(day, "yyyy-MM-dd").alias("day"), X.date_header(day).alias("header")).distinct()


@query("s27_host", f"SELECT page_id, {host_sql('url')} AS host, {site_sql('url')} AS site FROM pages")
def s27(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.site(F.col("url")).alias("site"))


@query("s28_json_lists", "SELECT doc_id, 2 AS n, lang AS first FROM documents")
def s28(spark, sf):
    text = F.to_json(F.array("lang", "source"))
    back = F.from_json(text, "array<string>")
    return table(spark, sf, "documents").select("doc_id", F.size(back).alias("n"), back[0].alias("first"))


@query("s30_escape", f"SELECT page_id, md5({escape_sql('html')}) AS t FROM pages")
def s30(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.escape(F.col("html"))).alias("t"))


@query("s32_take_symbol", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'neutral' WHEN 1 THEN 'positive' ELSE 'negative' END AS take FROM part")
def s32(spark, sf):
    from newsflow.plans.digest import TAKES

    names = F.create_map(*[F.lit(x) for p in TAKES.items() for x in p])
    return table(spark, sf, "part").select("p_partkey", names[F.element_at(F.array(*map(F.lit, "=+-")), (F.col("p_partkey") % 3 + 1).cast("int"))].alias("take"))


@query("s33_data_uri", "SELECT doc_id, octet_length(encode(text)) AS bytes, 'png' AS ext FROM documents WHERE octet_length(encode(text)) >= 500")
def s33(spark, sf):
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "utf-8")))
    raw = F.unbase64(F.regexp_replace(uri, "^data:[^,]*,", ""))
    ext = F.when(uri.startswith("data:image/png"), "png").when(uri.startswith("data:image/jpeg"), "jpg").otherwise("bin")
    return table(spark, sf, "documents").select("doc_id", F.octet_length(raw).cast("long").alias("bytes"), ext.alias("ext")).where("bytes >= 500")


@query("p2_window", f"WITH {ITEMS} SELECT seq FROM i WHERE published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def p2(spark, sf):
    return items(spark, sf).where(scan.within_window(F.col("published_at"), now(), 24)).select("seq")


@query("p3_listing_window", f"WITH {ITEMS} SELECT seq FROM i WHERE coalesce(published_at, TIMESTAMP '2024-01-30 12:00:00') >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def p3(spark, sf):
    return items(spark, sf).where(scan.listed_in_window(F.col("published_at"), F.lit("2024-01-30 12:00:00").cast("timestamp"), now(), 24)).select("seq")


@query("p6_recent_or_undated", f"WITH {ITEMS} SELECT seq FROM i WHERE published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR")
def p6(spark, sf):
    return items(spark, sf).where(scan.recent_or_undated(F.col("published_at"), now(), 24)).select("seq")


@query("p5_vendor_relevance", "SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY') OR regexp_matches(p_brand, '(?i)Brand#1') OR regexp_matches(p_name, '(?i)Brand#1|widget')")
def p5(spark, sf):
    from newsflow.sources.json_api import relevant

    return table(spark, sf, "part").where(relevant(F.array("p_type"), F.array("p_brand"), F.col("p_name"), ["ECONOMY"], ["Brand#1"]) | F.regexp_like("p_name", F.lit("(?i)widget"))).select("p_partkey")


@query("p7_section_denylist", "SELECT page_id FROM pages WHERE string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/')[2] NOT IN ('fr', 'es')")
def p7(spark, sf):
    section = F.get(F.split(U.part(F.col("url"), 3), "/"), F.lit(1))
    return table(spark, sf, "pages").where(~section.isin("fr", "es")).select("page_id")


@query("p8_sitemap_url", "SELECT page_id, regexp_matches(lower(url || CASE page_id % 3 WHEN 0 THEN '/news.xml' WHEN 1 THEN '/Sitemap/1' ELSE '' END), '/sitemap/|sitemap-news|news-sitemap|sitemap_news|news[.]xml') AS is_sitemap FROM pages")
def p8(spark, sf):
    from newsflow.sources.feeds import is_sitemap

    return table(spark, sf, "pages").select("page_id", is_sitemap(F.concat("url", F.element_at(F.array(F.lit("/news.xml"), F.lit("/Sitemap/1"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))).alias("is_sitemap"))


@query("p9_all_terms", f"SELECT doc_id FROM documents WHERE contains({fold_sql('text || chr(32) || source')}, 'the') AND contains({fold_sql('text || chr(32) || source')}, 'src1')")
def p9(spark, sf):
    return table(spark, sf, "documents").where(contains_all(["Thé", "src1"], F.col("text"), F.col("source"))).select("doc_id")


@query("p10_paywall_rows", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)licensed under|all rights')")
def p10(spark, sf):
    return table(spark, sf, "documents").where(F.regexp_like("text", F.lit("(?i)licensed under|all rights"))).select("doc_id")


@query("p12_clamp", "SELECT o_orderkey, greatest(1, least(720, o_custkey - 100)) AS hours FROM orders")
def p12(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", views.clamp_hours(F.col("o_custkey") - 100).alias("hours"))


@query("p13_domain_sets", f"SELECT page_id, {site_sql('url')} LIKE 'm.%' AS needs_browser, true AS supported FROM pages")
def p13(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.site(F.col("url")).startswith("m.").alias("needs_browser"), F.lit(True).alias("supported"))


@query("a8_sector_score", """
    WITH s AS (SELECT p_partkey, len(list_filter(['widget', 'ring'], lambda t: contains(lower(p_name), t))) + CASE WHEN p_brand IN ('Brand#1') THEN 1 ELSE 0 END AS a,
                      len(list_filter(['bolt', 'red', 'small'], lambda t: contains(lower(p_name), t))) AS b FROM part)
    SELECT p_partkey, a, b, CASE WHEN greatest(a, b) = 0 THEN 'other' WHEN a >= b THEN 'a' ELSE 'b' END AS sector FROM s""")
def a8(spark, sf):
    scores = sector_scores(F.col("p_name"), F.array("p_brand"), {"a": ["widget", "ring", "brand#1"], "b": ["bolt", "red", "small"]})
    return table(spark, sf, "part").select("p_partkey", *[s.cast("long").alias(n) for n, s in scores.items()], best_sector(scores, "other").alias("sector"))


@query("t9_clamp_future", f"SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-15 00:05:00' THEN floor(epoch(TIMESTAMP '2024-01-15 00:00:00'))::BIGINT ELSE floor(epoch(ts))::BIGINT END AS t FROM events")
def t9(spark, sf):
    at = scan.clamp_future(F.col("ts").cast("timestamp"), F.lit("2024-01-15 00:00:00").cast("timestamp"), 5)
    return table(spark, sf, "events").select("event_id", seconds(at).alias("t"))


@query("h9_page_title", f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def h9(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.page_title(F.col("html")).alias("title"))
