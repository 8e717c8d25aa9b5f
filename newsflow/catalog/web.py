"""Queries over stored pages and payloads: sources, HTML operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from newsflow import schemas
from newsflow.catalog.base import AS_OF, TITLE_SQL, canonical_sql, escape_sql, host_sql, now, page_items, query, seconds, site_sql, table, text_sql, unescape_sql
from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.sources import documents, encodings, feeds, json_api

REGISTRY = {"rss": {"a.example.com": ["https://a.example.com/rss", "https://a.example.com/rss2"]}, "sitemap": {"b.example.com": ["https://b.example.com/sitemap.xml"]}, "homepage": {"c.example.com": ["https://c.example.com/"]}}


@query("r1_feed_registry", "SELECT * FROM (VALUES ('rss', 'a.example.com', 'https://a.example.com/rss'), ('rss', 'a.example.com', 'https://a.example.com/rss2'), ('sitemap', 'b.example.com', 'https://b.example.com/sitemap.xml'), ('homepage', 'c.example.com', 'https://c.example.com/')) AS v(kind, domain, url)")
def r1(spark, sf):
    return feeds.registry(spark, REGISTRY)


def entry_payloads(spark, sf):
    """Each page as an RSS item."""
    p = table(spark, sf, "pages")
    title = F.concat(H.page_title(F.col("html")), F.lit(" - Example Source"))
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), X.escape(c), F.lit(f"</{n}>"))
    date = F.date_format(now() - F.make_dt_interval(hours=(F.col("page_id") % 100).cast("int")), "d MMM yyyy HH:mm:ss Z")
    link = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://news.example.org/articles/"), F.col("page_id")))
    xml = F.concat(F.lit("<item>"), tag("title", title), tag("link", link), tag("description", F.lit("text")), tag("pubDate", F.concat(F.lit("Tue, "), date)), F.lit('<source url="https://s.example.net/feed">S</source></item>'))
    return p.select(F.col("page_id").alias("seq"), F.lit("feed.example.com").alias("feed_domain"), xml.alias("xml"))


ENTRIES = f"""
    SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN {canonical_sql('url')} ELSE 'https://news.example.org/articles/' || page_id END AS url,
           CASE WHEN page_id % 2 = 0 THEN trim({TITLE_SQL} || ' - Example Source') ELSE {TITLE_SQL} END AS title, 'text' AS summary,
           floor(epoch(TIMESTAMP '{AS_OF}' - to_hours(CAST(page_id % 100 AS INT))))::BIGINT AS published,
           CASE WHEN page_id % 2 = 0 THEN {host_sql(canonical_sql('url'))} ELSE 's.example.net' END AS source_domain FROM pages"""


@query("r2_rss_scan", ENTRIES)
def r2(spark, sf):
    items = feeds.items_of_entries(feeds.entries(entry_payloads(spark, sf)))
    return items.select("seq", "url", "title", "summary", seconds("published_at").alias("published"), "source_domain")


def feed_documents(spark, sf, size=20):
    """The items of entry_payloads as whole feeds of up to `size` pages; every third feed breaks off inside its last item."""
    feed = F.floor(F.col("seq") / size).cast("long").alias("seq")
    items = entry_payloads(spark, sf).groupBy(feed, "feed_domain").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").alias("n"), "xml"))).alias("items"))
    body = F.array_join(F.transform("items", lambda i: i["xml"]), "\n")
    whole = F.when(F.col("seq") % 3 == 2, F.left(body, F.length(body) - 10)).otherwise(F.concat(body, F.lit("</channel></rss>")))
    return items.select("seq", "feed_domain", F.concat(F.lit('<?xml version="1.0"?><rss><channel><title>Feed</title><link>https://feed.example.com</link>'), whole).alias("xml"))


@query(
    "r2_whole_feeds",
    f"""WITH e AS ({ENTRIES}),
        f AS (SELECT *, seq // 20 AS feed, row_number() OVER (PARTITION BY seq // 20 ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY seq // 20) AS n FROM e)
        SELECT feed, pos::INT AS pos, url, title, summary, published, source_domain FROM f WHERE feed % 3 <> 2 OR pos < n - 1""",
)
def r2_whole(spark, sf):
    items = documents.feed_items(feed_documents(spark, sf))
    return items.select(F.col("seq.document").alias("feed"), F.col("seq.pos").alias("pos"), "url", "title", "summary", seconds("published_at").alias("published"), "source_domain")


def sitemap_documents(spark, sf, size=50):
    """Sitemaps of up to `size` pages for each of five sites, and the sites' indexes, which name them in order."""
    rows = sitemap_urls(spark, sf).select(F.concat(F.lit("f"), F.col("seq") % 5).alias("feed_domain"), F.floor(F.col("seq") / size).cast("long").alias("page"), "seq", "loc", "lastmod")
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), X.escape(c), F.lit(f"</{n}>"))
    url = F.concat(F.lit("<url>"), tag("loc", F.col("loc")), F.coalesce(tag("lastmod", F.col("lastmod")), F.lit("")), F.lit("</url>"))
    at = F.concat(F.lit("https://"), "feed_domain", F.lit(".example.com/posts-post-"), "page", F.lit(".xml"))
    joined_ = lambda order, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), x.alias("x")))), lambda r: r["x"]), "")
    pages = rows.groupBy("feed_domain", "page").agg(joined_("seq", url).alias("urls"))
    pages = pages.select(at.alias("url"), (F.col("page") + 1).alias("seq"), "feed_domain", F.concat(F.lit('<urlset xmlns="s">'), "urls", F.lit("</urlset>")).alias("xml"))
    listed = rows.select("feed_domain", "page").distinct().groupBy("feed_domain").agg(joined_("page", F.concat(F.lit("<s:sitemap>"), tag("s:loc", at), F.lit("</s:sitemap>"))).alias("pages"))
    tail = F.lit("<s:sitemap><s:loc>https://x.example.com/authors.xml</s:loc></s:sitemap></s:sitemapindex>")
    index = listed.select(F.concat(F.lit("https://"), "feed_domain", F.lit(".example.com/sitemap.xml")).alias("url"), F.lit(0).cast("long").alias("seq"), "feed_domain", F.concat(F.lit('<s:sitemapindex xmlns:s="s">'), "pages", tail).alias("xml"))
    return pages.unionByName(index)


@query(
    "r5_whole_sitemaps",
    f"""WITH p AS (SELECT *, page_id % 5 AS f, max(page_id // 50) OVER (PARTITION BY page_id % 5) AS last FROM pages)
        SELECT 'f' || f AS feed_domain, {canonical_sql('url')} AS url FROM p WHERE page_id // 50 = last AND page_id % 9 <> 0 AND page_id % 150 <= 96""",
)
def r5_whole(spark, sf):
    return documents.standard_sitemap(sitemap_documents(spark, sf), now()).select("feed_domain", "url")


@query("r3_entry_domain", f"SELECT source_domain, count(*) AS n FROM ({ENTRIES}) GROUP BY source_domain")
def r3(spark, sf):
    return feeds.items_of_entries(feeds.entries(entry_payloads(spark, sf))).groupBy("source_domain").agg(F.count("*").alias("n"))


@query("r4_news_sitemap", f"SELECT page_id AS seq, {canonical_sql('url')} AS url, {TITLE_SQL} AS title, floor(epoch(TIMESTAMP '{AS_OF}' - to_hours(CAST(page_id % 100 AS INT))))::BIGINT AS published FROM pages")
def r4(spark, sf):
    date = F.date_format(now() - F.make_dt_interval(hours=(F.col("page_id") % 100).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    xml = F.concat(F.lit("<url><loc>"), X.escape(F.col("url")), F.lit("</loc><news:news><news:title>"), X.escape(H.page_title(F.col("html"))), F.lit("</news:title><news:publication_date>"), date, F.lit("</news:publication_date></news:news></url>"))
    payloads = table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.lit("f").alias("feed_domain"), xml.alias("xml"))
    return feeds.news_sitemap(payloads).select("seq", "url", "title", seconds("published_at").alias("published"))


def sitemap_urls(spark, sf):
    lastmod = F.when(F.col("page_id") % 9 != 0, F.date_format(now() - F.make_dt_interval(hours=(F.col("page_id") % 150).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("loc"), lastmod.alias("lastmod"), F.lit("f").alias("feed_domain"))


@query("r5_standard_sitemap", f"SELECT page_id AS seq, {canonical_sql('url')} AS url FROM pages WHERE page_id % 9 <> 0 AND page_id % 150 <= 96")
def r5(spark, sf):
    return feeds.sitemap(sitemap_urls(spark, sf), now()).select("seq", "url")


@query("r5_last_sitemap_page", "SELECT 'f' || (page_id % 5) AS feed_domain, 'https://x.example.com/posts-post-' || max(page_id) || '.xml' AS loc FROM pages WHERE page_id % 3 = 0 GROUP BY 1")
def r5b(spark, sf):
    kind = F.when(F.col("page_id") % 3 == 0, "posts-post-").otherwise("pages-")
    index = table(spark, sf, "pages").select(F.concat(F.lit("f"), F.col("page_id") % 5).alias("feed_domain"), F.col("page_id").alias("pos"), F.concat(F.lit("https://x.example.com/"), kind, F.col("page_id"), F.lit(".xml")).alias("loc"))
    return feeds.last_page(index)


@query("r7_daily_sitemaps", f"""
    WITH p AS (SELECT page_id AS seq, {canonical_sql('url')} AS url, TIMESTAMP '{AS_OF}' - to_hours(CAST(page_id % 100 AS INT)) AS t FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM p WHERE t >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND t::DATE >= DATE '2024-01-28' AND string_split(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/')[2] <> 'de')
    SELECT seq, url FROM r WHERE n = 1""")
def r7(spark, sf):
    rows = page_items(spark, sf).withColumn("published_at", now() - F.make_dt_interval(hours=(F.col("seq") % 100).cast("int"))).withColumn("day", F.to_date("published_at"))
    return feeds.daily_partitions(rows, now(), 3, ("de",)).select("seq", "url")


@query("r8_suffix_sitemap", f"SELECT page_id AS seq, {canonical_sql('url')} AS url FROM pages WHERE (page_id % 9 = 0 OR page_id % 150 <= 72) AND {canonical_sql('url')} LIKE '%.html'")
def r8(spark, sf):
    return feeds.sitemap(sitemap_urls(spark, sf), now(), 72, keep_undated=True, suffix=".html").select("seq", "url")


@query("r6_page_links")
def r6(spark, sf):
    return feeds.page_links(table(spark, sf, "pages"), min_hyphens=0).select("seq", "url", "feed_domain")


@query("r6_hrefs", f"""
    WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1), lambda h: trim({unescape_sql('h')})) AS hrefs FROM pages)
    SELECT page_id, len(hrefs) AS n, md5(array_to_string(hrefs, chr(10))) AS digest FROM l""")
def r6b(spark, sf):
    found = H.links(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "\n")).alias("digest"))


@query("r9_listing_cards", "SELECT page_id AS page, 'T' || page_id AS title, '/x-' || page_id AS href, 'excerpt' AS excerpt, floor(epoch(TIMESTAMP '{AS_OF}'))::BIGINT AS published FROM pages".replace("{AS_OF}", AS_OF))
def r9(spark, sf):
    card = F.concat(F.lit('<div><article class="article"><h2 class="t"><a href="/x-'), F.col("page_id"), F.lit('">T'), F.col("page_id"), F.lit('</a></h2><time datetime="2024-01-31T00:00:00Z">x</time><p>excerpt</p></article></div>'))
    cards = feeds.listing_cards(table(spark, sf, "pages").select(F.col("page_id").alias("page"), card.alias("html")))
    return cards.select("page", "title", "href", "excerpt", seconds("published_at").alias("published"))


@query("r10_json_items_a", f"""
    WITH d AS (SELECT *, row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) AS n FROM documents)
    SELECT (doc_id // 2)::VARCHAR AS id, source AS title, lang AS sectors, trim(text) || chr(10) || lang AS body FROM d WHERE n = 1""")
def r10(spark, sf):
    item = F.struct(F.floor(F.col("doc_id") / 2).cast("string").alias("Id"), F.col("source").alias("Headline"), F.array("lang").alias("Sector"), F.col("text").alias("Summary"), F.col("lang").alias("BodyText"))
    payloads = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.to_json(F.struct(F.array(item).alias("Items"))).alias("json"))
    return json_api.items_a(payloads).select("id", "title", F.array_join("sectors", ",").alias("sectors"), "body")


@query("r11_json_items_b", "SELECT doc_id::VARCHAR AS id, source AS title, lang AS body, floor(epoch(TIMESTAMP '2024-01-30 00:00:00'))::BIGINT AS published FROM documents")
def r11(spark, sf):
    article = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("content"), F.lit("2024-01-30T00:00:00Z").alias("publishedDate"))
    root = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("newsArticle").alias("type"), article.alias("newsArticle"))).alias("values")).alias("result")))
    payloads = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 2 == 0, root).otherwise(F.concat(F.lit("["), root, F.lit("]"))).alias("json"))
    return json_api.items_b(payloads).select("id", "title", "body", seconds("published_at").alias("published"))


@query("r12_report_cache", "WITH d AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY user_id) SELECT row_number() OVER (ORDER BY e) AS rank, user_id::VARCHAR AS uuid FROM d ORDER BY e LIMIT 10")
def r12(spark, sf):
    report = F.struct(F.col("user_id").cast("string").alias("uuid"), F.lit("t").alias("title"), F.lit("/h").alias("href"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", report.alias("r")))), lambda x: x["r"])
    # a file of the cache holds a thousand events, so none grows with the table
    parts = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("part"))
    cache = parts.agg(F.to_json(F.struct(F.lit("now").alias("captured_at"), listed.alias("reports"))).alias("json"))
    return json_api.reports(cache).select("rank", "uuid")


@query("r13_url_list", "SELECT url, 'b' || page_id AS body FROM pages WHERE page_id % 2 = 0")
def r13(spark, sf):
    rows = table(spark, sf, "pages").select(F.concat(F.lit("b"), F.col("page_id")).alias("Texto"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "url")).otherwise("none").alias("URL"))
    return feeds.url_list(rows).select("url", "body")


@query("r14_search_urls", "SELECT p_partkey, 'https://news.example.org/rss?q=%28widget+OR+%22' || replace(p_name, ' ', '+') || '%22%29+%28site%3Aexample.com%29+when%3A' || CASE WHEN p_size <= 48 THEN p_size || 'h' ELSE ((p_size + 23) // 24) || 'd' END AS url FROM part")
def r14(spark, sf):
    return table(spark, sf, "part").select("p_partkey", U.search_url("https://news.example.org/rss", F.array(F.lit("widget"), F.col("p_name")), F.array(F.lit("example.com")), F.col("p_size")).alias("url"))


@query("r19_resolved_links", f"SELECT page_id AS seq, CASE WHEN page_id % 2 = 0 THEN 'https://t.example.net/' || page_id ELSE {canonical_sql('url')} END AS url FROM pages")
def r19(spark, sf):
    items = page_items(spark, sf).withColumn("url", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("https://news.example.org/"), "seq")).otherwise(F.col("url")))
    mapping = items.where("seq % 2 = 0").select(F.col("url").alias("wrapped"), F.concat(F.lit("https://t.example.net/"), "seq").alias("target"))
    return feeds.resolved(items, mapping).select("seq", "url")


@query("r20_unwrapped_redirects", "SELECT page_id, url FROM pages")
def r20(spark, sf):
    wrapped = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://redir.example.org/r/*"), "url")).otherwise(F.concat(F.lit("https://redir.example.org/?url="), F.url_encode("url")))
    return table(spark, sf, "pages").select("page_id", U.unwrap_redirect(wrapped, ("redir.example.org",)).alias("url"))


@query("r22_decoded_pages", "SELECT page_id, md5(html) AS t FROM pages")
def r22(spark, sf):
    raw = F.when(F.col("page_id") % 2 == 0, F.encode("html", "utf-8")).otherwise(F.encode("html", "utf-16"))
    return table(spark, sf, "pages").select("page_id", F.md5(feeds.decoded_page(raw, F.when(F.col("page_id") % 2 == 0, "utf-8").otherwise("utf-16"))).alias("t"))


@query("r22_detected_pages", "SELECT page_id, md5(html) AS t FROM pages")
def r22_detected(spark, sf):
    """Pages in five encodings that nothing declares (UTF-8 where one cannot hold them), found by a profile of documents."""
    pages = ["cp1252", "cp850", "mac_roman"]

    @F.pandas_udf("binary")
    def encoded(html: pd.Series, number: pd.Series) -> pd.Series:
        names = [*pages, "utf-8", "utf-16-le"]
        raw = (None if t is None else encodings.encoded(t, names[n % 5]) or t.encode() for t, n in zip(html, number, strict=True))
        return pd.Series(list(raw), dtype=object)

    detect = encodings.detector(encodings.profile(table(spark, sf, "documents"), "text", pages), pages)
    raw = table(spark, sf, "pages").select("page_id", encoded("html", "page_id").alias("raw"))
    return raw.select("page_id", F.md5(detect(F.col("raw"))["text"]).alias("t"))


@query("s18_report_title", "SELECT s_suppkey, s_name AS title FROM supplier")
def s18(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", json_api.report_title(F.concat(F.lit("Report: "), "s_name"), "Report").alias("title"))


@query("s19_document_link", "SELECT page_id, 'https://x.example.com/d/' || page_id || '.pdf' AS pdf FROM pages")
def s19(spark, sf):
    page = F.concat(F.lit('<a href="/d/'), F.col("page_id"), F.lit('.pdf">x</a>'))
    return table(spark, sf, "pages").select("page_id", json_api.document_link(page, F.lit("https://x.example.com/a/b")).alias("pdf"))


# ---- HTML -------------------------------------------------------------------


@query("h1_sanitize")
def h1(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.sanitize("html").alias("html"))


LINES = "list_transform(string_split(regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda l: trim(l, ' '))"


@query("h2_strip_to_safe", f"""
    WITH a AS (SELECT page_id, {unescape_sql("regexp_replace(regexp_replace(regexp_replace(html, '(?i)</?(?:p|div|h[1-6]|li|blockquote)(?:[ \\t\\n][^>]*)?>', chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')")} AS t FROM pages),
    b AS (SELECT page_id, list_filter({LINES.format(x='t')}, lambda l: length(l) > 10) AS l FROM a)
    SELECT page_id, md5(array_to_string(list_transform(l, lambda x: '<p>' || {escape_sql('x')} || '</p>'), chr(10))) AS t FROM b""")
def h2(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(H.strip_to_safe(F.regexp_replace("html", "<img[^>]*>", ""))).alias("t"))


@query("h3_container")
def h3(spark, sf):
    pages = table(spark, sf, "pages")
    rules = {"therin.example.net": {"selectors": ["div.content"], "remove": ["div.ad"], "stop": r"^\s*more\s+news\b"}}
    return pages.select("page_id", H.extract_container(F.col("html"), U.site(F.col("url")), rules).alias("html"))


@query("h4_text_to_html", f"""
    WITH t AS (SELECT doc_id, regexp_replace(trim(text, ' '), '\\n{{3,}}', chr(10) || chr(10), 'g') AS b FROM documents),
    p AS (SELECT doc_id, CASE WHEN contains(b, chr(10) || chr(10)) THEN list_transform(string_split(b, chr(10) || chr(10)), lambda k: array_to_string(list_filter({LINES.format(x='k')}, lambda l: l <> ''), ' ')) ELSE {LINES.format(x='b')} END AS a FROM t)
    SELECT doc_id, md5(array_to_string(list_transform(list_filter(a, lambda x: length(x) > 5), lambda x: '<p>' || {escape_sql('x')} || '</p>'), chr(10))) AS t FROM p""")
def h4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(H.text_to_html(F.col("text"))).alias("t"))


@query("h5_highlights", f"""
    WITH t AS (SELECT doc_id, list_filter({LINES.format(x='text')}, lambda l: length(l) > 5) AS h, list_filter({LINES.format(x='text')}, lambda l: length(l) > 5) AS b FROM documents)
    SELECT doc_id, md5(array_to_string(list_concat(CASE WHEN len(h) > 0 THEN ['<ul>' || array_to_string(list_transform(h, lambda x: '<li>' || {escape_sql('x')} || '</li>'), '') || '</ul>'] ELSE [] END, list_transform(b, lambda x: '<p>' || {escape_sql('x')} || '</p>')), chr(10))) AS t FROM t""")
def h5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(H.highlights_to_html(F.col("text"), F.col("text"))).alias("t"))


@query("h6_dom_items", f"SELECT p_partkey, '<p>' || {escape_sql('p_name')} || '</p>' || chr(10) || '<ul><li>' || p_type || '</li></ul>' || chr(10) || '<img src=\"https://x.example.com/' || p_partkey || '\" alt=\"a\" class=\"reader-img\">' AS html FROM part")
def h6(spark, sf):
    json = F.concat(F.lit('[{"t":"p","v":"'), "p_name", F.lit('"},{"t":"ul","lis":["'), "p_type", F.lit('"," "]},{"t":"img","src":"http://no"},{"t":"h3","v":" "},{"t":"img","src":"https://x.example.com/'), F.col("p_partkey"), F.lit('","alt":"a"}]'))
    return table(spark, sf, "part").select("p_partkey", H.dom_items_to_html(F.from_json(json, schemas.DOM_ITEMS)).alias("html"))


@query("h7_cut_related", "SELECT page_id, length(rtrim(html)) AS n FROM pages")
def h7(spark, sf):
    more = F.lit("<h3>Related articles</h3><p>other</p>")
    return table(spark, sf, "pages").select("page_id", F.length(H.cut_related(F.concat("html", more, "html"))).cast("long").alias("n"))


@query("h8_blocks")
def h8(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(H.blocks(H.sanitize("html"))).alias("n", "b")).select("page_id", "n", "b.*")


@query("h10_metadata", "SELECT page_id, 'about ' || page_id AS description, floor(epoch(TIMESTAMP '2024-01-30 10:00:00'))::BIGINT AS published FROM pages")
def h10(spark, sf):
    at = "2024-01-30T10:00:00Z"
    forms = F.array(F.lit(f'<meta property="article:published_time" content="{at}">'), F.lit(f'<meta content="{at}" name="date">'), F.lit(f'<script type="application/ld+json">{{"@type":"X","datePublished":"{at}"}}</script>'), F.lit(f'<time datetime="{at}">x</time>'))
    html = F.concat(F.get(forms, (F.col("page_id") % 4).cast("int")), F.lit('<meta name="description" content="about '), F.col("page_id"), F.lit('">'), "html")
    return table(spark, sf, "pages").select("page_id", H.page_description(html).alias("description"), seconds(H.page_published(html)).alias("published"))


@query("h11_container_paragraphs")
def h11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(H.container_paragraphs("html")).alias("n", "text"))


@query("h21_paragraphs", f"""
    WITH a AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?is)<p\\b[^>]*>(.*?)</p>', 1) AS p FROM pages)
    SELECT page_id, md5(array_to_string(list_filter(list_transform(p, lambda x: {text_sql('x')}), lambda x: length(x) > 40)[1:20], chr(10))) AS t FROM a""")
def h21(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(F.array_join(F.slice(H.paragraph_texts(F.col("html"), 40), 1, 20), "\n")).alias("t"))


@query("h12_extract_and_clean")
def h12(spark, sf):
    pages = table(spark, sf, "pages").withColumn("paragraphs", H.container_paragraphs("html"))
    return pages.select("page_id", X.clean_title(H.page_title(F.col("html")), ["Example"]).alias("title"), F.size(X.clean_paragraphs(F.col("paragraphs"), ["^copyright"])).alias("n"))


@query("h17_dom_walk")
def h17(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(H.dom_walk("html")).alias("n", "x")).select("page_id", "n", "x.t", "x.v")


@query("h18_container_counts", "SELECT page_id, len(regexp_extract_all(html, '(?i)<p\\b')) AS n FROM pages ORDER BY n DESC, page_id LIMIT 10")
def h18(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?i)<p\b"), F.lit(0))).cast("long").alias("n")).orderBy(F.desc("n"), "page_id").limit(10)


@query("h19_display_paragraphs", f"SELECT doc_id, len(list_filter({LINES.format(x='text')}, lambda l: length(l) > 20)) AS n FROM documents WHERE NOT contains(text, chr(10) || chr(10))")
def h19(spark, sf):
    plain = table(spark, sf, "documents").where(~F.contains("text", F.lit("\n\n")))
    return plain.select("doc_id", F.size(F.filter(X.split_body(F.col("text")), lambda p: F.length(p) > 20)).cast("long").alias("n"))


@query("h20_lede_and_body", "SELECT doc_id, array_to_string(list_filter([string_split(text, chr(10))[1], text], lambda x: length(x) >= 80), chr(10)) AS body FROM documents WHERE NOT regexp_matches(text, '(?i)licensed')")
def h20(spark, sf):
    parts = F.filter(F.array(F.get(F.split("text", "\n"), F.lit(0)), F.col("text")), lambda x: F.length(x) >= 80)
    return table(spark, sf, "documents").where(~F.regexp_like("text", F.lit("(?i)licensed"))).select("doc_id", F.array_join(parts, "\n").alias("body"))


@query("h22_headline_choice", f"SELECT page_id, CASE WHEN length({text_sql('h')}) > 10 THEN {text_sql('h')} ELSE {TITLE_SQL} END AS title FROM (SELECT *, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages)")
def h22(spark, sf):
    h1 = X.html_to_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return table(spark, sf, "pages").select("page_id", F.when(F.length(h1) > 10, h1).otherwise(H.page_title(F.col("html"))).alias("title"))


@query("j7_site_counts", f"SELECT {site_sql('url')} AS site, count(*) AS n FROM pages GROUP BY 1")
def sites(spark, sf):
    return table(spark, sf, "pages").groupBy(U.site(F.col("url")).alias("site")).agg(F.count("*").alias("n"))
