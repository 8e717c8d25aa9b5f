"""Feeds, sitemaps, listings and stored pages as tables of raw items (schemas.RAW_ITEM)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.functions import html as H
from newsflow.functions import text as X
from newsflow.functions import urls as U

ENTRY = "title string, link string, summary string, description string, pubDate string, published string, updated string, source struct<_VALUE:string,_url:string>"
SITEMAP_URL = "loc string, lastmod string, `news:news` struct<`news:title`:string,`news:publication_date`:string>"


def registry(spark: SparkSession, kinds: dict[str, dict[str, list[str]]]) -> DataFrame:
    """kind, domain, url from {kind: {domain: [urls]}}."""
    rows = [(k, by) for k, by in kinds.items()]
    return spark.createDataFrame(rows, "kind string, by map<string,array<string>>").select("kind", F.explode("by").alias("domain", "urls")).select("kind", "domain", F.explode("urls").alias("url"))


#: Parts of the URLs of news sitemaps.
SITEMAP_MARKS = ("/sitemap/", "sitemap-news", "news-sitemap", "sitemap_news", "news.xml")


def is_sitemap(url: Column) -> Column:
    return F.exists(F.array(*map(F.lit, SITEMAP_MARKS)), lambda mark: F.contains(F.lower(url), mark))


def entries(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    """payloads (feed_domain, seq, xml: one item) with the parsed entry; unreadable payloads have a null entry."""
    return payloads.withColumn("entry", F.from_xml(F.col(xml), ENTRY, {"mode": "PERMISSIVE"}))


def items_of_entries(parsed: DataFrame, aggregator_host: str = "news.example.org", wrapper_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Raw items: links unwrapped and canonical, summary or else description; an aggregator's items carry the domain of their source and lose
    the " - Source" end of their titles (under 60 characters). Entries without a link drop out."""
    e = lambda f: F.trim(F.coalesce(F.col(f"entry.{f}"), F.lit("")))
    url = U.canonical(U.unwrap_redirect(e("link"), wrapper_hosts))
    summary = F.when(e("summary") != "", e("summary")).otherwise(e("description"))
    published = F.coalesce(*[X.parse_time(F.col(f"entry.{f}")) for f in ("published", "pubDate", "updated")])
    aggregated = U.host(url).endswith(aggregator_host)
    source = U.host(F.coalesce(F.col("entry.source._url"), F.lit("")))
    tail = F.regexp_extract(e("title"), r"(?s)^(.+) - (.*?)$", 2)
    base = F.regexp_extract(e("title"), r"(?s)^(.+) - (.*?)$", 1)
    title = F.when(aggregated & (base != "") & (F.length(tail) < 60), F.trim(base)).otherwise(e("title"))
    domain = F.when(aggregated & (source != ""), source).when(U.host(url) != "", U.host(url)).otherwise(F.col("feed_domain"))
    return parsed.where(e("link") != "").select("seq", url.alias("url"), title.alias("title"), summary.alias("summary"), published.alias("published_at"), domain.alias("source_domain"), "feed_domain")


def news_sitemap(payloads: DataFrame, xml: str = "xml") -> DataFrame:
    """Raw items of url elements with news titles and dates; no summaries."""
    parsed = payloads.withColumn("u", F.from_xml(F.col(xml), SITEMAP_URL))
    url = U.canonical(F.trim("u.loc"))
    news = F.col("u")["news:news"]
    return parsed.where(F.trim(F.coalesce("u.loc", F.lit(""))) != "").select("seq", url.alias("url"), F.trim(F.coalesce(news["news:title"], F.lit(""))).alias("title"), F.lit("").alias("summary"), X.parse_time(news["news:publication_date"]).alias("published_at"), F.coalesce(F.nullif(U.host(url), F.lit("")), F.col("feed_domain")).alias("source_domain"), "feed_domain")


def sitemap(urls: DataFrame, as_of: Column, hours: int = 96, keep_undated: bool = False, suffix: str | None = None) -> DataFrame:
    """urls (seq, loc, lastmod, feed_domain) as raw items with a date within the hours; of .../slug and .../slug-N in one file only the first."""
    from newsflow.operators.dedupe import drop_numbered

    rows = urls.where(F.trim(F.coalesce("loc", F.lit(""))) != "").withColumn("url", U.canonical(F.trim("loc"))).withColumn("published_at", X.parse_time(F.col("lastmod")))
    rows = drop_numbered(rows, rows.limit(0))
    recent = F.col("published_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))
    rows = rows.where(recent | F.col("published_at").isNull() if keep_undated else recent)
    if suffix:
        rows = rows.where(F.col("url").endswith(suffix))
    return rows.select("seq", "url", F.lit("").alias("title"), F.lit("").alias("summary"), "published_at", U.host(F.col("url")).alias("source_domain"), "feed_domain")


def last_page(index: DataFrame, marker: str = "posts-post-") -> DataFrame:
    """Of a sitemap index (feed_domain, pos, loc) the last page that holds posts."""
    return index.where(F.contains("loc", F.lit(marker))).groupBy("feed_domain").agg(F.max_by(F.trim("loc"), "pos").alias("loc"))


def daily_partitions(table: DataFrame, as_of: Column, days: int = 3, skip_sections: tuple[str, ...] = (), hours: int = 72, day: str = "day") -> DataFrame:
    """Rows (seq, day, url, published_at) of the last partitions, first seen by URL; the day filter prunes partitions."""
    from newsflow.operators.dedupe import first_seen

    recent = table.where(F.col(day) >= F.date_sub(F.to_date(as_of), days))
    section = F.element_at(F.split(U.part(F.col("url"), 3), "/"), 2)
    kept = recent.where(~F.coalesce(section.isin(*skip_sections), F.lit(False)) if skip_sections else F.lit(True))
    return first_seen(kept.where(F.col("published_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))), "url")


#: Path segments of pages that list articles.
LISTING_SEGMENTS = ("category", "tag", "tags", "colunista", "dados", "autor", "author", "page", "search", "busca", "feed", "amp", "print", "rss")


def page_links(pages: DataFrame, min_hyphens: int = 2) -> DataFrame:
    """Raw items from the links of stored pages (page_id, url, html): same site, not inside a listing segment, a slug of enough hyphens; each once, by first page."""
    from newsflow.operators.dedupe import first_seen

    site = U.site(F.col("url"))
    found = pages.select("page_id", site.alias("feed_domain"), F.col("url").alias("page"), F.posexplode(H.links(F.col("html"))).alias("pos", "href"))
    found = found.withColumn("to", U.absolute(F.col("href"), F.col("page"))).where("to is not null").where(U.site(F.col("to")) == F.col("feed_domain"))
    segments = F.filter(F.split(U.part(F.col("to"), 3), "/"), lambda s: s != "")
    inner = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    hyphens = F.length(F.regexp_replace(F.coalesce(F.get(segments, F.size(segments) - 1), F.lit("")), "[^-]", ""))
    kept = found.where((F.size(segments) >= 1) & ~F.arrays_overlap(inner, F.array(*map(F.lit, LISTING_SEGMENTS))) & (hyphens >= min_hyphens))
    rows = kept.select((F.col("page_id") * 100000 + F.col("pos")).alias("seq"), U.canonical(F.col("to")).alias("url"), F.lit("").alias("title"), F.lit("").alias("summary"), F.lit(None).cast("timestamp").alias("published_at"), U.host(F.col("to")).alias("source_domain"), "feed_domain")
    return first_seen(rows, "url")


def listing_cards(pages: DataFrame) -> DataFrame:
    """Cards of listing pages (page, html): position, title, href, time, excerpt."""
    parts = F.regexp_extract_all("html", F.lit(r"(?is)<article\b[^>]*>(.*?)</article>"), F.lit(1))
    rows = pages.select("page", F.posexplode(parts).alias("pos", "card"))
    get = lambda p, i=1: F.regexp_extract("card", p, i)
    return rows.select("page", "pos", X.html_to_text(get(r"(?is)<h2[^>]*>.*?<a\b[^>]*>(.*?)</a>")).alias("title"), get(r"""(?is)<h2[^>]*>.*?<a\b[^>]*href=["']([^"']*)["']""").alias("href"), X.parse_time(get(r"""(?is)<time\b[^>]*datetime=["']([^"']*)["']""")).alias("published_at"), X.html_to_text(get(r"(?is)<p\b[^>]*>(.*?)</p>")).alias("excerpt"))


def url_list(table: DataFrame) -> DataFrame:
    """pos, url, body of a table of URLs: the column named url, or else the first; corpo, body or texto as body; http URLs only."""
    names = {c.lower().strip(): c for c in table.columns}
    url = F.trim(F.col(f"`{names.get('url', table.columns[0])}`").cast("string"))
    body = next((F.col(f"`{names[n]}`").cast("string") for n in ("corpo", "body", "texto") if n in names), F.lit(None).cast("string"))
    rows = table.withColumn("__pos", F.monotonically_increasing_id())
    return rows.select(F.col("__pos").alias("pos"), url.alias("url"), body.alias("body")).where(F.col("url").startswith("http"))


def resolved(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items with wrapped URLs replaced by those that a mapping (wrapped, target) knows."""
    joined = items.join(mapping.select(F.col("wrapped").alias("url"), "target"), "url", "left")
    return joined.withColumn("url", F.coalesce("target", "url")).withColumn("source_domain", F.when(F.col("target").isNotNull(), U.host(F.col("target"))).otherwise(F.col("source_domain"))).drop("target")


def decoded_page(raw: Column, declared: Column) -> Column:
    """Text of page bytes: UTF-8 if they are, else in the declared charset (Latin-1 by default)."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).when(F.lower(declared) == "utf-16", F.decode(raw, "utf-16")).otherwise(F.decode(raw, "iso-8859-1"))
