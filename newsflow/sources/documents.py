"""Feeds and sitemaps as whole documents: a row for each document in, raw items out.

A document is cut into its elements (item, entry, url, sitemap) before anything is parsed, so one that breaks off still gives all elements that are
complete, and one unreadable element costs no other. Elements are then parsed one a row with `from_xml`. Everything is built in; a document is
read whole, its items go on as rows.

Defined results: prefixes of elements (atom:entry, ns0:url) are dropped where the element itself has one; CDATA is text; references that XML does not know stay
as HTML's; null, empty and foreign documents have no elements; `seq` becomes the pair of the document's number and the element's place, which orders
all elements without a bound on either; an index whose last page is not among the documents gives no URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.sources import feeds

_LINK = "array<struct<_VALUE:string,_href:string,_rel:string>>"
#: What is read of an RSS item or an Atom entry.
ENTRY = f"title string, link {_LINK}, summary string, description string, content string, pubDate string, published string, updated string, date string, source struct<_VALUE:string,_url:string>"


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as documents: url (the file's path) and xml. A file is one row, as a feed or a page of a sitemap is bounded by what sites serve."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("xml"))


def element_files(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag in large XML files, which are split between tasks."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _plain(xml: Column) -> Column:
    """CDATA as escaped text, comments dropped, references unknown to XML escaped."""
    parts = F.split(xml, r"<!\[CDATA\[", -1)

    def part(p: Column, i: Column) -> Column:
        end = F.locate("]]>", p)
        inside = F.when(end > 0, F.substring(p, F.lit(1), end - 1)).otherwise(p)
        after = F.when(end > 0, F.substring(p, end + 3, F.length(p))).otherwise("")
        return F.when(i == 0, p).otherwise(F.concat(X.escape(inside), after))

    text = F.when(F.contains(xml, F.lit("<![CDATA[")), F.array_join(F.transform(parts, part), "")).otherwise(xml)
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(text, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;")


def elements(documents: DataFrame, tags: tuple[str, ...], xml: str = "xml", seq: str = "seq") -> DataFrame:
    """The complete elements of documents, as columns `seq` (document, place) and `element`, besides all others but xml."""
    either = "|".join(tags)
    whole = rf"(?s)<((?:[\w.-]+:)?(?:{either}))(?=[\s>]).*?</\1\s*>"
    found = F.regexp_extract_all(_plain(F.col(xml)), F.lit(whole), F.lit(0))
    others = [c for c in documents.columns if c not in (xml, seq)]
    rows = documents.select(seq, *others, F.posexplode(found).alias("__pos", "__element"))
    prefix = F.regexp_extract("__element", r"^<([\w.-]+:)", 1)
    bare = F.when(prefix != "", F.regexp_replace("__element", F.concat(F.lit(r"(</?)\Q"), prefix, F.lit(r"\E")), F.lit("$1"))).otherwise(F.col("__element"))
    return rows.select(F.struct(F.col(seq).alias("document"), F.col("__pos").alias("pos")).alias("seq"), *others, bare.alias("element"))


def feed_items(documents: DataFrame, aggregator_host: str = "news.example.org", wrapper_hosts: tuple[str, ...] = ()) -> DataFrame:
    """Raw items of whole RSS and Atom documents (seq, feed_domain, xml)."""
    # names with a prefix of their own (dc:date, content:encoded) count by their last part where that is unique to them
    named = F.regexp_replace(F.regexp_replace("element", r"(</?)dc:date\b", "$1date"), r"(</?)[\w.-]+:(?=[\w.-]+[\s>/])", "$1other_")
    parsed = elements(documents, ("item", "entry")).select("seq", "feed_domain", F.from_xml(named, ENTRY, {"mode": "PERMISSIVE"}).alias("e"))
    good = F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.get(F.transform(good, lambda x: F.coalesce(F.nullif(F.trim(x["_VALUE"]), F.lit("")), x["_href"])), F.lit(0))
    entry = F.struct(
        F.col("e.title").alias("title"),
        link.alias("link"),
        F.coalesce("e.summary", "e.content").alias("summary"),
        F.col("e.description").alias("description"),
        F.coalesce("e.pubDate", "e.date").alias("pubDate"),
        F.col("e.published").alias("published"),
        F.col("e.updated").alias("updated"),
        F.col("e.source").alias("source"),
    )
    return feeds.items_of_entries(parsed.select("seq", "feed_domain", entry.alias("entry")), aggregator_host, wrapper_hosts)


def news_items(documents: DataFrame) -> DataFrame:
    """Raw items of whole news sitemaps; the prefix of the news elements may be any."""
    found = elements(documents, ("url",))
    prefix = F.regexp_extract("element", r"<([\w.-]+:)?news[\s>]", 1)
    named = F.when(prefix == "", F.regexp_replace("element", r"(</?)(news|title|publication_date)(?=[\s>])", "$1news:$2")).otherwise(F.regexp_replace("element", F.concat(F.lit(r"(</?)\Q"), prefix, F.lit(r"\E")), F.lit("$1news:")))
    return feeds.news_sitemap(found.withColumn("element", named), "element")


def sitemap_urls(documents: DataFrame) -> DataFrame:
    """seq, loc, lastmod of the url elements of whole sitemaps, besides the documents' other columns."""
    parsed = elements(documents, ("url",)).withColumn("u", F.from_xml("element", "loc string, lastmod string"))
    return parsed.select("*", F.col("u.loc").alias("loc"), F.col("u.lastmod").alias("lastmod")).drop("u", "element")


def last_pages(documents: DataFrame, marker: str = "posts-post-") -> DataFrame:
    """The documents (url, seq, feed_domain, xml) that sitemap indexes among them name last, by place, of those that hold posts."""
    listed = elements(documents, ("sitemap",)).withColumn("loc", F.trim(F.from_xml("element", "loc string")["loc"]))
    index = listed.select("seq", "feed_domain", "url", "loc").where(F.contains("loc", F.lit(marker)))
    last = Window.partitionBy("url").orderBy(F.desc("seq"))
    named = index.withColumn("n", F.row_number().over(last)).where("n = 1").select(U.canonical(F.col("loc")).alias("__page")).distinct()
    return documents.withColumn("__page", U.canonical(F.col("url"))).join(named, "__page", "left_semi").drop("__page")


def standard_sitemap(documents: DataFrame, as_of: Column, hours: int = 96, keep_undated: bool = False, suffix: str | None = None, marker: str = "posts-post-") -> DataFrame:
    """Raw items of the last pages that the sitemap indexes among the documents name."""
    urls = sitemap_urls(last_pages(documents, marker)).select("seq", "feed_domain", "loc", "lastmod")
    return feeds.sitemap(urls, as_of, hours, keep_undated, suffix)
