"""JSON payloads of vendor interfaces and caches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.operators.dedupe import first_seen

ITEM_A = "Id string, Headline string, Name string, ContentType string, Sector array<string>, Commodity array<string>, Summary string, Body string, BodyText string, Content string, UpdatedDate string, RtpTimestamp string"
ARTICLE_B = "id string, title string, summary string, bodyHtml string, body string, content string, fullText string, publishedDate string"
ROOT_B = f"struct<result:struct<values:array<struct<type:string,newsArticle:struct<{ARTICLE_B.replace(' ', ':').replace(',:', ',')}>>>>>"
REPORTS = "captured_at string, reports array<struct<uuid:string,title:string,href:string,pdf_url:string>>"


def _first_filled(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols], F.lit(""))


def items_a(payloads: DataFrame) -> DataFrame:
    """payloads (seq, json: {"Items": [...]}) as one row for each Id, the first seen."""
    rows = payloads.select("seq", F.posexplode(F.from_json("json", f"Items array<struct<{ITEM_A.replace(' ', ':').replace(',:', ',')}>>")["Items"]).alias("pos", "i"))
    body = _first_filled(F.col("i.Body"), F.col("i.BodyText"), F.col("i.Content"))
    rows = rows.where(F.coalesce("i.Id", F.lit("")) != "").select((F.col("seq") * 1000 + F.col("pos")).alias("seq"), F.col("i.Id").alias("id"), _first_filled(F.col("i.Headline"), F.col("i.Name")).alias("title"), F.coalesce("i.Sector", F.array().cast("array<string>")).alias("sectors"), F.coalesce("i.Commodity", F.array().cast("array<string>")).alias("commodities"), F.concat_ws("\n", F.nullif(F.trim(F.coalesce("i.Summary", F.lit(""))), F.lit("")), F.nullif(body, F.lit(""))).alias("body"), X.parse_time(F.coalesce("i.UpdatedDate", "i.RtpTimestamp")).alias("published_at"))
    return first_seen(rows, "id")


def relevant(sectors: Column, commodities: Column, headline: Column, wanted: list[str], words: list[str]) -> Column:
    """A wanted sector, or a word in a commodity, or a word in the headline."""
    either = "(?i)" + "|".join(words)
    return F.arrays_overlap(F.transform(sectors, F.lower), F.array(*[F.lit(w.lower()) for w in wanted])) | F.exists(commodities, lambda c: F.regexp_like(c, F.lit(either))) | F.regexp_like(headline, F.lit(either))


def items_b(payloads: DataFrame) -> DataFrame:
    """payloads (seq, json: an object or a list of objects with result.values) as news articles, each id once."""
    listed = F.when(F.ltrim("json").startswith("["), F.from_json("json", f"array<{ROOT_B}>")).otherwise(F.array(F.from_json("json", ROOT_B)))
    rows = payloads.select("seq", F.explode(listed).alias("root")).select("seq", F.posexplode("root.result.values").alias("pos", "v")).where("v.type = 'newsArticle' or v.newsArticle is not null").select("seq", "pos", "v.newsArticle.*")
    body = _first_filled(F.col("bodyHtml"), F.col("body"), F.col("content"), F.col("fullText"))
    rows = rows.select((F.col("seq") * 1000 + F.col("pos")).alias("seq"), "id", F.trim(F.coalesce("title", F.lit(""))).alias("title"), X.html_to_text(F.coalesce("summary", F.lit(""))).alias("summary"), body.alias("body"), X.parse_time(F.col("publishedDate")).alias("published_at"))
    return first_seen(rows.where("id is not null"), "id")


def reports(cache: DataFrame, most: int = 10) -> DataFrame:
    """The first reports of a cache (json), each uuid once, ranked from 1 by position. A cache of several files has them in the order of a column `part`."""
    part = F.col("part") if "part" in cache.columns else F.lit(0)
    rows = cache.select(part.alias("part"), F.posexplode(F.from_json("json", REPORTS)["reports"]).alias("pos", "r"))
    rows = rows.select(F.struct("part", "pos").alias("seq"), "r.*").where("uuid is not null")
    top = first_seen(rows, "uuid").orderBy("seq").limit(most)
    from newsflow.operators.dedupe import ranked

    return ranked(top, ["seq"])


def report_title(title: Column, prefix: str) -> Column:
    """The title without a prefix, unless nothing would be left."""
    short = F.trim(F.regexp_replace(title, "(?i)^(?:" + prefix + r")\s*[:|–-]?\s*", ""))
    return F.when(short == "", F.trim(title)).otherwise(short)


def document_link(html: Column, page_url: Column) -> Column:
    """The first PDF link of a page, made absolute; empty if there is none."""
    from newsflow.functions.urls import absolute

    href = F.regexp_extract(html, r"""(?i)["'((]([^"'()\s]+\.pdf(?:\?[^"'()\s]*)?)["')]""", 1)
    return F.coalesce(F.when(href != "", absolute(href, page_url)), F.lit(""))


def article_url(base: str, headline: Column, ident: Column) -> Column:
    """A vendor's article route: spaces of the headline as %20."""
    return F.concat(F.lit(base), ident, F.lit("/"), F.replace(F.url_encode(headline), F.lit("+"), F.lit("%20")))
