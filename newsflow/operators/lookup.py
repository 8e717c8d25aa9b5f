"""Keyword modes, lookups of small dimension tables, ordered requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a dimension table is broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if a count, which stops at the bound, says that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def effective_keywords(modes: DataFrame, keywords: DataFrame) -> DataFrame:
    """domain, keywords: ["*"] for mode all, the sorted own list for specific; no row for global."""
    own = keywords.groupBy("domain").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    joined = modes.where("mode <> 'global'").join(own, "domain", "left")
    return joined.select("domain", F.when(F.col("mode") == "all", F.array(F.lit("*"))).otherwise(F.coalesce("keywords", F.array().cast("array<string>"))).alias("keywords"))


def source_keywords(items: DataFrame, lists: DataFrame) -> DataFrame:
    """items with source_keywords: the list of the source's domain, or else of the feed's; empty lists count as none."""
    full = small(lists.where(F.size("keywords") > 0))
    by = lambda key: full.select(F.col("domain").alias(key), F.col("keywords").alias(f"__{key}"))
    joined = items.join(by("source_domain"), "source_domain", "left").join(by("feed_domain"), "feed_domain", "left")
    return joined.withColumn("source_keywords", F.coalesce("__source_domain", "__feed_domain")).drop("__source_domain", "__feed_domain")


def named(items: DataFrame, names: DataFrame, domain: str = "domain") -> DataFrame:
    """items with source_name: the display name of the domain, or of the domain without www., or the domain."""
    own = small(names.select("domain", "name"))
    first = own.select(F.col("domain").alias("__d1"), F.col("name").alias("__n1"))
    second = own.select(F.col("domain").alias("__d2"), F.col("name").alias("__n2"))
    joined = items.join(first, F.col(domain) == F.col("__d1"), "left").join(second, F.regexp_replace(F.col(domain), r"^www\.", "") == F.col("__d2"), "left")
    return joined.withColumn("source_name", F.coalesce("__n1", "__n2", F.col(domain))).drop("__d1", "__n1", "__d2", "__n2")


def contained_id(items: DataFrame, stored: DataFrame, pattern: str) -> DataFrame:
    """items (id) with the length of the body stored under a URL that holds the id, else 0: the id is taken out of the URL, so that
    an equi-join does what a search of each id in each URL would."""
    ids = stored.withColumn("id", F.regexp_extract("url", pattern, 1)).where("id <> ''").groupBy("id").agg(F.max_by(F.length(F.coalesce("body", F.lit(""))), F.struct("found_at", "url")).alias("stored_length"))
    return items.join(ids, "id", "left").withColumn("stored_length", F.coalesce("stored_length", F.lit(0)))


def requested(request: DataFrame, articles: DataFrame) -> DataFrame:
    """The request's rows (pos, url, take, sector) with their articles; `found` is false for unknown URLs."""
    return request.join(articles.withColumn("found", F.lit(True)), "url", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def zipped_request(urls: Column, takes: Column, sectors: Column) -> Column:
    """(pos, url, take, sector) from three lists; a missing take is "=", a missing sector empty."""
    return F.transform(urls, lambda u, i: F.struct(i.alias("pos"), u.alias("url"), F.coalesce(F.get(takes, i), F.lit("=")).alias("take"), F.coalesce(F.get(sectors, i), F.lit("")).alias("sector")))


def source_admin(known: DataFrame, modes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Known sources with their mode (global by default) and, for specific ones, their keywords."""
    lists = keywords.groupBy("domain").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    joined = known.join(modes, "domain", "left").join(lists, "domain", "left").withColumn("mode", F.coalesce("mode", F.lit("global")))
    return joined.withColumn("keywords", F.when(F.col("mode") == "specific", F.coalesce("keywords", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def replaced(current: DataFrame, incoming: DataFrame, key: str = "url") -> DataFrame:
    """current with rows of incoming in place of those with their key."""
    return current.join(incoming.select(key), key, "left_anti").unionByName(incoming)
