"""Listings and small views that a service would show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsflow.functions import text as X
from newsflow.functions import urls as U
from newsflow.functions.matching import contains_all
from newsflow.plans.scan import listed_in_window


def list_articles(stored: DataFrame, as_of: Column, hours: int, most: int | None = 500, search: list[str] | None = None) -> DataFrame:
    """The newest articles of the window, by publication or else arrival, with their age. most: how many; None for all of them, in no order."""
    rows = stored.where(listed_in_window(F.col("published_at"), F.col("found_at"), as_of, hours))
    if search:
        rows = rows.where(contains_all(search, F.col("title"), F.col("source_name"), F.col("snippet"), F.array_join("matched_keywords", " ")))
    at = F.coalesce("published_at", "found_at")
    aged = rows.withColumn("age", X.age_label(at, as_of))
    return aged if most is None else aged.orderBy(at.desc(), "url").limit(most)


def article(stored: DataFrame, url: str) -> DataFrame:
    """One article by any spelling of its URL; the filter is on the key, so it is pushed to the scan."""
    spark = stored.sparkSession
    key = spark.range(1).select(U.canonical(F.lit(url)).alias("u")).first()["u"]
    return stored.where(F.col("url") == key)


def cached_body(stored: DataFrame, forced: list[str], least: int = 300) -> DataFrame:
    usable = (F.length(F.coalesce("body", F.lit(""))) >= least) & ~F.col("domain").isin(forced)
    return stored.select("url", F.when(usable, F.col("body")).alias("body"), usable.alias("from_store"))


def refresh_worklist(stored: DataFrame, priority: list[str], most: int = 60, short: int = 600) -> DataFrame:
    """Articles whose bodies are missing or short: those of priority titles first, then the newest."""
    bucket = F.lit(len(priority))
    for i, word in reversed(list(enumerate(priority))):
        bucket = F.when(F.lower("title").contains(word), i).otherwise(bucket)
    rows = stored.where(F.length(F.coalesce("body", F.lit(""))) < short).withColumn("priority", bucket)
    return rows.orderBy("priority", F.desc("published_at"), "url").limit(most)


def shortest_first(stored: DataFrame, below: int = 600) -> DataFrame:
    n = F.length(F.coalesce("body", F.lit("")))
    return stored.where(n < below).withColumn("n", n).orderBy("n", "url")


def clamp_hours(hours: Column, least: int = 1, most: int = 720) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), hours))


def newer_than(stored: DataFrame, mark: Column) -> DataFrame:
    return stored.where(F.col("found_at") > mark)
