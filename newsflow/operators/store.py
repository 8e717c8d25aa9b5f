"""The article store as read-compute-write over tables: upserts, retention, small configuration tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.operators.dedupe import ranked


def fold_upserts(history: DataFrame, key: str = "url", seq: str = "seq", *more: Column) -> DataFrame:
    """The row that writing the history in order leaves for each key: title, snippet and keywords of the last write; its last
    known publication time; the longest body, the earliest of equals; domain, source and found_at of the first write. One aggregation, combined before its shuffle."""
    last = lambda c: F.max_by(c, seq).alias(c)
    first = lambda c: F.min_by(c, seq).alias(c)
    longest = F.max_by("body", F.struct(F.length(F.coalesce("body", F.lit(""))), -F.col(seq))).alias("body")
    published = F.max_by("published_at", F.when(F.col("published_at").isNotNull(), F.col(seq))).alias("published_at")
    return history.groupBy(key).agg(first("domain"), first("source_name"), last("title"), last("snippet"), published, first("found_at"), last("matched_keywords"), longest, *more)


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "url", seq: str = "seq") -> DataFrame:
    """The store after the incoming writes (which carry seq, from 1 up); is_new marks keys that were not there."""
    old = stored.withColumn(seq, F.lit(0).cast("long"))
    both = old.withColumn("__old", F.lit(True)).unionByName(incoming.withColumn("__old", F.lit(False)))
    return fold_upserts(both, key, seq, (~F.max("__old")).alias("is_new"))


def new_rows(incoming: DataFrame, stored: DataFrame, key: str = "url") -> DataFrame:
    return incoming.join(stored.select(key), key, "left_anti")


def save_bodies(stored: DataFrame, bodies: DataFrame, key: str = "url", least: int = 100, force: bool = False) -> DataFrame:
    """Bodies of `least` characters or more replace shorter ones, or, forced, any."""
    new = bodies.where(F.length("new_body") >= least).select(key, "new_body")
    better = F.col("new_body").isNotNull() & (F.lit(force) | (F.length("new_body") > F.length(F.coalesce("body", F.lit("")))))
    return stored.join(new, key, "left").withColumn("body", F.when(better, F.col("new_body")).otherwise(F.col("body"))).drop("new_body")


def replace_ranked(items: DataFrame, order: list[Column | str], current: DataFrame) -> DataFrame:
    """The items numbered from 1 as the new table; no items leave the current one."""
    return current if items.isEmpty() else ranked(items, order)


def retain(stored: DataFrame, as_of: Column, hours: int, time: str = "found_at") -> DataFrame:
    return stored.where(F.col(time) >= as_of - F.make_dt_interval(hours=F.lit(hours)))


def put(table: DataFrame, writes: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """A key-value table after writes in order; a null value deletes."""
    both = table.select(key, value, F.lit(0).cast("long").alias(seq)).unionByName(writes.select(key, value, seq))
    return both.groupBy(key).agg(F.max_by(value, seq).alias(value)).where(F.col(value).isNotNull())


def seed(table: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore."""
    return table.unionByName(defaults.join(table.select(*keys), keys, "left_anti"))


def set_modes(modes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Domains that have keywords of their own become specific."""
    own = keywords.select("domain").distinct().withColumn("mode", F.lit("specific"))
    return modes.join(own.select("domain"), "domain", "left_anti").unionByName(own)


def promote_empty(modes: DataFrame, keywords: DataFrame, open_domains: list[str]) -> DataFrame:
    """Specific domains without keywords whose default takes everything become mode all."""
    none = modes.where(F.col("mode").eqNullSafe("specific") & F.col("domain").isin(open_domains)).join(keywords, "domain", "left_anti").select("domain", F.lit("all").alias("mode"))
    return modes.join(none.select("domain"), "domain", "left_anti").unionByName(none)


def add_keyword(keywords: Column, word: str) -> Column:
    word = word.strip()
    return F.when(F.array_contains(keywords, word) | F.lit(not word), keywords).otherwise(F.array_append(keywords, F.lit(word)))


def finish_run(runs: DataFrame, errors: DataFrame, most: int = 200) -> DataFrame:
    """runs with the first `most` of their errors, by seq."""
    listed = errors.groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "error"))), lambda e: e["error"]), 1, most).alias("errors"))
    return runs.join(listed, "id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def alerts(config: DataFrame, prefix: str = "session_alert_") -> DataFrame:
    value = F.from_json("value", "message string, ts string")
    return config.where(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, 1 << 20).alias("source"), value["message"].alias("message"), value["ts"].alias("ts"))


def blank_bodies(stored: DataFrame, domains: list[str]) -> DataFrame:
    return stored.withColumn("body", F.when(F.col("domain").isin(domains), F.lit(None)).otherwise(F.col("body")))


def mirror(df: DataFrame, path: str, batch: int) -> None:
    """Write a batch to a mirror, all rows of it; a batch that is written again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def mirrored(spark: SparkSession, path: str, key: str = "url", seq: str = "seq") -> DataFrame:
    """The mirror's rows: for each key the last one of the last batch that has it."""
    rows = spark.read.parquet(path)
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in (key, "batch")])
    return rows.groupBy(key).agg(F.max_by(whole, F.struct("batch", seq)).alias("last")).select(key, "last.*")
