"""Order-true deduplication, caps and ranks. Every tie is broken by the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str | list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Spark limits groups before the shuffle, so a key with many rows is not gathered."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def first_seen(df: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    return first_by(df, key, [seq])


def first_dated(df: DataFrame, key: str, time: str = "published_at", seq: str = "seq") -> DataFrame:
    """First by arrival among rows with a time; without one, first by arrival."""
    return first_by(df, key, [F.col(time).isNull(), F.col(seq)])


def top(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_rows(df: DataFrame, key: str | list[str], seq: str, n: int) -> DataFrame:
    """The first n rows of each key; the limit is applied before the shuffle as well, so a key with many rows is not gathered."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where(F.col("__n") <= n).drop("__n")


def admit(df: DataFrame, key: str, time: str = "published_at", seq: str = "seq", dated: int = 20, undated: int = 60, late: Column | None = None) -> DataFrame:
    """At most `dated` rows of each key, to which rows without a time may add up to `undated`: the first `dated` rows are in, and of
    the later ones those without a time, as long as dated + their rank <= undated. Rows that are `late` come after all others and count as dated.

    A row with a time is in only among the first `dated` of its kind, one without only among the first `undated`, so all others go
    before the ranks are taken, and no key is large."""
    late = F.lit(False) if late is None else late
    kinds = df.withColumn("__l", late).withColumn("__u", F.col(time).isNull() & ~F.col("__l"))
    few = first_rows(kinds, [key, "__l", "__u"], seq, max(dated, undated))
    w = Window.partitionBy(key).orderBy("__l", seq)
    ranks = few.withColumn("__n", F.row_number().over(w)).withColumn("__u", F.col("__u") & (F.col("__n") > dated))
    ranks = ranks.withColumn("__k", F.count_if("__u").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranks.where((F.col("__n") <= dated) | (F.col("__u") & (dated + F.col("__k") <= undated))).drop("__n", "__u", "__k", "__l")


def ranked(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """rank from 1 in the order. Rows are sorted over all partitions; a row's rank is its place in its partition after the rows of those before."""
    spread = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    sorted_ = df.orderBy(*order).select(spread).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).persist()
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = sizes.select("part", "begin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return sorted_.join(F.broadcast(bases), "part").select("row.*", (F.col("base") + F.col("at") - F.col("begin") + 1).cast("int").alias(name))


def running_sum(df: DataFrame, order: list[Column | str], value: str, name: str) -> DataFrame:
    """The sum of `value` over the rows before each one in the order, as `ranked` numbers them: within partitions, after the sums of those before."""
    spread = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    sorted_ = df.orderBy(*order).select(spread).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).persist()
    sizes = sorted_.groupBy("part").agg(F.sum(F.col("row")[value]).alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("base"))  # a row for each partition
    within = F.coalesce(F.sum(F.col("row")[value]).over(before.partitionBy("part").orderBy("at")), F.lit(0))
    return sorted_.join(F.broadcast(bases), "part").withColumn("within", within).select("row.*", (F.col("base") + F.col("within")).cast("long").alias(name))


def until_crossed(df: DataFrame, group: str, page: str, crossed: Column) -> DataFrame:
    """Pages up to and with the first one that holds a crossed row: a listing read to its end would stop there."""
    flags = df.groupBy(group, page).agg(F.max(crossed.cast("int")).alias("__c"))
    before = Window.partitionBy(group).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    kept = flags.withColumn("__b", F.coalesce(F.max("__c").over(before), F.lit(0))).where(F.col("__b") == 0).select(group, page)
    return df.join(kept, [group, page])


def changed_from_previous(df: DataFrame, group: str, seq: str, text: str, chars: int = 150) -> DataFrame:
    """Rows whose beginning differs from that of the row before."""
    w = Window.partitionBy(group).orderBy(seq)
    return df.withColumn("__p", F.lag(F.left(text, F.lit(chars))).over(w)).where(F.col("__p").isNull() | (F.col("__p") != F.left(text, F.lit(chars)))).drop("__p")


def drop_numbered(df: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """Rows but those at .../slug-N whose .../slug is in the batch or stored."""
    from newsflow.functions.urls import numbered_base

    known = df.select(F.col(url).alias("__base")).union(stored.select(F.col(url).alias("__base"))).distinct()
    return df.withColumn("__base", numbered_base(F.col(url))).join(known, "__base", "left_anti").drop("__base")
