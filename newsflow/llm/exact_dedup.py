"""Exact duplicates by a heavy-hitter split.

Misra-Gries summaries of every partition find the digests that may be frequent; an exact count verifies them; the rows that
stay in those groups are broadcast and decide about copies where these lie, without a shuffle. All other digests, each
of which has a small share of the rows, go through one ordinary shuffle.

Defined results: a null text counts as empty; all empty texts are equal; among equal texts with the same number of
code points and the same id (repeated rows) exactly one, any one, stays; null ids come after all others; an empty table
gives an empty result; very long texts are digested whole; other columns, whatever their names, are ignored by `exact_duplicates` and kept by `drop_exact_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import HOT_KEYS, materialize, with_columns

#: Characters that don't count: [\x20\x09-\x0D].
IGNORED = " \t\n\x0b\x0c\r"
#: Counters of a Misra-Gries summary.
COUNTERS = 4 * HOT_KEYS


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without the ignored characters."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), IGNORED, ""), 256)


def _misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One summary a partition: at most `counters` digests with a lower bound of their counts; each bound misses the
    count by at most rows / (counters + 1)."""
    held: pa.Table | None = None
    for batch in batches:
        got = pc.value_counts(batch.column(0))
        new = pa.table({"digest": got.field("values"), "least": got.field("counts").cast(pa.int64())})
        both = new if held is None else pa.concat_tables([held, new]).group_by("digest").aggregate([("least", "sum")]).rename_columns(["digest", "least"])
        if both.num_rows > counters:
            least = both.column("least").to_numpy()
            cut = np.partition(least, len(least) - counters - 1)[len(least) - counters - 1]
            both = both.set_column(1, "least", pa.array(least - cut)).filter(pa.array(least > cut))
        held = both
    if held is not None:
        yield from held.select(["digest", "least"]).combine_chunks().to_batches()


def frequent_digests(rows: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """Digests whose lower bound exceeds total / HOT_KEYS: at most HOT_KEYS, and every digest with more than
    total / HOT_KEYS + total / counters rows is among them."""
    found = rows.select("digest").mapInArrow(lambda b: _misra_gries(b, counters), "digest binary, least long")
    return found.groupBy("digest").agg(F.sum("least").alias("least")).where(F.col("least") > max(2, total // HOT_KEYS)).select("digest")


def _order(length: str, doc: str) -> Column:
    """The least of these stays: most code points, then smallest id, nulls last."""
    return F.struct((-F.col(length)).alias("l"), F.col(doc).isNull().alias("n"), F.col(doc).alias("d"))


def _winners(rows: DataFrame, total: int) -> DataFrame:
    """The verified frequent groups: digest, best (order and row id of the row that stays), group_size. At most
    HOT_KEYS rows, so it may be broadcast."""
    frequent = F.broadcast(frequent_digests(rows, total))
    return rows.join(frequent, "digest").groupBy("digest").agg(F.min(F.struct(_order("length", "id").alias("o"), F.col("rid"))).alias("best"), F.count("*").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id_col, keep_id, group_size, kept, text_sha256."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias("rid")))
    total = rows.count()
    winners = F.broadcast(materialize(_winners(rows, total)))
    hot = rows.join(winners, "digest").select("id", "digest", "rid", F.col("best").alias("b"), "group_size")
    # the others are summed up where they lie and joined with the sums, so that no task gathers a group's rows
    cold = rows.join(winners.select("digest"), "digest", "left_anti")
    best = cold.groupBy("digest").agg(F.min(F.struct(_order("length", "id").alias("o"), F.col("rid"))).alias("b"), F.count("*").alias("group_size"))
    cold = cold.join(best, "digest").select("id", "digest", "rid", "b", "group_size")
    return hot.unionByName(cold).select(F.col("id").alias(id_col), F.col("b.o.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("b.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts. Copies of the frequent texts go before the shuffle."""
    keys = materialize(docs.select(F.col(id_col).alias("id"), F.unhex(text_digest(F.col(text_col))).alias("digest"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("length"), F.monotonically_increasing_id().alias("rid")))
    winners = materialize(_winners(keys, keys.count()).select(F.col("digest").alias("__nf_digest"), F.col("best.o").alias("__nf_best")))
    own = {"__nf_digest": F.unhex(text_digest(F.col(text_col))), "__nf_length": F.coalesce(F.length(text_col), F.lit(0)).cast("long"), "__nf_id": F.col(id_col)}
    # of a group at most one row leaves each task: the window's limit is applied before the shuffle, too
    left = with_columns(docs, own).join(F.broadcast(winners), "__nf_digest", "left").where(F.col("__nf_best").isNull() | (F.col("__nf_best").eqNullSafe(_order("__nf_length", "__nf_id"))))
    first = Window.partitionBy("__nf_digest").orderBy(_order("__nf_length", "__nf_id"))
    return left.withColumn("__nf_n", F.row_number().over(first)).where("__nf_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
