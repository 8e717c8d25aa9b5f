"""Connected components of an edge table, without gathering edges, nodes or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import discard, join_hot, materialize


def _with_least(edges: DataFrame, by: str, of: str, total: int) -> tuple[DataFrame, DataFrame]:
    """A written table of the smallest `of` for each `by`, and edges with it as `least`; frequent `by` are joined by broadcast."""
    least = materialize(edges.groupBy(by).agg(F.min(of).alias("least"), F.count("*").alias("n")))
    return least, join_hot(edges, least, by, "n", total)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (u, v: longs); label is the smallest node that it is linked with.

    Large-star and small-star steps alternate until the edges, then one from each node to its label, no longer change. The
    number of rounds grows with the logarithm of the nodes; each writes its edges, so a lost executor costs one step."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = materialize(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least, large = _with_least(both, "u", "v", 2 * state[0])
        large = large.select("u", "v", F.least("least", "u").alias("least")).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        discard(edges, both, least)
        least, small = _with_least(large, "u", "v", large.count())
        # every smaller neighbour and the node itself point to the smallest
        small = small.select(F.inline(F.array(F.struct(F.col("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))))
        edges = materialize(small.where("u <> v").distinct())
        discard(large, least)
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
