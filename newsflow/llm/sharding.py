"""Sharding by a k-d tree over document metadata.

A node is split along the dimension in which its rows are spread widest until the leaves, the shards, reach the target bytes: one
of m times the target is split at the weighted quantile floor(m/2)/m of its bytes, the median where m is even. The law that holds is `bytes`: sizes near equal. Medians are found
without sorting or gathering rows: every job sums bytes in BINS bins of the key range of each open node (at most
shards x BINS sums reach the driver, whatever the input), then the bin that holds the quantile is cut into BINS again, until
it holds one key or a `tolerance` part of a shard's bytes. The key is the place along the dimension, then a hash of the text, then
one of the row, so that rows with equal metadata can be divided, and equal texts only where a cut falls within them.

Defined results: a null text has no bytes (size 16); null metadata lie below all others; repeated rows are placed one by
one; a very long text is a row like others, and a shard that it outweighs holds it alone or nearly so; with fewer rows than shards some
shards stay empty; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, materialize

BINS = 1024
#: Cells of a dimension, and of the hash that follows.
CELLS = 1 << 30


@dataclass
class Node:
    """Rows of `shards` shards from number `first`; after the split, rows with key <= cut along dim go left."""

    first: int
    shards: int
    dim: int = -1
    cut: int = -1
    kids: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [x for k in self.kids for x in k.leaves()] if self.kids else [self]


def _key(dim: int) -> Column:
    return F.col(f"x{dim}") * CELLS + F.col("tie")


def _place(node: Node) -> Column:
    """The first shard of the leaf a row falls in."""
    if not node.kids:
        return F.lit(node.first)
    return F.when(_key(node.dim) <= node.cut, _place(node.kids[0])).otherwise(_place(node.kids[1]))


def _cells(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Every dimension scaled to 1..CELLS-1 over the table's range (0: null) as x0, x1, ..."""
    ends = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    scaled = lambda i, c: F.lit(1) if ends[f"a{i}"] is None or ends[f"a{i}"] == ends[f"b{i}"] else 1 + F.floor((F.col(c) - ends[f"a{i}"]) / (ends[f"b{i}"] - ends[f"a{i}"]) * (CELLS - 2))
    return rows.select("*", *[F.coalesce(scaled(i, c), F.lit(0)).cast("long").alias(f"x{i}") for i, c in enumerate(dims)])


def build_tree(rows: DataFrame, n_dims: int, shards: int, tolerance: float = 0.001) -> Node:
    """rows: x0.. (cells), tie, size. A few jobs for each of the log2(shards) levels."""
    root = Node(0, shards)
    while open_ := [x for x in root.leaves() if x.shards > 1]:
        named = rows.withColumn("node", _place(root)).where(F.col("node").isin([x.first for x in open_]))
        seen = {r["node"]: r for r in named.groupBy("node").agg(F.sum("size").alias("size"), *[(F.max(f"x{i}") - F.min(f"x{i}")).alias(f"w{i}") for i in range(n_dims)], *[F.min(f"x{i}").alias(f"a{i}") for i in range(n_dims)], *[F.max(f"x{i}").alias(f"b{i}") for i in range(n_dims)]).collect()}
        # per open node: bounds of the keys searched, bytes below them, wanted bytes, tolerated bytes
        todo = {}
        for x in open_:
            r = seen.get(x.first)
            if r is None:
                x.dim, x.cut = 0, -1
                continue
            x.dim = max(range(n_dims), key=lambda i: (r[f"w{i}"], -i))
            todo[x.first] = [x, r[f"a{x.dim}"] * CELLS, (r[f"b{x.dim}"] + 1) * CELLS - 1, 0, r["size"] * (x.shards // 2) / x.shards, max(1.0, r["size"] / x.shards * tolerance)]
        while todo:
            pick = lambda values: F.create_map(*[F.lit(v) for k, t in todo.items() for v in (k, values(t))])[F.col("node")]  # noqa: B023, E731
            key = F.coalesce(*[F.when(F.col("node").isin([k for k, t in todo.items() if t[0].dim == d]), _key(d)) for d in range(n_dims)])  # noqa: B023
            in_range = named.where(F.col("node").isin(list(todo))).select("node", "size", key.alias("key"), pick(lambda t: t[1]).alias("lo"), pick(lambda t: t[2]).alias("hi")).where("key between lo and hi")
            width = F.floor((F.col("hi") - F.col("lo")) / BINS).cast("long") + 1
            sums = in_range.groupBy("node", F.floor((F.col("key") - F.col("lo")) / width).cast("int").alias("bin")).agg(F.sum("size").alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
            for first, t in list(todo.items()):
                x, lo, hi, below, want, slack = t
                bins = sorted((r for r in sums if r["node"] == first), key=lambda r: r["bin"])
                cut = lo - 1
                for r in bins:
                    if below + r["size"] <= want:
                        below, cut = below + r["size"], r["hi"]
                        continue
                    over = below + r["size"] - want
                    if r["lo"] == r["hi"] or min(over, want - below) <= slack:
                        x.cut = r["hi"] if over < want - below else cut
                        del todo[first]
                    else:
                        t[1:4] = [r["lo"], r["hi"], below]
                    break
                else:
                    x.cut = cut
                    del todo[first]
        for x in open_:
            x.kids = [Node(x.first, x.shards // 2), Node(x.first + x.shards // 2, x.shards - x.shards // 2)]
    return root


def shard_documents(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: id_col, size, text_crc32, law, shard, slot, grown_shard.

    target_bytes: of a shard; where it is given, there are as many shards as the bytes of all rows need, and else `shards`,
    whose target is their even part. dims: names and numeric expressions of the metadata dimensions. Sizes of shards differ by the tolerance of each
    split and by what a single document weighs. grown_shard is null, as law `bytes` promises nothing for more shards."""
    if dims is None:
        dims = {"n_chars": F.coalesce(F.length(text_col), F.lit(0)), "source": F.crc32(F.col("source").cast("string").cast("binary")), "lang": F.crc32(F.col("lang").cast("string").cast("binary"))}
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rid = F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), rid.alias("rid"), *[v.cast("double").alias(f"d{i}") for i, v in enumerate(dims.values())])
    # 16 bits of the text's hash, 14 of the row's
    raw = materialize(rows.withColumn("tie", F.shiftleft(F.pmod(F.xxhash64("text_crc32", "size"), F.lit(1 << 16)), 14) + F.pmod(F.xxhash64("rid"), F.lit(1 << 14))))
    rows = materialize(_cells(raw, [f"d{i}" for i in range(len(dims))]).drop(*[f"d{i}" for i in range(len(dims))]))
    discard(raw)
    if target_bytes is not None:
        shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    placed = rows.withColumn("shard", _place(build_tree(rows, len(dims), shards)))
    # slots: rows are numbered within parts of a shard that stay small at any size, parts by running sums
    parts = max(64, rows.count() // (shards * 100_000))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(parts)).cast("int"))
    sizes = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    slots = placed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid"))).join(starts, ["shard", "part"])
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
