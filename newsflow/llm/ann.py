"""Approximate nearest neighbours by collision counting over query-centred windows.

Vectors are projected on LINES random lines, and each line keeps its projections as one sorted array. Around a query's own projection a
window opens on every line; virtual rehashing widens all windows together, in proportion to the search radius, on the same
arrays. A vector that lies in the windows of at least `threshold` of the lines is verified with the exact inner product on the
original vectors. A search ends as soon as k verified vectors lie within the radius, or when k vectors and the false positives that
the method allows, `verify` of the block's vectors but FALSE_POSITIVES at least, have been verified. Largest inner product is made nearest distance by one more coordinate, which gives all vectors of a block the same length.

The arrays are read by pages: a window is the pages that it touches. For every page border a line keeps the set of vectors before it as a bit
map, so a window is the difference of two maps, and the windows of all lines are added up by bitwise carry-save counters, 64
vectors a word. A vector whose distance is the radius lies in the window of a line with probability 2 Phi(WIDTH) - 1, here
0.77; the threshold lies below that, so such a vector is missed with a probability of a few in a hundred.

Every row is indexed, in blocks of about `block_rows` distinct vectors; the stated queries meet every block, and the best k of
each block are merged by query. Equal vectors are one entry with its k + 1 smallest ids, which are all that a top k can
show, so a vector that many rows share costs no more than another.

Defined results: vectors that are null, zero, of another than the most frequent length, or hold null or non-finite components take no part; repeated rows count
once; the query's own id is never its neighbour; ties go to the smaller id; with fewer candidates than k all are returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, materialize
from newsflow.llm.simhash import _exceeds, _full

LINES = 160
#: Pages of a sorted array.
PAGES = 64
#: Half a window's width, as a multiple of the radius.
WIDTH = 1.2
#: Share of the lines on which a vector must collide with the query.
THRESHOLD = 0.74
#: False positives that may be verified before a search ends: a share of a block's vectors, and at least so many.
VERIFY, FALSE_POSITIVES = 0.04, 1000
#: Factor between the radii of two rounds.
WIDEN = 1.025
#: Rows that a first radius is taken from, and its share of the least distance to one of them.
PILOT, FIRST = 512, 0.85
#: Queries counted at once, and queries that one copy of a block serves.
AT_ONCE, OF_COPY = 32, 16384


class BlockIndex:
    """The sorted projections of one block's vectors, by pages."""

    def __init__(self, vectors: np.ndarray, lines: int = LINES, seed: int = 7):
        self.vectors = vectors.astype(np.float64)
        n = self.n = len(vectors)
        norms = np.linalg.norm(self.vectors, axis=1)
        self.longest = norms.max()
        lifted = np.column_stack([self.vectors / self.longest, np.sqrt(np.maximum(0, 1 - (norms / self.longest) ** 2))])
        self.lines = np.random.default_rng(seed).standard_normal((lifted.shape[1], lines))
        self.pilot = lifted[:: max(1, n // PILOT)].copy()
        page = math.ceil(n / PAGES)
        pages = math.ceil(n / page)
        self.before = np.zeros((lines, pages + 1, math.ceil(n / 64)), np.uint64)
        self.first, self.last = np.zeros((lines, pages)), np.zeros((lines, pages))
        of_rank = np.arange(n) // page
        for i in range(lines):
            spread = lifted @ self.lines[:, i]
            order = np.argsort(spread, kind="stable")
            ordered = spread[order]
            self.first[i], self.last[i] = ordered[::page], np.append(ordered[page - 1 :: page], ordered[-1:])[:pages]
            own = np.zeros((pages, self.before.shape[2] * 64), bool)
            own[of_rank, order] = True
            maps = np.packbits(own, axis=1, bitorder="little").view(np.uint64)
            self.before[i, 1:] = np.bitwise_or.accumulate(maps, axis=0)

    def colliding(self, at: np.ndarray, half: np.ndarray, need: int) -> np.ndarray:
        """Bit maps of the vectors that lie in `need` windows or more. at: the queries' projections; half: half their windows' width."""
        shape = (len(at), self.before.shape[2])
        counter = [np.zeros(shape, np.uint64) for _ in range(len(self.lines[0]).bit_length() + 1)]
        for begin in range(0, len(self.lines[0]), 7):
            x = []
            for i in range(begin, min(begin + 7, len(self.lines[0]))):
                low = np.searchsorted(self.last[i], at[:, i] - half)
                high = np.maximum(np.searchsorted(self.first[i], at[:, i] + half, "right"), low)
                x.append(self.before[i][high] ^ self.before[i][low])
            x += [np.zeros(shape, np.uint64)] * (7 - len(x))
            s1, c1 = _full(x[0], x[1], x[2])
            s2, c2 = _full(x[3], x[4], x[5])
            s3, c3 = _full(s1, s2, x[6])
            twos, fours = _full(c1, c2, c3)
            counter[0], carry = counter[0] ^ s3, counter[0] & s3
            counter[1], carry = _full(counter[1], carry, twos)
            counter[2], carry = _full(counter[2], carry, fours)
            for j in range(3, len(counter) - 1):
                counter[j], carry = counter[j] ^ carry, counter[j] & carry
        return _exceeds(counter, need - 1)

    def search(self, queries: np.ndarray, k: int, threshold: float = THRESHOLD, verify: float = VERIFY, widen: float = WIDEN) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the row numbers and inner products of the k best verified vectors, and all that tie with the last of
        them, and how many were verified."""
        unit = np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))])
        at = unit @ self.lines
        distance = lambda cosine: np.sqrt(np.maximum(0, 2 - 2 * cosine))
        radius = np.maximum(FIRST * distance(unit @ self.pilot.T).min(axis=1), 1e-3)
        scale = np.linalg.norm(queries, axis=1) * self.longest
        need, enough = max(1, math.ceil(threshold * self.lines.shape[1])), min(self.n, k + max(FALSE_POSITIVES, math.ceil(verify * self.n)))
        seen = np.zeros((len(queries), self.before.shape[2]), np.uint64)
        rows = [np.zeros(0, np.int64)] * len(queries)
        scores = [np.zeros(0)] * len(queries)
        open_ = np.arange(len(queries))
        while len(open_):
            hits = self.colliding(at[open_], WIDTH * radius[open_], need)
            fresh = hits & ~seen[open_]
            seen[open_] |= hits
            going = []
            for q, bits in zip(open_.tolist(), fresh, strict=True):
                new = np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")[: self.n]) if bits.any() else rows[q][:0]
                if len(new):
                    rows[q], scores[q] = np.append(rows[q], new), np.append(scores[q], np.einsum("ij,j->i", self.vectors[new], queries[q]))
                found = len(rows[q])
                within = found >= k and distance(np.partition(scores[q], found - k)[found - k] / scale[q]) <= radius[q]
                if not within and found < enough:
                    going.append(q)
            radius[going] *= widen
            open_ = np.array(going, np.int64)
        out = []
        for found, score in zip(rows, scores, strict=True):
            verified = len(found)
            if verified > k:
                least = np.partition(score, verified - k)[verified - k]
                found, score = found[score >= least], score[score >= least]
            out.append((found, score, verified))
        return out


def _valid(vector: Column) -> Column:
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, usable) & F.exists(vector, lambda x: x != 0)


def _pack(rows: DataFrame, blocks: int, kind: str) -> DataFrame:
    """rows (ids: array<long>, v: array<double>), dealt by their first id, as blocks: block (from 0), vectors and ids (binary), with how many ids a vector has."""
    schema = pa.schema([("block", pa.int64()), ("vectors", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary())])

    def block(number: int, part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        ids, v = part.column("ids").combine_chunks(), part.column("v").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy()).astype("<i4").tobytes()
        return pa.RecordBatch.from_pylist([{"block": number, "vectors": v.flatten().to_numpy().astype(kind).tobytes(), "ids": ids.flatten().to_numpy().tobytes(), "sizes": sizes}], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = -1
        for batch in batches:
            numbers = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and numbers[a] != number:
                    yield block(number, pa.Table.from_batches(held))
                    held = []
                if a < b:
                    number = int(numbers[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield block(number, pa.Table.from_batches(held))

    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(blocks))).repartition(blocks, "block").sortWithinPartitions("block")
    return materialize(dealt.mapInArrow(run, "block long, vectors binary, ids binary, sizes binary"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 65536, query_rows: int = 128, **search) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which is_query (over id_col) holds."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("v")).where(_valid(F.col("v")))
    rows = materialize(rows.groupBy(id_col, "v").agg(F.lit(1).alias("one")).select(id_col, "v"))
    size = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")))
    dim = (size.first()[0] or (0, 0))[1]
    of_size = rows.where(F.size("v") == dim)
    same = Window.partitionBy("v").orderBy(id_col)
    entries = materialize(of_size.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(id_col)).alias("ids")))
    queries = of_size.where(is_query).select(F.array(id_col).alias("ids"), "v")
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    n_queries = queries.count()
    n_blocks = max(1, math.ceil(entries.count() / block_rows))
    blocks, asked = _pack(entries, n_blocks, kind), _pack(queries, max(1, math.ceil(n_queries / query_rows)), kind)
    # Every block of queries meets every block of rows by an equi-join on the block of rows and a share of the queries; a
    # block is copied once for each OF_COPY queries, or more often while there are fewer tasks than cores. The two sides are sorted together, the
    # block first, so that it goes to Python once and not with each block of queries.
    shares = max(1, math.ceil(n_queries / OF_COPY), min(math.ceil(n_queries / (4 * query_rows)), math.ceil(spark.sparkContext.defaultParallelism / n_blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = asked.select(every(n_blocks).alias("block"), F.pmod("block", F.lit(shares)).alias("share"), F.lit(True).alias("asks"), "vectors", "ids", "sizes")
    spread = blocks.select("block", every(shares).alias("share"), F.lit(False).alias("asks"), "vectors", "ids", "sizes")
    pairs = spread.unionByName(met).repartition(4 * n_blocks * shares, "block", "share").sortWithinPartitions("block", "share", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, BlockIndex, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for n in range(batch.num_rows):
                number, vectors, ids = batch.column("block")[n].as_py(), np.frombuffer(batch.column("vectors")[n].as_buffer(), kind).reshape(-1, dim), np.frombuffer(batch.column("ids")[n].as_buffer(), np.int64)
                if not batch.column("asks")[n].as_py():
                    if held is None or held[0] != number:
                        held = None  # before the next index is made
                        sizes = np.frombuffer(batch.column("sizes")[n].as_buffer(), "<i4")
                        held = number, BlockIndex(vectors), ids.copy(), np.concatenate([[0], np.cumsum(sizes)])
                    continue
                if held is None or held[0] != number:
                    continue  # no vectors fell to this block
                _, index, of_block, bounds = held
                own = vectors.astype(np.float64)
                out: list[list] = [[], [], []]
                for a in range(0, len(ids), AT_ONCE):
                    for me, (at, scores, _) in zip(ids[a : a + AT_ONCE].tolist(), index.search(own[a : a + AT_ONCE], k + 1, **search), strict=True):
                        found = sorted((-s, i) for x, s in zip(at.tolist(), scores.tolist(), strict=True) for i in of_block[bounds[x] : bounds[x + 1]].tolist() if i != me)[:k]
                        out[0] += [me] * len(found)
                        out[1] += [i for _, i in found]
                        out[2] += [-s for s, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = materialize(pairs.mapInArrow(run, "query_id long, vec_id long, score double"), 1, **{"parquet.columnarReaderBatchSize": "1"})
    discard(rows, entries, blocks, asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
