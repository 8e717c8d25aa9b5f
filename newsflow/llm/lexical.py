"""Ranked lexical search: document-sharded postings with integer impacts, scored term at a time.

The index is a table of shards. A shard holds some thousand documents in the order of their ids and, for each of its terms, the documents
that hold it and their impacts: compressed sparse rows, the terms being the rows. An impact is the share of a term's weight that
a document gets, (10^9 tf) div (1000 tf + 20 m), where m follows from the document's length and the corpus' mean; it is computed
once, when the index is made. A search adds weight x impact into a dense accumulator of the shard's documents, one
query term after another, selects the k best (all above the k-th score, and of those that equal it the smallest ids),
and merges the shards' k best by query.

Shards are cut by the number of their terms, so neither a source nor a long document makes a task heavy; a document is never cut.
Queries come in blocks of about `block_terms` terms, which is what the driver and each task hold of them.

Defined results: a null text has no terms; a document or query without terms finds nothing and counts for nothing; repeated documents are ranked
one by one, repeated queries (equal in id and text) once; ties go to the smaller id, null ids last; a very long text is read
in pieces and indexed whole; empty tables give an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, materialize

#: Settings of jobs that write or read shards: Spark reads, and Parquet holds back, so many rows at once, and a shard is one row of some 20 MB.
_ONE_ROW = {"parquet.columnarReaderBatchSize": "1"}
_WRITER = {"parquet.block.size": str(32 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: A shard is closed at so many terms with repeats, or so many documents.
SHARD_TERMS, SHARD_DOCS = 4_000_000, 1 << 16
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Characters that are part of no term, A-Z to be lower-cased, and the constants of length and saturation.
_APART = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_APART + bytes(range(0x41, 0x5B)), b" " * len(_APART) + bytes(range(0x61, 0x7B)))
SATURATION, SLOPE, SCALE = 1000, 50, 1_000_000_000

_COUNTED = "shard long, doc_ids array<long>, lengths array<long>, terms array<string>, dfs array<long>, docs binary, counts binary"
_INDEX = "shard long, doc_ids array<long>, terms array<string>, dfs array<long>, docs binary, impacts binary"


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a list for each piece of it."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Shard:
    """The documents of a shard that is being filled."""

    def __init__(self):
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.terms = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        number, n = self.vocabulary.__getitem__, 0
        for words in term_lists(text or ""):
            part = np.fromiter(map(number, words), np.int32, len(words))
            self.parts.append(part)
            n += len(part)
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.terms += n

    def full(self) -> bool:
        return self.terms >= SHARD_TERMS or len(self.ids) >= SHARD_DOCS

    def batch(self, number: int) -> pa.RecordBatch:
        lengths = np.array(self.lengths, np.int64)
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.concatenate(self.parts).astype(np.int64)
        self.parts = []
        pairs *= len(order)
        pairs += np.repeat(place, lengths)
        pairs.sort()
        begins = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        counts = np.diff(begins, append=len(pairs))
        pairs = pairs[begins]
        dfs = np.bincount(pairs // len(order), minlength=len(self.vocabulary))
        docs = (pairs % len(order)).astype("<i4")
        terms = pa.array(list(self.vocabulary), pa.binary()).cast(pa.string())
        row = [[number], [[self.ids[i] for i in order]], [lengths[order]], None, [dfs], [docs.tobytes()], [counts.astype("<i4").tobytes()]]
        types = [pa.int64(), *[pa.list_(pa.int64())] * 2, None, pa.list_(pa.int64()), pa.binary(), pa.binary()]
        columns = [pa.ListArray.from_arrays([0, len(terms)], terms) if t is None else pa.array(x, t) for x, t in zip(row, types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["shard", "doc_ids", "lengths", "terms", "dfs", "docs", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, shard = TaskContext.get().partitionId() << 32, _Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            shard.add(doc_id.as_py(), text.as_py())
            if shard.full():
                yield shard.batch(number)
                number, shard = number + 1, _Shard()
    if shard.ids:
        yield shard.batch(number)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The table of shards and N, the number of documents that have a term."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = materialize(rows.mapInArrow(_count, _COUNTED), codec="zstd", writer=_WRITER)
    sums = counted.select(F.size("doc_ids").cast("long").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    n, total = sums[0] or 0, sums[1] or 1

    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lengths, docs, counts in zip(batch.column("lengths"), batch.column("docs"), batch.column("counts"), strict=True):
                norm = 100 - SLOPE + (SLOPE * lengths.values.to_numpy() * n) // total
                tf = np.frombuffer(counts.as_py(), "<i4").astype(np.int64)
                m = norm[np.frombuffer(docs.as_py(), "<i4")]
                out.append((SCALE * tf // (SATURATION * tf + 20 * m)).astype("<i4").tobytes())
            kept = ["shard", "doc_ids", "terms", "dfs", "docs"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.binary())], [*kept, "impacts"])

    index = materialize(counted.mapInArrow(impacts, _INDEX), 1, codec="zstd", writer=_WRITER, **_ONE_ROW)
    discard(counted)
    return index, n


def top_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """The rows of the k highest scores above 0; of those that equal the k-th, the first ones."""
    found = np.flatnonzero(scores > 0)
    if len(found) <= k:
        return found
    own = scores[found]
    least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    above = found[own > least]
    return np.concatenate([above, found[own == least][: k - len(above)]])


def search(index: DataFrame, n_docs: int, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_terms: int = 500_000) -> DataFrame:
    """The columns id_col, rank, doc_id, score: each query's k best documents with a score above 0."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, query, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                terms = pa.array(sorted({w for words in term_lists(text or "") for w in words}), pa.binary()).cast(pa.string())
                own = [pa.array([x] * len(terms), pa.int64()) for x in (item, query)]
                yield pa.RecordBatch.from_arrays([*own, terms], ["item", "query", "term"])

    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    terms = asked.select("item", F.xxhash64("item", "text").alias("query"), "text").mapInArrow(split, "item long, query long, term string")
    terms = materialize(terms)
    shares = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
    df = shares.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weighed = materialize(terms.join(df, "term"), **_ONE_ROW)
    blocks = max(1, math.ceil(weighed.count() / block_terms))
    found = []
    for block in range(blocks):
        by_query: dict[tuple, list] = {}
        for r in weighed.where(F.pmod("query", F.lit(blocks)) == block).collect():
            by_query.setdefault((r["item"], r["query"]), []).append((r["term"], math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))))
        if by_query:
            found.append(materialize(index.mapInArrow(_scorer(by_query, k), "item long, query long, doc_id long, score long"), 1, **_ONE_ROW))
    discard(terms, weighed)
    if not found:
        found = [index.select(*[F.col("shard").alias(c) for c in ("item", "query", "doc_id", "score")]).limit(0)]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = Window.partitionBy("item", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def _scorer(by_query: dict[tuple, list], k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {term for terms in by_query.values() for term, _ in terms}
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("doc_ids")[r].values
                rows_of = {t: i for i, t in enumerate(batch.column("terms")[r].values.to_pylist()) if t in wanted}
                begins = np.concatenate([[0], np.cumsum(batch.column("dfs")[r].values.to_numpy())])
                docs = np.frombuffer(batch.column("docs")[r].as_buffer(), "<i4")
                impacts = np.frombuffer(batch.column("impacts")[r].as_buffer(), "<i4")
                total = np.zeros(len(ids), np.int64)
                out: list[list] = [[], [], [], []]
                for (item, query), terms in by_query.items():
                    total[:] = 0
                    for term, weight in terms:
                        if (i := rows_of.get(term)) is not None:
                            own = slice(begins[i], begins[i + 1])
                            total[docs[own]] += weight * impacts[own].astype(np.int64)
                    best = top_rows(total, k)
                    out[0] += [item] * len(best)
                    out[1] += [query] * len(best)
                    out[2] += ids.take(pa.array(best)).to_pylist()
                    out[3] += total[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["item", "query", "doc_id", "score"])

    return score


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", query_id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Index and search in one: each query's k best documents."""
    index, n = build_index(docs, id_col, text_col)
    return search(index, n, queries, k, query_id_col, text_col)
