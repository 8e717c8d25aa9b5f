"""Stupid-backoff scores of every document under an n-gram model of all other documents.

Texts are gathered into blocks of documents. Order by order, each block lists its distinct n-grams with their counts; these
entries are dealt by a hash into buckets. The n-gram count table is their sum by n-gram, partitioned by that hash; a bucket's part of
it is made and looked up at once for the entries of all blocks, and what an n-gram counts beyond its
block returns to the block, which looks up the score of each word and sums them per document.

The model is the corpus without the document itself (leave one out): under its own counts every n-gram of a document would be
known, and nothing would ever back off. With c the corpus count less the document's own count, the score of a word after its
context of up to order - 1 words is c(context word) / c(context) for the longest context with c(context word) >=
min_count, times BACKOFF for each context word given up. A word alone has max(c(word), 1) / words of the other documents.
Words: maximal runs without [\\x20\\x09-\\x0D], A-Z in lower case.

An n-gram is asked for only where the two shorter ones that it is made of occur in other documents; otherwise it can't occur there
itself, so nothing is lost. An n-gram is known by 64 bits of one hash inside a bucket, which is chosen by another; the
more n-grams, the more buckets, so the chance that two are taken for one falls as the corpus grows.

No key is hot: a block has an n-gram once, whatever its frequency, so a bucket has some BUCKET_WORDS entries of n-grams, however large the corpus is.
Beyond GROUP_BLOCKS blocks, where one n-gram's entries alone could be a third of that, they are laid out as rows, which are added up within groups of
that many blocks first, then over the groups, and joined to the sums.

Defined results: null and empty texts have no words, log score 0 and no mean; repeated rows are documents of their own, so each is
known to the model of the other; a very long text is a block of its own; a corpus of one document has the
score of unknown words; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import discard, materialize, materialize_by

BACKOFF = 0.4
#: Words of a block, beyond which it takes no more documents.
BLOCK_WORDS = 400_000
#: Words of the corpus for each bucket, and the least number of buckets, as a power of two. Each block has an entry in each bucket, so buckets are few and
#: large, or the entries would grow with the square of the corpus; a bucket's arrays take some 100 MB of a Python worker.
BUCKET_WORDS = 2_000_000
BUCKET_BITS = 7
#: Blocks whose entries of one n-gram are added up at once.
GROUP_BLOCKS = 1 << 16
#: Blocks, or buckets, in a batch that goes to Python.
BLOCKS_AT_ONCE = 1
#: Rows and counts lie together by bucket and part already, so the join on n-grams needs no exchange of its own; and a task's lists,
#: which hold what it has read, need no sort.
IN_PLACE = {"requireAllClusterKeysForCoPartition": "false", "objectHashAggregate.sortBased.fallbackThreshold": "1000000"}
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def token_blocks(docs: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """ids (array), sizes (bytes of each text and the blank after it), text (their bytes, in lower case), n (words): a row for each block."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        texts: list[bytes] = []
        n = 0

        def block() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            first = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            cells = [np.array([len(t) + 1 for t in texts], "<i8").tobytes(), b" ".join([*texts, b""]).translate(_LOWER)]
            return pa.RecordBatch.from_arrays([first, *[pa.array([c], pa.binary()) for c in cells], pa.array([n], pa.int64())], ["ids", "sizes", "text", "n"])

        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                texts.append((text or "").encode())
                ids.append(batch.column(0).slice(i, 1))
                n += len(_words(np.frombuffer(texts[-1], np.uint8))[0])
                if n >= block_words:
                    yield block()
                    ids, texts, n = [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"ids array<{kind.simpleString()}>, sizes binary, text binary, n long")


def _words(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (bytes) begin, and where they end."""
    inside = np.zeros(len(text) + 2, bool)
    # wraps around: 9 to 13 become 0 to 4
    inside[1:-1] = (text != 32) & (text - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return (x ^ (x >> np.uint64(27))) * _MIX2


def _hashes(text: bytes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each word. Words of up to 15 bytes are those bytes and their number, dealt over the 128 bits one to one, so no two of them share
    a hash; longer ones are hashed."""
    cells = np.frombuffer(text.ljust(len(text) // 8 * 8 + 24, b"\0"), "<u8")
    size, cell, shift = ends - begins, begins >> 3, ((begins & 7) << 3).astype(np.uint64)
    a, b, c = cells[cell], cells[cell + 1], cells[cell + 2]
    back = np.uint64(64) - shift
    # numpy shifts by 64 to zero
    low = ((a >> shift) | (b << back)) & _FIRST_BYTES[np.minimum(size, 8)]
    high = ((b >> shift) | (c << back)) & _FIRST_BYTES[np.clip(size - 8, 0, 7)] | (size.astype(np.uint64) << np.uint64(56))
    high ^= _mixed(low)
    low ^= _mixed(high)
    high ^= _mixed(low)
    long = np.flatnonzero(size > 15)
    if len(long):
        digests = b"".join(xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(begins[long].tolist(), ends[long].tolist(), strict=True))
        low[long], high[long] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
    return low, high


def _sorted(key: np.ndarray) -> np.ndarray:
    """The order that puts equal keys together, each as they came."""
    bits = np.uint64(max(1, len(key) - 1).bit_length())
    places = np.uint64((1 << int(bits)) - 1)
    # the upper bits of a key with its place below them: sorting numbers is several times faster than sorting places
    packed = (key & ~places) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & places).astype(np.int64)
    apart = key[order]
    apart = apart[1:] ^ apart[:-1]
    # two keys that differ in the lower bits alone may lie mixed up
    return np.argsort(key, kind="stable") if ((apart > 0) & (apart <= places)).any() else order


class Block:
    """The words of some documents, and what the corpus has answered so far: {order: (bucket, place in it, count) arrays}."""

    def __init__(self, sizes: bytes, text: bytes, bits: int, answers: dict[int, tuple[np.ndarray, ...]]):
        self.bits, self.answers = bits, answers
        begins, ends = _words(np.frombuffer(text, np.uint8))
        self.hashes = _hashes(text, begins, ends)
        self.sizes = np.diff(np.searchsorted(begins, np.cumsum(np.frombuffer(sizes, "<i8"))), prepend=0)
        self.document = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(begins)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def orders(self, last: int) -> Iterator[tuple[dict, np.ndarray | None]]:
        """Order by order the distinct n-grams to ask for and, where they are answered, how often the n-gram that ends at
        each word occurs in other documents."""
        key = self.hashes
        asked = np.arange(len(self.place))
        for k in range(1, last + 1):
            order = _sorted(key[1][asked])
            at = asked[order]
            dealt = key[1][at]
            new = dealt[1:] != dealt[:-1]
            first, counts = _runs(new, len(at))
            found = {"keys": key[0][at[first]].view(np.int64), "counts": counts, "bucket": (dealt[first] >> np.uint64(64 - self.bits)).astype(np.int64)}
            outside = None
            if k in self.answers:
                bucket, place, count = self.answers[k]
                totals = counts.copy()
                totals[np.searchsorted(found["bucket"], bucket) + place] = count
                document = self.document[at]
                own = _runs(new | (document[1:] != document[:-1]), len(at))[1]
                outside = np.zeros(len(self.place), np.int64)
                outside[at] = np.repeat(totals, counts) - np.repeat(own, own)
                # the n-gram that ends here: the shorter one that ended a word earlier, and this word
                asked = 1 + np.flatnonzero((self.place[1:] >= k) & (outside[1:] > 0) & (outside[:-1] > 0))
                key = tuple(_longer(h, w) for h, w in zip(key, self.hashes, strict=True))
            yield found, outside

    def scores(self, order: int, min_count: int, total: int) -> np.ndarray:
        """The sum of each document's logarithms."""
        outside = [o for _, o in self.orders(order)]
        others = np.maximum(total - self.sizes[self.document], 1)
        context = np.minimum(self.place, order - 1)
        logs = np.log(np.maximum(outside[0], 1) / others) + context * math.log(BACKOFF)
        done = np.zeros(len(logs), bool)
        for k in range(order, 1, -1):
            now = np.flatnonzero(~done & (outside[k - 1] >= min_count))
            logs[now] = np.log(outside[k - 1][now] / outside[k - 2][now - 1]) + (context[now] + 1 - k) * math.log(BACKOFF)
            done[now] = True
        return np.bincount(self.document, logs, minlength=len(self.sizes))


def _runs(new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n things of which all but the first say whether something new begins: where runs begin, and their lengths."""
    first = np.flatnonzero(np.concatenate([np.ones(min(n, 1), bool), new]))
    return first, np.diff(first, append=n)


def _longer(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = key.copy()
    out[1:] = (key[:-1] ^ (key[:-1] >> np.uint64(29))) * _MIX + word[1:]
    return out ^ (out >> np.uint64(32))


def _blocks_of(batch: pa.RecordBatch, bits: int) -> Iterator[Block]:
    for r in range(batch.num_rows):
        got: dict[int, tuple[np.ndarray, ...]] = {}
        for name in batch.schema.names:
            if not name.startswith("answers"):
                continue
            column = batch.column(name)
            # an answer of nothing is one, too: whatever the block asked for occurs nowhere else
            got[int(name[7:])] = (np.zeros(0, np.int64),) * 3
            if column[r].is_valid:
                parts = column.slice(r, 1).flatten()
                bucket, at, count = (parts.field(i) for i in range(3))
                got[int(name[7:])] = np.repeat(bucket.to_numpy(), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy(), count.flatten().to_numpy()
        yield Block(*(batch.column(c)[r].as_py() for c in ("sizes", "text")), bits, got)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets with their blocks' entries: what `_counted` says of each."""
    for batch in batches:
        for r in range(batch.num_rows):
            block, keys, counts = batch.column("entries").slice(r, 1).flatten().flatten()
            size = np.diff(keys.offsets.to_numpy())
            n = counts.flatten().to_numpy()
            codes, distinct = pd.factorize(keys.flatten().to_numpy())
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, codes, n)
            total = total[codes]
            at = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
            kept = total > n
            left = np.bincount(np.repeat(np.arange(len(size)), size)[kept], minlength=len(size))
            some = np.flatnonzero(left)
            offsets = pa.array(np.append(0, np.cumsum(left[some])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (at[kept].astype(np.int32), total[kept])]
            yield pa.RecordBatch.from_arrays([block.take(pa.array(some)), pa.array(np.repeat(batch.column("bucket")[r].as_py(), len(some)), pa.int64()), *lists], ["block", "bucket", "at", "count"])


def _counted(entries: DataFrame, groups: int) -> DataFrame:
    """From entries (bucket, part, block, keys, counts): for each block and bucket the places (`at`) and counts of those
    n-grams that occur in other blocks as well."""
    if groups == 1:
        # of one group, the part is no key
        whole = entries.repartition("bucket").groupBy("bucket").agg(F.collect_list(F.struct("block", "keys", "counts")).alias("entries"))
        return whole.mapInArrow(_count, "block long, bucket long, at array<int>, count array<long>")
    place = ["bucket", "part"]
    dealt = entries.repartition(*place)
    rows = dealt.select(*place, "block", F.posexplode("keys").alias("at", "key"), "counts").withColumn("n", F.get("counts", F.col("at"))).drop("counts")
    # the counts ask for the block, too, so that Spark sees that both sides of the join read the same exchange
    table = materialize(rows.groupBy(*place, "key").agg(F.sum("n").alias("count"), F.max("block").alias("some_block")).where("some_block is not null").drop("some_block"))
    whole = table.groupBy("bucket", "key").agg(F.sum("count").alias("whole"))
    table = table.join(whole, ["bucket", "key"]).select("bucket", "part", "key", F.col("whole").alias("count"))
    joined = rows.join(table.hint("shuffle_hash"), [*place, "key"]).where("count > n")
    return joined.groupBy(*place, "block").agg(F.collect_list("at").alias("at"), F.collect_list("count").alias("count")).select("block", "bucket", "at", "count")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, min_count: int = 1, block_words: int = BLOCK_WORDS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """A row for each document: id_col, n_tokens, log_score (natural logarithm, summed), mean_log_score."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize_by(token_blocks(docs, id_col, text_col, block_words).withColumn("block", F.monotonically_increasing_id()).repartition(buckets, "block"), "block", buckets, codec="zstd")
    n_blocks, total = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(1, total / BUCKET_WORDS))))
    groups = max(1, math.ceil(n_blocks / group_blocks))
    answers: list[DataFrame] = []

    def answered() -> DataFrame:
        """The blocks with the answers so far, one column an order; all tables lie in buckets by block."""
        every = blocks.drop("n")
        for table in answers:
            every = every.join(table, "block", "left")
        return every

    def ask(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, block in zip(batch.column("block").to_pylist(), _blocks_of(batch, bits), strict=True):
                    *_, (found, _) = block.orders(k)
                    begins, _ = _runs(np.diff(found["bucket"]) > 0, len(found["bucket"]))
                    full = found["bucket"][begins]
                    offsets = pa.array(np.append(begins, len(found["keys"])).astype(np.int32))
                    keys, counts = (pa.ListArray.from_arrays(offsets, pa.array(found[c].astype(t))) for c, t in (("keys", np.int64), ("counts", np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(np.full(len(full), number, np.int64)), keys, counts], ["bucket", "block", "keys", "counts"])

        return run

    for k in range(1, order + 1):
        entries = answered().drop("ids").mapInArrow(ask(k), "bucket long, block long, keys array<long>, counts array<int>")
        if groups > 1:
            entries = entries.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)))
        by_block = _counted(entries, groups).groupBy("block").agg(F.collect_list(F.struct("bucket", "at", "count")).alias(f"answers{k}"))
        answers.append(materialize_by(by_block, "block", buckets, BLOCKS_AT_ONCE, codec="zstd", **IN_PLACE))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_blocks_of(batch, bits)):
                sums, size = block.scores(order, min_count, total), block.sizes
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = pa.array(sums / size, pa.float64(), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(size, pa.int64()), pa.array(sums), mean], ["id", "n_tokens", "log_score", "mean_log_score"])

    scores = materialize(answered().mapInArrow(score, f"id {kind}, n_tokens long, log_score double, mean_log_score double"), BLOCKS_AT_ONCE)
    discard(blocks, *answers)
    return scores.withColumnRenamed("id", id_col)
