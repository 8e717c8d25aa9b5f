"""Phrase collocation mining with compressed position bitmaps.

The corpus is cut into shards of whole documents. In a shard every word has a bitmap of the positions where it stands, with unused
positions between pieces and documents, of which only the blocks that hold a bit are kept. A phrase's bitmap marks where its last word
stands: shifted by one position and ANDed with the bitmap of a word, it becomes that of the phrase with the word behind it, whose
popcount is its number of occurrences in the shard; overlaps count, and no phrase reaches over a gap. Extension goes depth
first: a group of words that phrases begin with is extended to the end before the next group, so only its bitmaps are held.

Counts are summed over the shards, length by length: phrases of two words are made of words that the whole corpus holds `least` times, and
phrases of three and four of overlapping pairs that it holds as often, as every part of a frequent phrase is frequent itself. The words
and pairs that a shard may use come to it by joins on the shard; no vocabulary is broadcast. Phrases are known by their words' numbers.

Scores are integers: floor(2000000 a / (l + r)) of the worst cut, in decimal arithmetic, as products may pass 64 bits.

Defined results: a null text counts as empty, a null lang as `und`; texts without words add nothing; repeated rows count one by one; a very long text lies whole in
one shard, its words being read in pieces; ties go to the higher count, then the smaller phrase in byte order; empty tables give an empty result;
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, materialize

#: A shard is closed at so many words.
SHARD_WORDS = 2_000_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Word entries that are compared at once while a group of phrases is extended.
AT_ONCE = 1_000_000
#: Positions of a block, and its type.
BITS, BLOCK = 16, np.uint16
LONGEST = 4

# Every byte that ends a piece becomes 0xFF, which no UTF-8 text holds; blanks and tabs part words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_ENDS + b"\t" + bytes(range(0x41, 0x5B)), b"\xff" * len(_ENDS) + b" " + bytes(range(0x61, 0x7B)))
_GAP = b"\xff"


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text in order, with _GAP where a piece ends, a list for each stretch of it."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        # bytes.split() parts at ASCII white space alone; all of it but blanks has been mapped
        yield data[at:end].replace(_GAP, b" \xff ").split()
        at = end


def _packed(tokens: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes, of which the higher ones are nearly empty; how many there are comes first."""
    planes = np.ascontiguousarray(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(tokens).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


class _Shard:
    """The words of a shard that is being filled: numbers from 1 for each word of a language, 0 for a gap."""

    def __init__(self):
        self.next = count(1)
        self.numbers: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.words = 0

    def add(self, lang: str, text: str) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = defaultdict(self.next.__next__, {_GAP: 0})
        number = self.numbers[lang].__getitem__
        for words in word_lists(text):
            self.parts.append(np.fromiter(map(number, words), np.int32, len(words)))
            self.words += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def batch(self, number: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        known = [(i, lang, word) for lang, own in self.numbers.items() for word, i in own.items() if i]
        counts = np.bincount(tokens, minlength=len(known) + 1)
        # numbered anew, frequent words first
        order = np.argsort(-counts[1:], kind="stable") + 1
        place = np.zeros(len(counts), np.int32)
        place[order] = np.arange(1, len(counts))
        known.sort(key=lambda k: place[k[0]])
        words = pa.array([w for _, _, w in known], pa.binary()).cast(pa.string())
        langs = pa.array([lang for _, lang, _ in known], pa.string())
        counts = pa.array(counts[order], pa.int64())
        lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (langs, words, counts)]
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([_packed(place[tokens])], pa.binary()), *lists], ["shard", "tokens", "langs", "words", "counts"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, shard = TaskContext.get().partitionId() << 32, _Shard()
    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            shard.add(lang.as_py(), text.as_py())
            if shard.words >= SHARD_WORDS:
                yield shard.batch(number)
                number, shard = number + 1, _Shard()
    if shard.words:
        yield shard.batch(number)


class Bitmaps:
    """The compressed position bitmaps of a shard's words, numbered from 1 to `words`: entries (block, word, bits), block by block."""

    def __init__(self, tokens: np.ndarray, words: int):
        at = np.flatnonzero(tokens)
        key = np.sort(((at // BITS) * (words + 1) + tokens[at]) * BITS + at % BITS)
        entry = key // BITS
        begins = np.flatnonzero(np.diff(entry, prepend=-1))
        bits = np.left_shift(1, key % BITS).astype(BLOCK)
        self.bits = np.bitwise_or.reduceat(bits, begins) if len(begins) else bits
        self.block, self.word = (x.astype(np.int32) for x in np.divmod(entry[begins], words + 1))
        self.first = np.searchsorted(self.block, np.arange(len(tokens) // BITS + 3))
        self.words = words

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The words' bitmaps as phrases of one word, in groups by word: word, block and bits of each entry."""
        order = np.argsort(self.word, kind="stable")
        word, block, bits = self.word[order], self.block[order], self.bits[order]
        bounds = np.append(np.flatnonzero(np.diff(word)) + 1, len(word))
        work = np.cumsum(np.diff(self.first)[block])[bounds - 1] if len(word) else bounds
        at = i = 0
        while at < len(word):
            i = max(i + 1, int(np.searchsorted(work, (work[i - 1] if i else 0) + AT_ONCE, "right")))
            end = bounds[i - 1]
            yield word[at:end], block[at:end], bits[at:end]
            at = end

    def extend(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The entries of all phrases of one more word: node, word, block and bits. Bits are shifted by one position,
        over the end of a block into the next, and ANDed with those of the words that have an entry there."""
        on, over = (bits << 1).astype(BLOCK), (bits >> (BITS - 1)).astype(BLOCK)
        here, there = np.flatnonzero(on), np.flatnonzero(over)
        node = np.concatenate([node[here], node[there]])
        block = np.concatenate([block[here], block[there] + 1])
        bits = np.concatenate([on[here], over[there]])
        out: list[tuple] = []
        met = self.first[block + 1] - self.first[block]
        work = np.cumsum(met)
        at = 0
        while at < len(block):
            # at most AT_ONCE pairs of entries; a single entry meets BITS words at most
            end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + AT_ONCE, "right")))
            of = np.repeat(np.arange(at, end), met[at:end])
            entry = np.arange(len(of)) + np.repeat(self.first[block[at:end]] - (np.cumsum(met[at:end]) - met[at:end]), met[at:end])
            common = bits[of] & self.bits[entry]
            some = np.flatnonzero(common)
            out.append((node[of[some]], self.word[entry[some]], block[of[some]], common[some]))
            at = end
        if not out:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, BLOCK))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _children(node: np.ndarray, word: np.ndarray, bits: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent, last word and number of occurrences of each phrase among the entries, and the phrase of each entry."""
    key, own = np.unique(node.astype(np.int64) * (words + 1) + word, return_inverse=True)
    counts = np.bincount(own, np.bitwise_count(bits), len(key)).astype(np.int64)
    return key // (words + 1), key % (words + 1), counts, own


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, their lists as arrays."""
    for r in range(batch.num_rows):
        values = {c: batch.column(c)[r] for c in batch.schema.names}
        yield {c: v.values.to_numpy(zero_copy_only=False) if pa.types.is_list(v.type) else v.as_py() for c, v in values.items()}


def _shard_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A shard's tokens as numbers from 1 of the frequent words, 0 for all else, and those words' numbers in the corpus."""
    tokens = _unpacked(row["tokens"])
    number = np.zeros(max(int(tokens.max(initial=0)), int(row["local"].max(initial=0))) + 1, np.int64)
    number[row["local"]] = np.arange(1, len(row["local"]) + 1)
    return number[tokens], np.concatenate([[0], row["ids"]])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            tokens, ids = _shard_of(row)
            maps = Bitmaps(tokens, len(ids) - 1)
            for node, block, bits in maps.groups():
                node, word, _, bits = maps.extend(node, block, bits)
                a, b, n, _ = _children(node, word, bits, maps.words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["shard"])), pa.array(ids[a]), pa.array(ids[b]), pa.array(n)], ["shard", "a", "b", "n"])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the phrases of three and four words all of whose pairs are frequent."""
    for batch in batches:
        for row in _rows(batch):
            tokens, ids = _shard_of(row)
            maps = Bitmaps(tokens, len(ids) - 1)
            order = np.argsort(ids[1:], kind="stable") + 1
            local = lambda x: order[np.searchsorted(ids[order], x)]  # noqa: B023, E731
            allowed = np.sort(local(row["firsts"]) * (maps.words + 1) + local(row["seconds"]))
            for node, block, bits in maps.groups():
                phrases, last = [node], node
                for length in range(2, LONGEST + 1):
                    node, word, block, bits = maps.extend(node, block, bits)
                    key = (last[node] if length > 2 else node).astype(np.int64) * (maps.words + 1) + word
                    at = np.minimum(np.searchsorted(allowed, key), len(allowed) - 1)
                    known = np.flatnonzero(allowed[at] == key)
                    node, word, block, bits = node[known], word[known], block[known], bits[known]
                    if not len(node):
                        break
                    parent, last, n, node = _children(node, word, bits, maps.words)
                    phrases = [parent, last] if length == 2 else [*[p[parent] for p in phrases], last]
                    if length > 2:
                        columns = [pa.array(ids[p]) for p in phrases] + [pa.nulls(len(n), pa.int64())] * (LONGEST - length)
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], ["a", "b", "c", "d", "n"])


def frequent_phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: all words and phrases of up to four words that a language holds `least` times or more (ids:
    array<long>, f), what their words are (id, lang, word), and how many words each language has (lang, n)."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    shards = materialize(rows.mapInArrow(_read, "shard long, tokens binary, langs array<string>, words array<string>, counts array<long>"), codec="zstd")
    of_shard = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("local", "w"))
    vocabulary = of_shard.select("shard", (F.col("local") + 1).alias("local"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    sizes = materialize(vocabulary.groupBy("lang").agg(F.sum("n").alias("n")))
    totals = vocabulary.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    listed = materialize(totals.select(F.monotonically_increasing_id().alias("at"), "lang", "word", "f"))
    # dealt in turn over the partitions, so that numbers are small: the upper bits name the partition, the lower 33 the row
    parts = (listed.agg(F.max(F.shiftright("at", 33))).first()[0] or 0) + 1
    words = listed.select((F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.shiftright("at", 33)).alias("id"), "lang", "word", "f")

    own = vocabulary.select("shard", "local", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"])
    own = own.groupBy("shard").agg(F.collect_list(F.struct("local", "id")).alias("w"))
    texts = materialize(shards.select("shard", "tokens").join(own, "shard").select("shard", "tokens", F.col("w.local").alias("local"), F.col("w.id").alias("ids")), codec="zstd")
    discard(shards)
    counted = texts.mapInArrow(_pairs, "shard long, a long, b long, n long")
    whole = F.sum("n").over(Window.partitionBy("a", "b"))
    pairs = materialize(counted.withColumn("f", whole).where(F.col("f") >= least).select("shard", "a", "b", "f"), 1)
    in_shard = pairs.groupBy("shard").agg(F.collect_list(F.struct("a", "b")).alias("p"))
    to_extend = texts.join(in_shard, "shard").select("*", F.col("p.a").alias("firsts"), F.col("p.b").alias("seconds")).drop("p")
    longer = to_extend.mapInArrow(_longer, "a long, b long, c long, d long, n long").groupBy("a", "b", "c", "d").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    longer = materialize(longer.select(F.array_compact(F.array("a", "b", "c", "d")).alias("ids"), "f"), 1)
    short = words.select(F.array("id").alias("ids"), "f").unionByName(pairs.groupBy("a", "b").agg(F.max("f").alias("f")).select(F.array("a", "b").alias("ids"), "f"))
    phrases = materialize(short.unionByName(longer))
    discard(texts, pairs, longer)
    return phrases, words, sizes


def _score(a: Column, both: Column) -> Column:
    """floor(2000000 a / both), exact beyond 64 bits."""
    whole = F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", whole, both.cast("decimal(20,0)")).cast("long")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000, within: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases. A phrase inside a longer one that has `within` hundredths of its occurrences or more is left out."""
    phrases, words, sizes = frequent_phrases(docs, least, text_col, lang_col)
    candidates = phrases.where(F.size("ids") >= 2).select("ids", F.col("f").alias("a"))
    parts = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    parts = parts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids")))
    cuts = parts.join(phrases.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(phrases.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    cuts = cuts.withColumn("cut", F.struct(_score(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")).alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("ids", "a").agg(F.min("cut").alias("cut"))
    # what lies in a phrase of two words more lies in one of one word more that is as frequent
    inner = candidates.where(F.size("ids") > 2).select("a", F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))).alias("ids"))
    around = inner.groupBy("ids").agg(F.max("a").alias("around"))
    hundred = lambda c, by: F.col(c).cast("decimal(19,0)") * F.lit(by).cast("decimal(3,0)")
    kept = scored.join(around, "ids", "left").where(F.col("around").isNull() | (hundred("around", 100) < hundred("a", within)))
    kept = kept.select("ids", "a", "cut.score", "cut.l", "cut.r", F.get("ids", F.lit(0)).alias("id")).join(words.select("id", "lang"), "id").drop("id")
    # all that the first `most` can be among, ties included, before the words are looked up
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialize(kept.withColumn("near", F.rank().over(best)).where(F.col("near") <= most).drop("near"))
    spelt = near.select("ids", F.posexplode("ids").alias("pos", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = near.join(spelt, "ids").withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= most)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
