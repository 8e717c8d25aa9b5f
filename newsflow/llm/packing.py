"""Packing of token sequences: shortest pack first over the histogram of lengths.

Documents are cut at multiples of the sequence length; what remains is packed. Only the histogram (at most `width` counts,
whatever the input) reaches the driver. Lengths are placed longest first, all pieces of a length by counts, onto the shortest
open packs. The plan is a list of patterns with counts; ranks of equally long pieces join them back to the documents.

Defined results: a null text counts as empty, and an empty text is the end id alone; repeated rows are packed one by
one; an empty table gives an empty result; a very long text is tokenised whole and cut into many pieces; extra columns of the pieces are kept, but
for ones named sequence_id or offset, which give way to the result's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsflow.llm.common import materialize

WIDTH = 2048
#: Intervals of a plan (48 bytes each) that are broadcast.
BROADCAST_SLOTS = 100_000
#: Texts of these characters alone, and without a special token, are encoded by tiktoken, whose ids are the same there.
PLAIN = re.compile(r"[\t\n\r -~¡-¬®-ſ‐-‧€]*")
SPECIAL = "<|endoftext|>"

_ENCODERS: dict[str, tuple] = {}


def _encoders(path: str):
    """The tokenizers library's tokenizer, and a faster encoder with the same vocabulary, splits and merges."""
    if path not in _ENCODERS:
        import json

        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = {x["id"] for x in model.get("added_tokens", [])}
        # byte-level vocabularies write every byte as one printable character
        byte_of = {}
        spare = 256
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
                byte_of[chr(b)] = b
            else:
                byte_of[chr(spare)], spare = b, spare + 1
        assert set(byte_of) == set(ByteLevel.alphabet())
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in added}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("plain", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        _ENCODERS[path] = exact, fast
    return _ENCODERS[path]


def encode_ids(texts: list[str], tokenizer: str) -> Iterator[list[int]]:
    exact, fast = _encoders(tokenizer)
    for text in texts:
        yield fast.encode_ordinary(text) if SPECIAL not in text and PLAIN.fullmatch(text) else exact.encode(text, add_special_tokens=False).ids


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = 1) -> DataFrame:
    """Pieces of at most `width` ids: id_col, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, rows, start, length, total, ids = [x or "" for x in part.column(1).to_pylist()], [], [], [], [], []
                for row, got in enumerate(encode_ids(texts, tokenizer)):
                    all_ids = np.array([*got, end_id], "<u4")
                    for s in range(0, len(all_ids), width):
                        own = all_ids[s : s + width]
                        rows.append(row), start.append(s), length.append(len(own)), total.append(len(all_ids)), ids.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, f"id {kind}, start long, length long, doc_tokens long, ids binary").withColumnRenamed("id", id_col)


def plan_packs(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack's pieces) and how many packs have each.

    Lengths are placed longest first, all pieces of one length by counts: each takes a place in the shortest open packs, that is
    those with the most room, and opens new packs only when none has room for it."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:
                open_.setdefault(width - length, {})[(length,)] = left
                break
            pattern, count = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            if count > left:
                open_.setdefault(room, {})[pattern] = count - left
            filled = min(count, left)
            to = open_.setdefault(room - length, {})
            to[pattern + (length,)] = to.get(pattern + (length,), 0) + filled
            left -= filled
    return [(p, n) for by in open_.values() for p, n in by.items()]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces a sequence, offset): the pieces with rank first .. first + ranks of
    their length lie in consecutive sequences, a fixed number in each."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, n in sorted(plan):
        offset, at = 0, 0
        while at < len(pattern):
            length, per = pattern[at], pattern.count(pattern[at])
            first = used.get(length, 0)
            out.append((length, first, n * per, sequence, per, offset))
            used[length] = first + n * per
            offset, at = offset + per * length, at + per
        sequence += n
    return out


def pack(pieces: DataFrame, width: int = WIDTH, length_col: str = "length") -> DataFrame:
    """pieces with sequence_id (gapless from 0) and offset. pieces is written once, as its histogram comes before its packs."""
    spark: SparkSession = pieces.sparkSession
    rows = materialize(pieces.withColumn("__nf_rid", F.monotonically_increasing_id()))
    histogram = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}
    slots = _slots(plan_packs(histogram, width))
    schema = "__nf_length long, first long, ranks long, sequence long, per long, at long"
    plan = spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in slots], schema)
    # ranks among equally long pieces: numbers within small parts, and running sums of the parts' sizes
    parts = max(64, sum(histogram.values()) // 1_000_000)
    rows = rows.withColumn("__nf_part", F.pmod(F.xxhash64("__nf_rid"), F.lit(parts)).cast("int")).withColumn("__nf_length", F.col(length_col))
    sizes = rows.groupBy("__nf_length", "__nf_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__nf_length").orderBy("__nf_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__nf_length", "__nf_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__nf_base"))
    own = Window.partitionBy("__nf_length", "__nf_part").orderBy("__nf_rid")
    ranked = rows.withColumn("__nf_nth", F.row_number().over(own)).join(bases, ["__nf_length", "__nf_part"]).withColumn("__nf_rank", F.col("__nf_base") + F.col("__nf_nth") - 1)
    # the plan's intervals of ranks, as one array a length; they are broadcast while they are few, and joined by a shuffle beyond that
    by_length = plan.groupBy("__nf_length").agg(F.array_sort(F.collect_list(F.struct("first", "ranks", "sequence", "per", "at"))).alias("__nf_plan"))
    found = ranked.join(F.broadcast(by_length) if len(slots) <= BROADCAST_SLOTS else by_length, "__nf_length")
    mine = F.element_at(F.filter("__nf_plan", lambda x: x["first"] <= F.col("__nf_rank")), -1)
    found = found.withColumn("__nf_mine", mine).withColumn("__nf_i", F.col("__nf_rank") - F.col("__nf_mine.first"))
    kept = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    return found.select(*[F.col(f"`{c}`") for c in kept], (F.col("__nf_mine.sequence") + F.floor(F.col("__nf_i") / F.col("__nf_mine.per"))).cast("long").alias("sequence_id"), (F.col("__nf_mine.at") + F.pmod(F.col("__nf_i"), F.col("__nf_mine.per")) * F.col("__nf_length")).cast("long").alias("offset"))
