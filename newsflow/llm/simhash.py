"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints meet in tables, each sorted by a key made of some of the bits. For small radii the keys are choices of whole parts of
the fingerprint, so that every pair within the radius shares a key of at least one table (`exact_keys`); for wide ones they are samples of bits, as
many tables as let all but MISSED of the pairs at similarity 0.8 meet (`sampled_keys`). The more fingerprints, the longer the
keys, so that the rows that share one stay few. Every table is cut into blocks of up to BLOCK consecutive rows, which are stored
vertically: one plane for each bit, 64 rows a word. Comparing a block with another updates the distances of 64 rows at
once with carry-save counters and abandons words in which all distances exceed the radius. A key with more rows than a block fills
several blocks, which are compared pair by pair; these pairs are spread over all tasks. A comparison returns only links between
groups that are not known to be connected yet, so the rows that leave a block never outnumber its fingerprints.

`near_duplicates` links 64-bit fingerprints at 4 or fewer differing bits, without loss. `drop_near_duplicates` is for shingle
similarity (Jaccard) of 0.8 and more, where 64 bits say too little: pairs of 256-bit fingerprints, of which 15 in 100 bits are expected to
differ at 0.8, are candidates at WIDE_RADIUS or fewer. Among the texts that candidates connect, all pairs within the radius are then
compared by their sets of shingles (as 64-bit hashes), and only those at LEAST or more are links.

Defined results: a null text counts as empty; texts without words have one common fingerprint (zero in `near_duplicates`) and are
linked like any other; repeated rows fall into one class; null ids take part but are never the smallest (a class of null
ids alone has a null class id); an empty table gives an empty result; extra columns are ignored (`near_duplicates`) or kept (`drop_near_duplicates`).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsflow.llm.common import discard, join_hot, materialize, rows_by_id
from newsflow.llm.graph import components

RADIUS = 4
WIDE_RADIUS, WIDE_WORDS = 48, 4
#: The least Jaccard similarity of near-duplicates, as a fraction.
LEAST = (4, 5)
#: Share of differing bits at similarity 0.8, and of the pairs there that may share no key.
DIFFER, MISSED = 0.152, 0.01
BLOCK = 1024
#: Rows that share a key of a table, on average, at most; wide fingerprints are compared in larger groups, as they need more tables.
SHARED, WIDE_SHARED = 256, 4096
#: Shingles that count like one row of a block.
SHINGLES = 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash."""
    h = (h + _STEP) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """A hash for each shingle, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()  # bytes split at [\x20\x09-\x0D]+
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    begins, ends = (ends - sizes)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begins, ends, strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = 4, width: int = 1) -> np.ndarray:
    """width x 64 bits. A bit is 1 if set in over half the shingles' hashes. For wide fingerprints, which stand for sets of shingles,
    repeats count once, and with few shingles ties, frequent there, fall by the text's own hash instead, so that short texts stay apart."""
    hashes = shingle_hashes(text, shingle)
    return _voted(hashes if width == 1 else np.unique(hashes), width)


def _voted(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64) if width == 1 else _mixed(np.arange(width, dtype=np.uint64))
    out = np.zeros(width, np.uint64)
    for w in range(width):
        if w:
            hashes = _mixed(hashes)
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 14):
            part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
        if width > 1 and n <= 8:
            out[w] |= np.packbits(2 * ones == n, bitorder="little").view("<u8")[0] & _mixed(hashes.sum(keepdims=True))[0]
    return out


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", shingle: int = 4, width: int = 1) -> DataFrame:
    """The columns `keep` and `fp`, the fingerprint's words as big-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(x.as_py(), shingle, width).astype(">u8").tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got, pa.binary())], [*batch.schema.names[1:], "fp"])

    rows = docs.select(F.col(text_col).alias("__nf_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, fp binary")


def _with_sets(docs: DataFrame, text: Column, keep: list[Column], shingle: int, whole: bool) -> DataFrame:
    """The columns `keep`, and the text's set of shingles: as sorted 64-bit hashes (`whole`), or as their digest `set` and the wide fingerprint `fp`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in batch.column(0)]
            sets = [h.astype("<u8").tobytes() for h in hashes]
            made = {"set": sets} if whole else {"set": [xxhash.xxh3_128_digest(x) for x in sets], "fp": [_voted(h, WIDE_WORDS).astype(">u8").tobytes() for h in hashes]}
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(x, pa.binary()) for x in made.values()]], [*batch.schema.names[1:], *made])

    rows = docs.select(text.alias("__nf_text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, set binary" if whole else f"{kinds}, set binary, fp binary")


def _bits(fps: np.ndarray) -> np.ndarray:
    """fps (n, width) as n rows of width x 64 bits."""
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of ceil(n / 64) words; lane i of plane b is bit b of fps[i]."""
    bits = np.pad(_bits(fps), ((0, -len(fps) % 64), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def fingerprints_of(sliced: np.ndarray, n: int) -> np.ndarray:
    """The n fingerprints that bit planes were made of."""
    bits = np.unpackbits(sliced.view(np.uint8), axis=1, bitorder="little")[:, :n]
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _full(a, b, c):
    """Carry-save: three bits to a sum and a carry."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (bits from the lowest, then an overflow that sticks) is above the radius."""
    above, equal = counter[-1], ~counter[-1]
    for i in range(len(counter) - 2, -1, -1):
        if radius >> i & 1:
            equal = equal & counter[i]
        else:
            above, equal = above | (equal & counter[i]), equal & ~counter[i]
    return above


def within_radius(queries: np.ndarray, sliced: np.ndarray, n: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of (query, lane) pairs at the radius or nearer. queries: fingerprints (m, width); sliced: bit planes of n others."""
    count, words = sliced.shape
    qi, wi = np.divmod(np.arange(len(queries) * words), words)
    counter = [np.zeros(len(qi), np.uint64) for _ in range(max(3, radius.bit_length()) + 1)]
    qbits = np.where(_bits(queries).T, _ONES, np.uint64(0))
    dense = True
    for first in range(0, count, 7):
        group = range(first, min(first + 7, count))
        if dense:
            x = [(sliced[p][None, :] ^ qbits[p][:, None]).ravel() for p in group]
        else:
            x = [sliced[p][wi] ^ qbits[p][qi] for p in group]
        x += [np.zeros(len(qi), np.uint64)] * (7 - len(x))
        s1, c1 = _full(x[0], x[1], x[2])
        s2, c2 = _full(x[3], x[4], x[5])
        s3, c3 = _full(s1, s2, x[6])
        twos, fours = _full(c1, c2, c3)
        counter[0], carry = counter[0] ^ s3, counter[0] & s3
        counter[1], carry = _full(counter[1], carry, twos)
        counter[2], carry = _full(counter[2], carry, fours)
        for i in range(3, len(counter) - 1):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        counter[-1] = counter[-1] | carry
        if first + 7 >= 28 and first + 7 > 2.6 * radius:
            alive = np.flatnonzero(_exceeds(counter, radius) != _ONES)
            if len(alive) < 0.7 * len(qi):
                qi, wi, counter, dense = qi[alive], wi[alive], [c[alive] for c in counter], False
    near = ~_exceeds(counter, radius)
    at = np.flatnonzero(near)
    hit, lane = np.nonzero(np.unpackbits(near[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    q, lane = qi[at[hit]], wi[at[hit]] * 64 + lane
    return q[lane < n], lane[lane < n]


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row connected with it by the links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


def similar(sets: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The labels after joining the groups of all pairs i-j of sets whose Jaccard similarity is LEAST or more, and one such pair for each join.

    sets: the members of all sets, one after the other. Pairs of one group are connected already and not compared."""
    label, pairs = label.copy(), []
    codes = np.unique(sets, return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    has = np.zeros(len(sets), bool)
    order = np.argsort(i, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else []:
        a = int(i[at[0]])
        small, large = np.minimum(sizes[a], sizes[j[at]]), np.maximum(sizes[a], sizes[j[at]])
        b = j[at][(label[j[at]] != label[a]) & (LEAST[1] * small >= LEAST[0] * large)]
        if not len(b):
            continue
        has[codes[begins[a] : begins[a] + sizes[a]]] = True
        starts = np.cumsum(sizes[b]) - sizes[b]
        members = np.arange(sizes[b].sum()) + np.repeat(begins[b] - starts, sizes[b])
        both = np.add.reduceat(has[codes[members]], starts, dtype=np.int64)
        has[codes[begins[a] : begins[a] + sizes[a]]] = False
        b = b[LEAST[1] * both >= LEAST[0] * (sizes[a] + sizes[b] - both)]
        groups, one = np.unique(label[b], return_index=True)
        if len(b):
            pairs += [(a, int(x)) for x in b[one]]
            groups = np.append(groups, label[a])
            label[np.isin(label, groups)] = groups.min()
    return label, pairs


def exact_keys(n: int) -> list[list[int]]:
    """The bits of each table's key, for 64 bits and RADIUS: all choices of parts - RADIUS parts."""
    parts = RADIUS + 1
    while n / 2 ** (64 * (parts - RADIUS) / parts) > SHARED:
        parts += 1
    bounds = [64 * i // parts for i in range(parts + 1)]
    return [[b for c in chosen for b in range(bounds[c], bounds[c + 1])] for chosen in combinations(range(parts), parts - RADIUS)]


def sampled_keys(n: int, bits: int = 64 * WIDE_WORDS) -> list[list[int]]:
    """The bits of each table's key, for wide radii."""
    size = max(6, math.ceil(math.log2(max(1, n / WIDE_SHARED))))
    tables = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFER) ** size)))
    rng = np.random.default_rng(11)
    return [rng.choice(bits, size, replace=False).tolist() for _ in range(tables)]


_BLOCK = "part int, n int, first long, last long, ids binary, planes binary, labels binary, sets binary, sizes binary"


def _placed(keys: list[list[int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every fingerprint once in each table: part, key, id, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(_words(batch.column(1)))
            for part, chosen in enumerate(keys):
                key = np.zeros((len(bits), 64), np.uint8)
                key[:, : len(chosen)] = bits[:, chosen]
                key = np.packbits(key, axis=1, bitorder="little").view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), part, np.int32)), pa.array(key), batch.column(0), batch.column(1)], ["part", "key", "id", "fp"])

    return run


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(len(column), -1)


def _blocks(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the sorted rows (part, key, id, fp, perhaps set) of a partition into blocks; keys are not cut unless they fill a block.
    Where rows have sets, only pairs of similar ones are linked."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), *[(c, pa.binary()) for c in ("ids", "planes", "labels", "sets", "sizes")]])

    def block(part: int, keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, sets: np.ndarray | None = None) -> dict:
        sliced = planes(fps)
        a, b = within_radius(fps, sliced, len(fps), radius)
        own = {"part": part, "n": len(fps), "first": int(keys[0]), "last": int(keys[-1]), "ids": ids.tobytes(), "planes": sliced.tobytes()}
        if sets is None:
            return own | {"labels": local_labels(len(fps), a, b).astype("<u2").tobytes()}
        joined, sizes = b"".join(sets), np.array([len(x) // 8 for x in sets], np.int64)
        later = a < b
        labels, _ = similar(np.frombuffer(joined, "<u8"), sizes, a[later], b[later], np.arange(len(fps)))
        return own | {"labels": labels.astype("<u2").tobytes(), "sets": joined, "sizes": sizes.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [c.to_numpy().astype(np.int64) for c in batch.columns[:3]] + [_words(batch.column(3))]
            if batch.num_columns > 4:
                new.append(np.array([*batch.column(4).to_pylist(), None], object)[:-1])
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            done, out = _cut(held[0], held[1], False, *held[4:])
            for a, b in out:
                yield pa.RecordBatch.from_pylist([block(int(held[0][a]), *[h[a:b] for h in held[1:]])], schema)
            held = [h[done:] for h in held]
        if held:
            for a, b in _cut(held[0], held[1], True, *held[4:])[1]:
                yield pa.RecordBatch.from_pylist([block(int(held[0][a]), *[h[a:b] for h in held[1:]])], schema)

    return run


def _cut(part: np.ndarray, key: np.ndarray, last: bool, sets: np.ndarray | None = None) -> tuple[int, list[tuple[int, int]]]:
    """How many rows are dealt with, and the blocks' bounds. A row with a large set counts like several, but has a block of its own at most."""
    n = len(part)
    size = np.arange(n + 1) if sets is None else np.cumsum([0, *[max(1, len(x) // 8 // SHINGLES) for x in sets]])
    edges = np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1 if n else np.zeros(0, np.int64)
    tables = set((np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()) if n else set()
    out, a = [], 0
    for b in [*edges.tolist(), *([n] if last and n else [])]:
        # b ends a key; a block may run on unless it would grow too large or the table changes
        while size[b] - size[a] > BLOCK and b - a > 1:
            most = max(a + 1, int(np.searchsorted(size, size[a] + BLOCK, "right")) - 1)
            before = edges[(edges > a) & (edges <= most)]
            cut = int(before[-1]) if len(before) else most
            out.append((a, cut))
            a = cut
        if b in tables or b == n:
            out.append((a, b))
            a = b
    return a, out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from each row of a block to the root of its local group."""
    for batch in batches:
        for ids, labels in zip(batch.column("ids").to_pylist(), batch.column("labels").to_pylist(), strict=True):
            f, to = np.frombuffer(ids, np.int64), np.frombuffer(labels, "<u2")
            own = np.flatnonzero(to != np.arange(len(f)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(f[own]), pa.array(f[to[own]])], ["u", "v"])


def _cross_links(radius: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between the local groups of two blocks, one for each pair of groups at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ia, ib = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["b_ids"], np.int64)
                pa_, pb = (np.frombuffer(r[c], np.uint64).reshape(64 * width, -1) for c in ("a_planes", "b_planes"))
                q, lane = within_radius(fingerprints_of(pa_, len(ia)), pb, len(ib), radius)
                la, lb = (np.frombuffer(r[c], "<u2").astype(np.int64) for c in ("a_labels", "b_labels"))
                if r["a_sets"] is None:
                    pairs = np.unique(np.stack([la[q], lb[lane]]), axis=1)
                else:
                    sizes = np.frombuffer(r["a_sizes"] + r["b_sizes"], np.int64)
                    found = similar(np.frombuffer(r["a_sets"] + r["b_sets"], "<u8"), sizes, q, lane + len(ia), np.append(la, lb + len(ia)))[1]
                    pairs = np.array(found, np.int64).reshape(-1, 2).T - [[0], [len(ia)]]
                if pairs.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(ia[pairs[0]]), pa.array(ib[pairs[1]])], ["u", "v"])

    return run


def links(fps: DataFrame, keys: list[list[int]], radius: int, width: int) -> DataFrame:
    """Links (u, v) between ids that connect the distinct fingerprints (id, fp) within the radius that share a key."""
    return _linked(fps.select("id", "fp").mapInArrow(_placed(keys), "part int, key long, id long, fp binary"), radius, width)


def _linked(rows: DataFrame, radius: int, width: int, rows_at_once: int = 1000) -> DataFrame:
    """Links between the rows (part, key, id, fp, perhaps set) within the radius that share part and key, where their sets, if any, are similar."""
    rows = rows.repartitionByRange("part", "key", "id").sortWithinPartitions("part", "key", "id")
    blocks = materialize(rows.mapInArrow(_blocks(radius), _BLOCK).withColumn("id", F.monotonically_increasing_id()), rows_at_once)
    # blocks that share a key: a pair for each two of them, dealt over all tasks
    ends = blocks.select("part", "id", F.explode(F.array_distinct(F.array("first", "last"))).alias("key"))
    of_key = Window.partitionBy("part", "key")
    numbered = materialize(ends.withColumn("of", F.count("*").over(of_key)).where("of > 1").withColumn("no", F.row_number().over(of_key.orderBy("id"))))
    pairs = numbered.where("no < of").select("part", "key", F.col("id").alias("a"), F.explode(F.sequence(F.col("no") + 1, F.col("of").cast("int"))).alias("no"))
    pairs = pairs.join(numbered.select("part", "key", "no", F.col("id").alias("b")), ["part", "key", "no"]).select("a", "b").distinct()
    own = ("ids", "planes", "labels", "sets", "sizes")
    side = lambda x, *cols: blocks.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in cols])
    pairs = pairs.join(side("a", *own), "a").join(side("b", *own), "b").drop("a", "b")
    found = materialize(blocks.select("ids", "labels").mapInArrow(_links, "u long, v long").unionByName(pairs.mapInArrow(_cross_links(radius, width), "u long, v long")), 4)
    discard(blocks, numbered)
    return found


def _classes(rows: DataFrame) -> DataFrame:
    """rows: id, fp. A table fp, n, component_id of the distinct fingerprints."""
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    n = fps.count()
    found = links(fps.select(F.col("node").alias("id"), "fp"), exact_keys(n), RADIUS, 1)
    labelled = materialize(fps.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node")))
    per_class = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return join_hot(labelled, materialize(per_class), "label", "members", n).select("fp", "n", "component_id")


def _similar_classes(rows: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """rows: set (a digest), fp, rid; texts: rid, text. A written table set, n, label of the distinct sets of shingles."""
    sets = materialize(rows.groupBy("set").agg(F.min("fp").alias("fp"), F.min("rid").alias("rid"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    near = components(links(sets.select(F.col("node").alias("id"), "fp"), sampled_keys(sets.count()), WIDE_RADIUS, WIDE_WORDS))
    of_text = materialize(near.join(sets, "node").select("rid", F.lit(0).alias("part"), F.col("label").alias("key"), F.col("node").alias("id"), "fp"))
    keep = [F.col(c) for c in ("part", "key", "id", "fp")]
    # first the texts that matter, where they lie; only these are shuffled
    chosen = rows_by_id(texts, of_text.select("rid"), "rid")
    candidates = materialize(_with_sets(chosen.join(of_text, "rid"), F.col("text"), keep, shingle, True), 200)
    found = _linked(candidates, WIDE_RADIUS, WIDE_WORDS, 50)
    classes = materialize(sets.join(components(found), "node", "left").select("set", "n", F.coalesce("label", "node").alias("label")))
    discard(sets, of_text, candidates, found)
    return classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """A row for each document: id_col, fp (8 bytes, big-endian), component_id."""
    rows = materialize(fingerprints(docs, [F.col(id_col).alias("id")], text_col, shingle))
    return join_hot(rows, materialize(_classes(rows)), "fp", "n", rows.count()).select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one row of each class: the one with the smallest id (nulls last), then the smallest fingerprint and row."""
    cols = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).alias("row")
    whole = materialize(docs.select(row, F.monotonically_increasing_id().alias("rid")))
    text, of = F.col(f"row.c{cols.index(text_col)}"), F.col(f"row.c{cols.index(id_col)}")
    # only texts and row ids go through Python
    rows = materialize(_with_sets(whole, text, [of.alias("id"), F.col("rid")], shingle, False), 200)
    classes = _similar_classes(rows, whole.select("rid", text.alias("text")), shingle)
    labelled = join_hot(rows, classes, "set", "n", rows.count())
    best = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("fp").alias("c"), F.col("rid").alias("d"))).alias("best"))
    dropped = materialize(rows.select("rid").join(best.select(F.col("best.d").alias("rid")), "rid", "left_anti"))
    discard(rows, classes)
    return rows_by_id(whole, dropped, "rid", without=True).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(cols)])
