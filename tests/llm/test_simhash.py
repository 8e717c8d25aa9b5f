import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from newsflow.llm import graph, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint():
    for text in ("", None, " \n", "One", "a b c d", "A b c d e É " * 50, "x y z w v u t", "w" * 5000 + " b"):
        assert simhash.fingerprint(text)[0] == brute_fingerprint(text)


def test_within_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(0b1011), base[:50] ^ np.uint64(0x8000000000000F00)]).reshape(-1, 1)
    a, b = simhash.within_radius(fps, simhash.planes(fps), len(fps))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i][0]) ^ int(fps[j][0])).bit_count() <= 4}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_within_a_wide_radius():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, (300, 2), dtype=np.uint64)
    for i in range(0, 290, 3):  # 20 to 32 bits of its neighbour changed
        fps[i + 1] = fps[i]
        for b in rng.choice(128, int(rng.integers(20, 33)), replace=False):
            fps[i + 1, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    for n in (1, 64, 128, 299, 300):
        for width in (1, 2):
            assert (simhash.fingerprints_of(simhash.planes(fps[:n, :width]), n) == fps[:n, :width]).all()
    a, b = simhash.within_radius(fps, simhash.planes(fps), len(fps), 26)
    far = lambda x, y: sum((int(p) ^ int(q)).bit_count() for p, q in zip(x, y))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if far(fps[i], fps[j]) <= 26}
    assert set(zip(a.tolist(), b.tolist())) == want and len(want) > 350


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_classes_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)  # several blocks share a key
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**63))
    rows = [(i, centre ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 5))))) for i in range(200)]
    rows += [(i, int(rng.integers(0, 2**63))) for i in range(200, 300)] + [(i, rows[i - 300][1]) for i in range(300, 340)]
    own = spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in rows], "id long, fp binary")
    classes = simhash._classes(own)
    got = {r["id"]: r["component_id"] for r in own.join(classes, "fp").collect()}
    assert got == brute_components(rows)


def test_edges_of_the_input(spark):
    rows = [(1, "same words here again and again", "x"), (2, "same words here again and again", "y"), (3, None, None), (4, "", "z"), (None, "other text entirely with several words", "q"), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, None)}
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_near_copies_go(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    rows, copies = [], 0
    for i in range(60):
        text = words(400)
        rows.append((10 * i, " ".join(text)))
        for j in range(2):
            new = list(text)
            for at in rng.choice(400, 6, replace=False):
                new[at] = "changed"
            rows.append((10 * i + 1 + j, " ".join(new)))
            copies += 1
    rows += [(1000 + i, " ".join(words(n))) for i, n in enumerate([1, 2, 3, 5, 6, 6, 7, 8, 9, 12] * 6)]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {i for i, _ in rows if i >= 1000 or i % 10 == 0}
    assert len(kept) - (len(rows) - copies) <= 0.05 * copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def test_only_similar_texts_go(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i, changed in enumerate([2, 4, 6, 8, 10, 12, 15, 20, 25, 30] * 6):  # of 400 words: similarities from 0.95 to 0.45
        text = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        new = list(text)
        for at in rng.choice(400, changed, replace=False):
            new[at] = f"new{at}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(new))]
    near = [(i, jaccard(rows[i][1], rows[i + 1][1])) for i in range(0, len(rows), 2)]
    assert sum(0.5 <= s < 0.8 for _, s in near) >= 20 and sum(0.8 <= s for _, s in near) >= 20
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {i for i, _ in near} | {i + 1 for i, s in near if s < 0.8}
    assert sum(i + 1 in kept for i, s in near if s >= 0.8) <= 1


def test_similar_texts_of_a_large_group(spark):
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 5000, 8200)]
    texts = []
    for _ in range(150):  # long texts, so that the group fills several blocks
        new = list(base)
        for at in rng.choice(8200, rng.integers(85, 110), replace=False):
            new[at] = f"new{rng.integers(10**9)}"
        texts.append(" ".join(new))
    blocks = simhash._cut(np.zeros(150, int), np.zeros(150, int), True, np.array([bytes(8 * len(shingles(t))) for t in texts], object))[1]
    assert len(blocks) == 3
    sets, fps = [shingles(t) for t in texts], [simhash.fingerprint(t, 5, simhash.WIDE_WORDS) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b) and np.bitwise_count(fps[i] ^ fps[j]).sum() <= simhash.WIDE_RADIUS:
                least, other = sorted((label[i], label[j]))
                label = [least if x == other else x for x in label]
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == set(label) and 1 < len(kept) < 140


def test_repeats_count_once(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(100 + i, f"{t} {'de ' * 500}") for i, t in enumerate(texts)]
    assert all(jaccard(t, rows[20 + i][1]) >= 0.8 for i, t in enumerate(texts))
    far = lambda a, b: np.bitwise_count(simhash.fingerprint(a, 5, 4) ^ simhash.fingerprint(b, 5, 4)).sum()
    assert all(far(rows[20][1], x) > simhash.WIDE_RADIUS for _, x in rows[21:])  # the same repeated word, and all else different
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(20))
