import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import phrases
from newsflow.llm.queries import op11_phrase_collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, most=2000):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            own.update(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in counts.items():
        found = []
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in candidates.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    around[g[i : i + k]] = max(around[g[i : i + k]], a)
        for g, a in candidates.items():
            score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            if 100 * around[g] < 80 * a or g not in around:
                found.append((-score, -a, " ".join(g).encode(), left, right))
        found.sort()
        out |= {(lang, i): (p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:most], 1)}
    return out


def collected(df):
    return {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()}


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "a", "la", "é", "Éa", "x\x1fy", "nb sp", "𝒳", "#1"]
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", "\r\n", "\x0b"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]
    return rows + [("en", "hot phrase of five words " * 3000), ("en", None), ("de", ""), (None, "...,,"), ("one", "one " * 40)]


def test_by_brute_force_over_several_shards(spark):
    rows = texts(1, 400)
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).withColumn("shard", F.lit(1))
    want = brute(rows)
    assert len(want) > 50 and len({k for k, _ in want}) == 4
    assert collected(phrases.collocations(df.repartition(5))) == want
    assert collected(phrases.collocations(df.coalesce(1), most=7)) == {k: v for k, v in want.items() if k[1] <= 7}


def test_empty_tables_and_no_candidates(spark):
    df = spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(df.limit(0)).count() == 0


def test_the_query_by_brute_force(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert collected(op11_phrase_collocations(spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.mark.parametrize("at_once", [1, 50, 10**6])
def test_bitmaps_over_the_ends_of_blocks(monkeypatch, at_once):
    monkeypatch.setattr(phrases, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    for size in (1, 15, 16, 17, 32, 33, 400):
        tokens = rng.integers(0, 6, size)
        maps = phrases.Bitmaps(tokens, 5)
        got = Counter()
        for node, block, bits in maps.groups():
            first, (node, word, block, bits) = node, maps.extend(node, block, bits)
            a, b, n, own = phrases._children(node, word, bits, 5)
            got.update({(int(x), int(y)): int(c) for x, y, c in zip(a, b, n, strict=True)})
            node, word, block, bits = maps.extend(own, block, bits)
            parent, c, n, _ = phrases._children(node, word, bits, 5)
            got.update({(int(a[p]), int(b[p]), int(x)): int(m) for p, x, m in zip(parent, c, n, strict=True)})
            assert len(first)
        want = Counter()
        for k in (2, 3):
            want.update(t for i in range(size - k + 1) if 0 not in (t := tuple(tokens[i : i + k].tolist())))
        assert got == want


def test_words_are_read_in_pieces(monkeypatch):
    text = " ".join(f"Wört{i}, a\t{i}!" for i in range(300))
    whole = [w for part in phrases.word_lists(text) for w in part]
    monkeypatch.setattr(phrases, "PIECE", 16)
    assert [w for part in phrases.word_lists(text) for w in part] == whole
    assert whole.count(b"\xff") == 600
