import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from newsflow.llm import lexical
from newsflow.llm.queries import op12_ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    rows = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    n, total = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = {}
    for item, text in set(items):
        found = []
        for i, c in rows:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out[item] = [(i, -s) for s, _, _, i in found[:k]]
    return {i: v for i, v in out.items() if v}


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def docs_and_items():
    rng = random.Random(4)
    words = ["alpha", "Beta", "é", "ÉÉ", "x1", "0", "中文", "nb sp", "gamma", "rare"]
    docs = [(i, "".join(rng.choice(words[: rng.randint(1, 10)]) + rng.choice([" ", "-", "_", ". ", "\n"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    docs += [(i, "same text for all of them") for i in range(1000, 1100)] + [(7, "same text for all of them"), (None, "same text"), (None, None), (5000, ""), (5001, "-- _ !"), (5002, "long " * 300_000 + "rare")]
    items = [(0, "alpha beta Beta"), (1, "same TEXT"), (2, ""), (3, None), (4, "unknownword"), (5, "x1 中文 0 rare é"), (0, "alpha beta Beta"), (6, " ".join(words))]
    return docs, items


def test_by_brute_force_over_several_shards(spark):
    docs, items = docs_and_items()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    want = brute(docs, items)
    assert len(want) == 4 and len(want[1]) == 50
    assert collected(lexical.rank_documents(d.repartition(6), q)) == want
    index, n = lexical.build_index(d.coalesce(1))
    assert n == 300 + 103 - sum(not terms(t) for _, t in docs[:300])
    assert collected(lexical.search(index, n, q, block_terms=3)) == want
    assert collected(lexical.search(index, n, q, k=3)) == {i: v[:3] for i, v in want.items()}


def test_empty_tables(spark):
    docs, items = docs_and_items()
    d, q = spark.createDataFrame(docs[:20], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert lexical.rank_documents(d.limit(0), q).count() == 0
    assert lexical.rank_documents(d, q.limit(0)).count() == 0


def test_the_query_by_brute_force(spark):
    read = lambda t, i: [(r[i], r["text"]) for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect()]
    want = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert collected(op12_ranked_search(spark, "/root/testdata/sf0.01")) == want


def test_selection_keeps_the_first_of_ties():
    rng = np.random.default_rng(1)
    for n, k in ((0, 3), (2, 3), (40, 5), (400, 50)):
        scores = rng.integers(0, 4, n)
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s)[:k]
        assert sorted(lexical.top_rows(scores, k).tolist()) == sorted(i for _, i in want)


def test_terms_are_read_in_pieces(monkeypatch):
    text = " ".join(f"Wört{i}-É{i}" for i in range(500))
    monkeypatch.setattr(lexical, "PIECE", 16)
    assert [w.decode() for part in lexical.term_lists(text) for w in part] == terms(text)


def test_shards_are_read_and_held_one_by_one(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(lexical, "materialize", lambda df, *a, f=lexical.materialize, **b: jobs.append((df.columns, b)) or f(df, *a, **b))
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(20)], "doc_id long, text string")
    assert lexical.rank_documents(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 20
    reading = [b for columns, b in jobs if columns != ["item", "query", "term"] and "counts" not in columns]
    assert len(reading) == 3 and all(b["parquet.columnarReaderBatchSize"] == "1" for b in reading)
    writing = [b for columns, b in jobs if "docs" in columns]
    assert len(writing) == 2 and all(b["writer"]["parquet.block.size.row.check.min"] == "1" for b in writing)
