import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.llm import ann
from newsflow.llm.queries import op8_collision_counting


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            ranked = sorted({(-float(q @ v), j) for j, v in good if j != i})[:k]
            out[i] = [j for _, j in ranked]
    return out


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.5, 2)).tolist()) for i in range(3000)]
    got = collected(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, block_rows=700, query_rows=40))
    want = brute(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9


def test_edges_of_the_input(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, one) for i in range(60)] + [(0, one), (100, [0.0, 2.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (None, one), (106, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = collected(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert got[0] == list(range(1, 21)) and got[20] == list(range(20)) and got[100] == list(range(20))
    assert ann.nearest(df.where("vec_id = 0"), F.lit(True)).count() == 0
    assert ann.nearest(df.where(F.lit(False)), F.lit(True)).count() == 0


def test_recall_and_share_verified_at_fifty_thousand():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((50_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    index = ann.BlockIndex(vectors)
    queries = vectors[::800]
    found = index.search(queries, 20)
    best = np.argsort(-(queries @ vectors.T), axis=1)[:, :20]
    recall = np.mean([len(set(b.tolist()) & set(rows.tolist())) / 20 for b, (rows, _, _) in zip(best, found, strict=True)])
    share = np.mean([verified for _, _, verified in found]) / len(vectors)
    print(f"recall {recall:.3f}, verified {share:.4f}")
    assert recall >= 0.9 and share < 0.05
    for q, (rows, scores, _) in zip(queries, found, strict=True):
        assert np.allclose(scores, vectors[rows] @ q)


def test_windows_count_what_they_hold():
    rng = np.random.default_rng(6)
    index = ann.BlockIndex(rng.standard_normal((500, 8)), lines=20)
    queries = rng.standard_normal((5, 8))
    at = np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(5)]) @ index.lines
    norms = np.linalg.norm(index.vectors, axis=1)
    lifted = np.column_stack([index.vectors / index.longest, np.sqrt(np.maximum(0, 1 - (norms / index.longest) ** 2))]) @ index.lines
    half = np.full(5, 0.7)
    for need in (1, 7, 12, 20):
        bits = index.colliding(at, half, need)
        got = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :500].astype(bool)
        for q in range(5):
            count = np.zeros(500, int)
            for line in range(20):
                # whole pages that the window touches
                order = np.argsort(lifted[:, line], kind="stable")
                pages = [order[a : a + 8] for a in range(0, 500, 8)]
                for page in pages:
                    if lifted[page[-1], line] >= at[q, line] - 0.7 and lifted[page[0], line] <= at[q, line] + 0.7:
                        count[page] += 1
            assert (got[q] == (count >= need)).all()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_the_query_on_its_own_table(spark, size):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = op8_collision_counting(spark, f"/root/testdata/{size}").toPandas()
    asked = {i: v for i, v in zip(ids.tolist(), vectors, strict=True) if i % 20 == 0}
    assert set(got["query_id"]) == set(asked)
    recall = []
    for me, found in got.groupby("query_id"):
        found = found.sort_values("rank")
        scores = vectors @ asked[me]
        best = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if i != me)[:20]
        assert found["rank"].tolist() == list(range(1, len(best) + 1)) and found["score"].is_monotonic_decreasing
        assert np.allclose(found["score"], [scores[ids == i][0] for i in found["vec_id"]], atol=1e-12)
        recall.append(len({i for _, i in best} & set(found["vec_id"])) / len(best))
    assert np.mean(recall) >= 0.95


def test_a_block_goes_to_python_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(ann, "materialize", lambda df, *a, f=ann.materialize, **b: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or f(df, *a, **b))
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(300)]
    assert ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 3 == 0, block_rows=40, query_rows=10).count() == 2000
    assert "Union" in plans[-1] and "Join" not in plans[-1]  # blocks and queries side by side, not a block with each of its queries
