import os
import random

import pytest

import corpus_pipeline
from tests.llm.test_exact_and_secrets import DROP, brute_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_the_columns_and_what_is_clean(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(300) for _ in range(30)]
    near = [t.replace(t.split()[150], "changed", 1) for t in base[:10]]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t) for i, t in enumerate(near)] + [(200 + i, " " + t) for i, t in enumerate(base[10:15])]
    rows += [(300, "short text with token=abcdefgh12 inside"), (301, None), (302, "")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    toxic = [(1000 + i, f"{text(40)} blorgface {text(5)} blorgface snizzle {text(3)} blorgface", "en", "src", 300) for i in range(120)]
    clean = [(2000 + i, text(60), "en", "src", 300) for i in range(240)]
    every = docs.union(spark.createDataFrame(toxic + clean, docs.schema))
    spark.createDataFrame([(i, 1, int(i < 2000)) for i in [*range(1000, 1120), *range(2000, 2240)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "simhash", "secret_scan", "packing"]

    left = stages["toxicity"](spark, every, str(tmp_path))
    ids = {r["doc_id"] for r in left.collect()}
    assert left.columns == docs.columns and len([i for i in ids if 1000 <= i < 2000]) <= 2
    assert {i for i, _ in rows} <= ids and len([i for i in ids if i >= 2000]) >= 238

    left = stages["exact_dedup"](spark, docs, str(tmp_path))
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    texts = [(t or "").translate(DROP) for t in got.values()]
    assert left.columns == docs.columns and len(set(texts)) == len(texts) == len({(t or "").translate(DROP) for _, t in rows})
    assert all(200 + i in got and 10 + i not in got for i in range(5))  # the longer text stays

    left = stages["simhash"](spark, docs.where("doc_id < 200"), str(tmp_path))
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(range(30))

    left = stages["secret_scan"](spark, docs, str(tmp_path))
    got = {r["doc_id"]: r for r in left.collect()}
    assert left.columns == docs.columns and got[300]["text"] == "short text with [SECRET] inside" and got[300]["n_chars"] == 31
    assert all(got[i]["text"] == t for i, t in rows if not brute_spans(t))

    packs = stages["packing"](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packs.collect()} == {i for i, _ in rows}


def test_run_over_the_smallest_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
