import random
import re

import pytest
from pyspark.sql import functions as F

from newsflow.functions.matching import contains_all
from newsflow.operators.search_index import SearchIndex

ROWS = "url string, title string, body string"


def test_equals_the_scan_after_every_batch(spark, tmp_path):
    rng = random.Random(2)
    words = ["Aço", "plano", "laminação", "É", "um", "x", "São Paulo", "%_*", "中文", "the", "of steel"]
    index, table = SearchIndex(spark, f"{tmp_path}/i", ["title", "body"], buckets=16), {}
    searches = [["aco"], ["ACO", "plano"], ["lamina"], ["a"], ["e", "um"], ["sao paulo"], ["o p"], ["%_*"], ["中"], ["nowhere"], [], [""], ["steel", "x", "th"]]
    for n in range(3):
        batch = {f"u{rng.randint(0, 80)}": (rng.choice([None, " ".join(rng.choices(words, k=3))]), " ".join(rng.choices(words, k=rng.randint(0, 5)))) for _ in range(60)}
        table |= batch
        for _ in range(2):  # the second time it replaces itself
            index.add(spark.createDataFrame([(u, *t) for u, t in batch.items()] or [], ROWS), n)
        current = spark.createDataFrame([(u, *t) for u, t in table.items()], ROWS).cache()
        for terms in searches if n == 2 else searches[:3]:
            want = {r["url"] for r in current.where(contains_all(terms, F.col("title"), F.col("body"))).collect()}
            assert {r["url"] for r in index.search(current, terms).collect()} == want, terms
    # rows that have gone are not found
    assert index.search(current.limit(0), ["aco"]).count() == 0


def test_a_search_reads_its_own_folders(spark, tmp_path):
    index = SearchIndex(spark, f"{tmp_path}/i", ["title", "body"], buckets=32)
    index.add(spark.range(500).select(F.concat(F.lit("u"), "id").alias("url"), F.md5(F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("body")), 0)
    keys = index.candidates(["abcd"])
    plan = keys._jdf.queryExecution().toString()
    asked = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 1 <= len(re.findall(r"[ (,](\d+)(?=[,)]|$)", asked)) <= 2  # of 32 folders, as there are two grams
    want = sum("abcd" in r["title"] for r in spark.range(500).select(F.md5(F.col("id").cast("string")).alias("title")).collect())
    assert keys.count() >= want


@pytest.mark.parametrize("terms", [["ab", "cd"], ["a"]])
def test_short_terms(spark, tmp_path, terms):
    index = SearchIndex(spark, f"{tmp_path}/i", ["title"], buckets=4)
    df = spark.createDataFrame([("1", "xab", None), ("2", "cd ab", None), ("3", "", None), (None, "ab cd", None), ("4", "Á", None)], ROWS)
    index.add(df, 0)
    want = {r["url"] for r in df.where("url is not null").where(contains_all(terms, F.col("title"))).collect()}
    assert {r["url"] for r in index.search(df, terms).collect()} == want
