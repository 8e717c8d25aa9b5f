import random

from pyspark.sql import functions as F

from newsflow.functions.matching import matched
from newsflow.operators.keywords import match_keywords

LIST = ["aço", "Aço plano", "aço plano laminado", "laminado a frio", "c++", ".net", "plano", "São Paulo", "sao  paulo", "É", "x_1", "", "a", "frio", "PLANO LAMINADO", "straße", "½", "a-b"]
WORDS = ["aço", "ACO", "plano", "laminado", "a", "frio", "c++", ".net", "são", "paulo", "é", "x_1", "the", "straße", "½", "b", "中文"]


def test_equals_the_pattern(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "-", ", ", "\n", ""]) for _ in range(rng.randint(0, 25))) for _ in range(400)] + ["", None, "  ", "-a-b", "a++b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    want = {r["id"]: r["k"] for r in rows.select("id", matched(F.col("text"), LIST).alias("k")).collect()}
    keywords = spark.createDataFrame([("l", w, i) for i, w in enumerate(LIST)] + [("other", "the", 0)], "list string, keyword string, pos int")
    got = {r["id"]: r["keywords"] for r in match_keywords(rows.withColumn("list", F.lit("l")), keywords, ["id"]).collect()}
    assert got == {i: k for i, k in want.items() if k} and len(got) > 200
    assert match_keywords(rows.withColumn("list", F.lit("none")), keywords, ["id"]).count() == 0
    assert match_keywords(rows.withColumn("list", F.lit("l")), keywords.limit(0), ["id"]).count() == 0
    assert match_keywords(rows.limit(0).withColumn("list", F.lit("l")), keywords, ["id"]).count() == 0


def test_the_plan_does_not_grow_with_the_list(spark):
    texts = spark.createDataFrame([(1, "l", "word 17 and word 99999 and word 100001"), (2, "l", "none")], "id long, list string, text string")
    plans = []
    for n in (10, 100_000):
        found = match_keywords(texts, spark.range(n).select(F.lit("l").alias("list"), F.concat(F.lit("word "), "id").alias("keyword"), F.col("id").alias("pos")), ["id"])
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(plans[0] - plans[1]) < 100
    assert [tuple(r) for r in found.collect()] == [(1, ["word 17", "word 99999"])]
