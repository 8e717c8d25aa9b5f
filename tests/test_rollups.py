import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators.rollups import HourlyCounts

ROWS = "domain string, found_at timestamp"
AT = dt.datetime(2024, 1, 1)


def test_views_equal_the_rows_after_every_batch(spark, tmp_path):
    rng, rows = random.Random(1), []
    counts = HourlyCounts(spark, f"{tmp_path}/r", ["domain"])
    for n in range(7):
        batch = [(rng.choice([None, "a", "b"]), rng.choice([None, AT + dt.timedelta(hours=rng.randint(0, 60)), AT + dt.timedelta(seconds=rng.randint(0, 220000))])) for _ in range(80)]
        if n == 3:
            batch = []
        rows += batch
        df = spark.createDataFrame(batch, ROWS)
        counts.add(df, n)
        counts.add(df, n)  # a batch that is added again changes nothing
        table = spark.createDataFrame(rows, ROWS)
        for as_of in (AT + dt.timedelta(hours=50), AT + dt.timedelta(hours=50, minutes=17, microseconds=1)):
            got = {(r["domain"], r["hours"]): r["n"] for r in counts.view(table, F.lit(as_of), (1, 6, 48)).collect()}
            want = collections.Counter((d, h) for d, t in rows if t for h in (1, 6, 48) if t >= as_of - dt.timedelta(hours=h))
            assert got == dict(want)
    assert counts.spans() == [(0, 3), (4, 5), (6, 6)]
    hours = collections.Counter((d, t.replace(minute=0, second=0, microsecond=0)) for d, t in rows if t)
    assert {(r["domain"], r["hour"]): r["n"] for r in counts.counts().collect()} == dict(hours)
    got = {(r["domain"], r["hour"], r["hours"]): r["n"] for r in counts.sliding((1, 24)).collect()}
    want = {(d, t, h): sum(n for (d2, t2), n in hours.items() if d2 == d and t - dt.timedelta(hours=h) < t2 <= t) for d, t in hours for h in (1, 24)}
    assert got == want


def test_gaps_and_left_over_folders(spark, tmp_path):
    counts = HourlyCounts(spark, f"{tmp_path}/r", ["domain"])
    df = spark.createDataFrame([("a", AT)], ROWS)
    with pytest.raises(ValueError):
        counts.add(df, 1)
    counts.add(df, 0)
    real = counts._files

    class Kept:
        """A file system that was lost before it could delete anything."""

        def __getattr__(self, name):
            return (lambda *a: None) if name == "delete" else getattr(real, name)

    counts._files = Kept()
    counts.add(df, 1)
    counts._files = real
    assert counts.spans() == [(0, 1)] and counts.counts().collect()[0]["n"] == 2


def test_cut_hours_are_filtered_at_the_scan(spark, tmp_path):
    counts = HourlyCounts(spark, f"{tmp_path}/r", ["domain"])
    df = spark.createDataFrame([("a", AT)], ROWS)
    df.write.parquet(f"{tmp_path}/t")
    counts.add(df, 0)
    plan = counts.view(spark.read.parquet(f"{tmp_path}/t"), F.lit(AT + dt.timedelta(minutes=5)), (1,))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(found_at" in plan and "LessThan(found_at" in plan
