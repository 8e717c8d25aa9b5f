import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from newsflow.sources import mirror

ROWS = "url string, seq bigint, title string, at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(u, s, t, None) for u, s, t in rows], ROWS)


def held(spark, path):
    return {r["url"]: (r["seq"], r["title"]) for r in mirror.mirrored(spark, path, ROWS).collect()}


def listed(path):
    return {name for c in mirror._Target(path).commits().values() for name in c["files"]}


def files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/data/*/*")}


def test_requests_upserts_and_repeated_batches(spark, tmp_path):
    path = f"{tmp_path}/m"
    many = spark.range(1050).select(F.concat(F.lit("u"), F.col("id") % 350).alias("url"), F.col("id").alias("seq"), F.lit("é\n").alias("title"), F.current_timestamp().alias("at"))
    mirror.push(many, path, 0)
    lines = [json.loads(x)["upserts"] for f in glob.glob(f"{path}/data/*/*") for x in open(f, encoding="utf-8")]
    assert sum(map(len, lines)) == 350 and max(map(len, lines)) <= mirror.REQUEST_ROWS
    keys = [u["key"] for request in lines for u in request]
    assert len(set(keys)) == 350
    assert held(spark, path)["u3"] == (703, "é\n")
    mirror.push(frame(spark, [("u3", 5, "new"), (None, 1, "null"), (None, 1, "nulls")]), path, 1)
    mirror.push(frame(spark, [("u4", 5, "again")]), path, 1)
    got = held(spark, path)
    assert got["u3"] == (703, "é\n") and got["u4"] == (5, "again") and len(got) == 350 and files(path) == listed(path)
    mirror.push(frame(spark, []), path, 2)
    assert len(held(spark, path)) == 350


def test_failed_and_repeated_attempts_leave_each_key_once(spark, tmp_path):
    path = f"{tmp_path}/m"
    mirror.push(frame(spark, [("a", 1, "old")]), path, 0)
    rows = frame(spark, [(f"k{i}", i, "t") for i in range(40)])

    def broken(x):
        if x == "t":
            raise ValueError("broken row")
        return x

    fails = rows.withColumn("title", F.udf(broken)("title"))
    with pytest.raises(Exception, match="broken row"):
        mirror.push(fails, path, 1)
    assert held(spark, path) == {"a": (1, "old")} and files(path) == listed(path)

    # an attempt that wrote all its rows before it was lost, and its repetition
    target, run = mirror._Target(path), "abc"
    each = [{"key": "b", "seq": 1, "row": json.dumps({"url": "b", "seq": 1, "title": "t"})}]
    lost, done = target.write(iter(each), run), target.write(iter(each), run)
    target.write(iter(each), "lost")  # a run that never came to its commit
    assert lost.path != done.path
    target.commit([done, None], run, 1, 1)
    assert mirror._requests(spark, path).where("key = 'b'").count() == 1 and files(path) == listed(path)


def test_folding_keeps_the_rows_and_the_last_batch_open(spark, tmp_path):
    path = f"{tmp_path}/m"
    for n in range(5):
        mirror.push(frame(spark, [("a", n, f"t{n}"), (f"b{n}", n, "t")]), path, n)
    before = held(spark, path)
    mirror.compact(spark, path)
    assert held(spark, path) == before and sorted(mirror._Target(path).commits()) == [3, 4] and files(path) == listed(path)
    mirror.push(frame(spark, [("a", 9, "again")]), path, 4)
    got = held(spark, path)
    assert got["a"] == (9, "again") and "b4" not in got and "b3" in got
    with pytest.raises(Exception, match="folded"):
        mirror.push(frame(spark, [("a", 9, "x")]), path, 2)
    assert held(spark, path) == got and files(path) == listed(path)
    mirror.push(frame(spark, [("c", 1, "t")]), path, 5)
    mirror.compact(spark, path)
    assert len(mirror._Target(path).commits()) == 2 and mirror._requests(spark, path).where("key = 'a'").count() == 1


def test_a_stream_over_restarts(spark, tmp_path):
    path = f"{tmp_path}/m"
    for n in range(3):
        frame(spark, [("a", n, f"t{n}"), (f"b{n}", n, "t"), (f"b{n}", n, "u")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        mirror.push_stream(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/c")
    assert held(spark, path) == {"a": (2, "t2"), "b0": (0, "u"), "b1": (1, "u"), "b2": (2, "u")}
    assert sorted(mirror._Target(path).commits()) == [0, 1, 2]
