import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow.operators.article_store import ArticleStore
from newsflow.sources.changes import change_stream

from .test_article_store import BATCH, names, row


def run(stream, path) -> StreamingQuery:
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def seen(spark, path):
    rows = spark.read.parquet(f"{path}/out").select("url", "commit", "title", "found_at", "published_at", "matched_keywords", "body", "fresh").collect()
    return sorted([tuple(r) for r in rows], key=str)


def test_equal_and_earlier_times_come_once_over_restarts(spark, tmp_path):
    store = ArticleStore(spark, f"{tmp_path}/s", buckets=3, keep=10)
    batches = [[row("b", 1, 5), row(None, 2, 5)], [row("a", 3, 5), row("b", 4, 6)], [], [row("c", 5, -3), row("a", 6, 9, "longer")], [row("d", 7, 5)]]
    for n, rows in enumerate(batches):
        store.merge(spark.createDataFrame(rows, BATCH) if rows else spark.createDataFrame([], BATCH), "s", n)
        if n in (1, 3):
            for _ in range(2):  # the second run finds nothing new
                run(change_stream(spark, store.path), f"{tmp_path}/new")
    run(change_stream(spark, store.path), f"{tmp_path}/new")
    run(change_stream(spark, store.path, "all"), f"{tmp_path}/all")
    new, every = seen(spark, f"{tmp_path}/new"), seen(spark, f"{tmp_path}/all")
    assert sorted((r[0], r[1]) for r in new if r[0]) == [("a", 1), ("b", 0), ("c", 3), ("d", 4)] and sum(r[0] is None for r in new) == 1
    assert sorted((r[0], r[1], r[7]) for r in every if r[0]) == [("a", 1, True), ("a", 3, False), ("b", 0, True), ("b", 1, False), ("c", 3, True), ("d", 4, True)]
    c = next(r for r in new if r[0] == "c")
    assert c[2:7] == ("t5", dt.datetime(2023, 12, 31, 21), dt.datetime(2024, 1, 1, 5), ["k"], "b")
    run(change_stream(spark, store.path, after=2), f"{tmp_path}/after")
    assert {r[0] for r in seen(spark, f"{tmp_path}/after")} == {"c", "d"}


def test_a_stream_that_fell_behind_ends_with_an_error(spark, tmp_path):
    store = ArticleStore(spark, f"{tmp_path}/s", buckets=2, keep=2)
    store.merge(spark.createDataFrame([row("a", 1)], BATCH), "s", 0)
    run(change_stream(spark, store.path), f"{tmp_path}/new")
    for n in range(1, 5):
        store.merge(spark.createDataFrame([row(f"u{n}", n)], BATCH), "s", n)
    with pytest.raises(Exception, match="fallen behind"):
        run(change_stream(spark, store.path), f"{tmp_path}/new")
    with pytest.raises(Exception, match="as a batch"):
        run(change_stream(spark, store.path), f"{tmp_path}/other")
    run(change_stream(spark, store.path, after=3), f"{tmp_path}/after")
    assert {r[0] for r in seen(spark, f"{tmp_path}/after")} == {"u4"}


def test_parts_that_were_merged_at_once_do_not_stay(spark, tmp_path):
    store = ArticleStore(spark, f"{tmp_path}/s", buckets=1, keep=1)
    for n in range(6):
        store.merge(spark.createDataFrame([row(f"u{n}", n)], BATCH), "s", n)
    state = store.state()
    listed = {folder for parts in [*state["parts"].values(), list(state["added"].values())] for folder, _ in parts}
    assert {n.split("/")[0] for n in names(store.path)} == listed
    assert store.read().agg(F.count("*")).first()[0] == 6


def test_an_empty_store_gives_an_empty_stream(spark, tmp_path):
    run(change_stream(spark, f"{tmp_path}/none"), f"{tmp_path}/new")
    with pytest.raises(ValueError):
        change_stream(spark, f"{tmp_path}/none", "some")
