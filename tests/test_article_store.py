import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import store
from newsflow.operators.article_store import ArticleStore

BATCH = "url string, seq bigint, domain string, source_name string, title string, snippet string, published_at timestamp, found_at timestamp, matched_keywords array<string>, body string"
AT = dt.datetime(2024, 1, 1)


def row(url, i, hours=0, body="b"):
    return (url, i, f"d{i}", "n", f"t{i}", f"s{i}", AT + dt.timedelta(hours=i) if i % 3 else None, AT + dt.timedelta(hours=hours), ["k"], body)


def replayed(batches, retain=None):
    """The table as a dict, written row by row; after each batch what is older than the retention goes."""
    table, latest = {}, AT
    for rows in batches:
        for url, i, domain, name, title, snippet, published, found, words, body in sorted(rows, key=lambda r: r[1]):
            old = table.get(url)
            if old:
                domain, name, found, published = old[0], old[1], old[5], published or old[4]
                body = body if len(body or "") > len(old[7] or "") else old[7]
            table[url] = (domain, name, title, snippet, published, found, words, body)
            latest = max(latest, *[r[7] for r in rows])
        if retain is not None:
            table = {u: r for u, r in table.items() if r[5] >= latest - dt.timedelta(hours=retain)}
    return table


def found(df):
    cols = ["domain", "source_name", "title", "snippet", "published_at", "found_at", "matched_keywords", "body"]
    return {r["url"]: tuple(r[c] for c in cols) for r in df.select("url", *cols).collect()}


@pytest.mark.parametrize("retain", [None, 30])
def test_equals_a_replay_of_random_histories(spark, tmp_path, retain):
    rng = random.Random(retain or 0)
    articles = ArticleStore(spark, f"{tmp_path}/s", buckets=4, retain_hours=retain)
    batches, i = [], 0
    for n in range(9):
        rows = []
        for _ in range(rng.randint(0, 25)):
            i += 1
            rows.append(row(rng.choice([None, *[f"u{k}" for k in range(30)]]), i, n * 11 + rng.randint(0, 5), "x" * rng.randint(0, 4)))
        batches.append(rows)
        df = spark.createDataFrame(rows, BATCH).withColumn("commit", F.lit("clash")) if rows else spark.createDataFrame([], BATCH)
        articles.merge(df, "s", n)
        articles.merge(df, "s", n)  # a batch that is run again changes nothing
        assert found(articles.read()) == replayed(batches, retain)
    state = articles.state()
    assert state["commit"] == 8 and len(articles.commits()) == 3
    for parts in state["parts"].values():
        sizes = [s for _, s in parts]
        assert all(sizes[k] > sum(sizes[k + 1 :]) for k in range(len(sizes) - 1))
    assert found(ArticleStore(spark, f"{tmp_path}/s").read(commit=7)) == replayed(batches[:8], retain)
    assert found(articles.lookup(spark.createDataFrame([("u1",), ("none",)], "url string"))) == {u: r for u, r in replayed(batches, retain).items() if u == "u1"}


def names(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/*/bucket=*/part-*.parquet")}


def test_a_batch_writes_its_own_buckets_alone(spark, tmp_path):
    articles = ArticleStore(spark, f"{tmp_path}/s", buckets=8, keep=1)
    many = [row(f"u{i}", i, body="x" * 500 + str(i)) for i in range(2000)]
    articles.merge(spark.createDataFrame(many, BATCH), "s", 0)
    before, parts = names(articles.path), articles.state()["parts"]
    articles.merge(spark.createDataFrame([row("u7", 5000)], BATCH), "s", 1)
    after = names(articles.path)
    assert before < after and len(after - before) == 1
    changed = {b for b, p in articles.state()["parts"].items() if p != parts[b]}
    assert len(changed) == 1 and articles.read().count() == 2000


def test_bytes_written_do_not_grow_with_the_store(spark, tmp_path):
    articles = ArticleStore(spark, f"{tmp_path}/s", buckets=2, keep=1000)
    written, seen = [], set()
    for n in range(16):
        rows = [row(f"u{n}-{i}", n * 1000 + i, body=str(random.Random(n * 1000 + i).random()) * 20) for i in range(300)]
        articles.merge(spark.createDataFrame(rows, BATCH), "s", n)
        files = names(articles.path) - seen
        seen |= files
        written.append(sum(os.path.getsize(f"{articles.path}/{f}") for f in files))
    one = written[0]
    whole = sum(size for parts in articles.state()["parts"].values() for _, size in parts)
    assert whole > 10 * one and sum(written) < 5.5 * 16 * one  # each row as often as the store has doubled, and once
    assert sorted(written)[8] < 3 * one  # most batches write little more than themselves


def test_a_second_writer_and_a_failed_commit(spark, tmp_path, monkeypatch):
    one, two = (ArticleStore(spark, f"{tmp_path}/s", buckets=2) for _ in range(2))
    one.merge(spark.createDataFrame([row("a", 1)], BATCH))
    real = two._merge_parts

    def overtaken(*x):
        real(*x)
        one.merge(spark.createDataFrame([row("b", 2)], BATCH))

    monkeypatch.setattr(two, "_merge_parts", overtaken)
    with pytest.raises(RuntimeError):
        two.merge(spark.createDataFrame([row("c", 3)], BATCH))
    assert set(found(one.read())) == {"a", "b"}
    monkeypatch.setattr(two, "_merge_parts", real)
    two.merge(spark.createDataFrame([row("c", 3)], BATCH))
    assert set(found(one.read())) == {"a", "b", "c"}


def test_the_fold_of_folds_is_the_fold(spark):
    rows = [row(f"u{i % 7}", i, i, "x" * (i * 7 % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, BATCH)
    parts = [store.fold_upserts(df.where(F.floor(F.col("seq") / 20) == n)).withColumn("seq", F.lit(n)) for n in range(3)]
    again = store.fold_upserts(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert found(again) == found(store.fold_upserts(df))
