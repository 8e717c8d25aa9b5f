"""Every query with SQL against DuckDB on the smallest tables."""

import datetime as dt
import os

import duckdb
import pytest

from newsflow import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    value = lambda v: None if str(v) in ("<NA>", "nan", "NaT", "None") else int(v) if isinstance(v, float) and v == int(v) else v
    columns = sorted(frame.columns)
    return columns, sorted(str([value(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert plain(got) == plain(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_digests_hold_all_items(spark):
    docs = {r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert len(docs) > 60
    for name in ("c8_digest_sections", "w14_mail"):
        assert sum(r["items"] for r in catalog.QUERIES[name](spark, SF).collect()) == len(docs)
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id >= 60 AND length(trim(text)) > 0").count()
    assert 0.9 * texts < catalog.QUERIES["w15_digest_blocks"](spark, SF).where("pos >= 60").select("pos").distinct().count() <= len(docs)


def test_reports_of_late_events(spark, tmp_path):
    rows = [(i, 1) for i in range(600)] + [(600 + i, 2 + i) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = catalog.QUERIES["r12_report_cache"](spark, str(tmp_path)).toPandas()
    assert len(got) == 10 and plain(got) == plain(con.execute(catalog.ORACLE_SQL["r12_report_cache"]).fetchdf())


def test_articles_beyond_a_listing(spark, tmp_path):
    at = dt.datetime(2024, 1, 30)
    spark.createDataFrame([(i, i, "view", at) for i in range(700)], "event_id long, user_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = catalog.QUERIES["v_articles"](spark, str(tmp_path)).toPandas()
    assert len(got) == 700 and plain(got) == plain(con.execute(catalog.ORACLE_SQL["v_articles"]).fetchdf())


@pytest.mark.parametrize("name", ["t1_streamed_upserts", "t5_keyed_state"])
def test_streams_of_several_files_a_batch(spark, duck, monkeypatch, name):
    written = []
    monkeypatch.setattr(catalog.flows, "FILE_ROWS", 60)
    monkeypatch.setattr(catalog.flows, "_files", lambda h, parts, f=catalog.flows._files: written.append(f(h, parts)) or written[-1])
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert written[0] > 1 and plain(got) == plain(duck.execute(catalog.ORACLE_SQL[name]).fetchdf())
