"""Shared helpers: written tables for cutting lineage, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key holding more than this share of the rows is hot; so at most this many keys can be hot.
HOT_KEYS = 1024
#: Row ids (longs) that may be broadcast.
BROADCAST_IDS = 4_000_000
#: Spark's setting that removes a query's shuffle files at its end instead of when the driver next collects garbage.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder set on the context. Where neither
    is set, a local session, whose tasks all run in the driver's process, gets one of its own; a cluster gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    own = tempfile.mkdtemp(prefix="newsflow-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while a job of ours runs, and then again as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, rows_at_once: int = 1000, codec: str = "snappy", writer: dict[str, str] | None = None, **also: str) -> DataFrame:
    """Write df below the shared folder once and read it back: later jobs neither recompute it nor depend on an
    executor that may be lost. The files stay until `discard`, or `scratch`, removes them.

    rows_at_once: rows of a batch that goes to Python; few where single rows are large. writer: options of the Parquet writer. also: further settings of the job, as
    names without spark.sql."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/newsflow-{uuid.uuid4().hex}"
    with settings(spark, {CLEAN_UP: "true", BATCH_ROWS: str(rows_at_once)} | {f"spark.sql.{k}": v for k, v in also.items()}):
        df.write.options(**(writer or {})).option("compression", codec).parquet(path)
    for paths in _OPEN:
        paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._newsflow_path = path
    return table


def materialize_by(df: DataFrame, key: str, buckets: int, rows_at_once: int = 1000, codec: str = "snappy", **also: str) -> DataFrame:
    """Like `materialize`, in buckets by the hash of `key`: tables with as many buckets are joined and grouped on it without a shuffle.
    df should be dealt by the key already, as every task writes a file for each of its buckets. The table has a name in the session's catalog until it is discarded."""
    spark = df.sparkSession
    name = f"newsflow_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with settings(spark, {CLEAN_UP: "true", BATCH_ROWS: str(rows_at_once)} | {f"spark.sql.{k}": v for k, v in also.items()}):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", codec).saveAsTable(name)
    for paths in _OPEN:
        paths.append(path)
    table = spark.table(name)
    table._newsflow_path, table._newsflow_name = path, name
    return table


#: The lists of the `scratch` blocks that are open.
_OPEN: list[list[str]] = []


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        if hasattr(t, "_newsflow_name"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {t._newsflow_name}")
        _remove(t.sparkSession, [t._newsflow_path])


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The list of the tables written in the block; `drop_tables` removes them once what was made of them is written itself."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.remove(paths)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    _remove(spark, paths)
    paths.clear()


def with_columns(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select("*", *[c.alias(k) for k, c in cols.items()])


def rows_by_id(big: DataFrame, ids: DataFrame, key: str, without: bool = False) -> DataFrame:
    """The rows of big whose key is among (or, `without`, not among) the ids, a written table of one long column.

    Up to BROADCAST_IDS ids, 64 MB or so, are counted and broadcast, so that big stays where it lies; more of them meet it by a shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return big.join(F.broadcast(ids) if few else ids, key, "left_anti" if without else "left_semi")


def join_hot(big: DataFrame, small: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join big to small, where small has each key once and, as `weight`, how many rows of big have it.

    Keys with more than total / HOT_KEYS rows, at most HOT_KEYS of them as the weights sum to total, are broadcast and
    joined where big's rows lie. The others, none of which is large, are joined by an ordinary shuffle. `how` is inner or
    left; big is read twice, so it should be a written table."""
    limit = max(1, total // HOT_KEYS)
    hot = F.broadcast(small.where(F.col(weight) > limit))
    cold = small.where(F.col(weight) <= limit)
    return big.join(hot, key).unionByName(big.join(hot.select(key), key, "left_anti").join(cold, key, how))
