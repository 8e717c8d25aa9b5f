"""The scan as a stream: file batches, stateful deduplication, upserts, eviction."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow.functions import urls as U
from newsflow.operators.article_store import ArticleStore


def item_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Items as they arrive: a micro-batch takes files_per_batch new files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_arrivals(items: DataFrame, at: str = "found_at", horizon: str = "72 hours", key: Column | None = None) -> DataFrame:
    """Each URL once within the horizon; its state goes after it."""
    keyed = items.withColumn("norm_url", U.canonical(F.col("url")) if key is None else key)
    return keyed.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["norm_url"])


def restamp(items: DataFrame, as_of: Column, hours: int, paywalled: list[str]) -> DataFrame:
    """Late items of paywalled domains count as new; other late items drop out; early ones are clamped to as_of + 5 minutes' rule."""
    from newsflow.plans.scan import clamp_future, within_window

    in_time = within_window(F.col("published_at"), as_of, hours)
    kept = items.where(in_time | F.col("source_domain").isin(paywalled))
    return kept.withColumn("published_at", clamp_future(F.when(in_time, F.col("published_at")).otherwise(as_of), as_of, 5))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The article table that the last complete batch left."""
    return ArticleStore(spark, path).read()


def upsert_sink(path: str, as_of: str | None = None, retain_hours: int = 72, keep: int = 3, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that folds batches into an article store. A batch that is run again after a failure gives the same result; a
    stream with a new checkpoint goes on from the store that is there. Articles go retain_hours before as_of, or before the latest find where
    none is given."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        articles = ArticleStore(spark, path, buckets, retain_hours, keep)
        articles.merge(batch, stream or "batch", number if stream else None, as_of)

    return write


class RunGuard:
    """Lets one run begin at a time, and none within `cooldown` seconds after the end of the last; others are turned away, not queued."""

    def __init__(self, cooldown: float = 20.0, clock: Callable[[], float] = time.monotonic):
        self.cooldown, self.clock = cooldown, clock
        self._running, self._ended = threading.Lock(), -float("inf")

    def run(self, work: Callable[[], object]) -> bool:
        """Whether the work was done."""
        if not self._running.acquire(blocking=False):
            return False
        try:
            if self.clock() - self._ended < self.cooldown:
                return False
            try:
                work()
            finally:
                self._ended = self.clock()
            return True
        finally:
            self._running.release()


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there, then stop; the checkpoint remembers what has been read, exactly once and without loss of equal times."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def poll(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """A batch every 30 seconds; batches never overlap."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
