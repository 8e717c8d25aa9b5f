"""Articles as keyed state: what is known of each URL, and when it goes, kept by Spark's state store between batches.

For each URL the state holds when it was first found, its longest body, and when it expires. A timer on event time ends it `horizon` after the first find, once
the watermark has passed, so the state holds one window's URLs however long the stream runs. What happens to a URL comes out as rows: `new`, `longer` (a longer
body replaced the one before), `expired`. A find at or after the expiry begins anew, whether the timer has fired or not, so
the result does not depend on how the finds are dealt over batches, as long as none comes later than the watermark; those that do are dropped.

Defined results: finds of a URL count in the order of their times, then of `seq`; null bodies are empty; finds without a time are dropped by the watermark; null URLs are one key.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Times are microseconds inside the state, so that no session's time zone matters.
OUTPUT = "url string, event string, at long, first_seen long, body string"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ArticleState(StatefulProcessor):
    """One URL's state: what its finds and its timer do to it."""

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("article", "first_seen long, expires long, body string")

    @staticmethod
    def _row(url: str | None, event: str, at: int, state: tuple) -> Row:
        return Row(url=url, event=event, at=at, first_seen=state[0], body=state[2])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        url = key[0]
        finds = sorted(((r["at"], r["seq"] is None, r["seq"] or 0, r["body"]) for r in rows), key=lambda r: r[:3])
        state = self.state.get()
        state = before = None if state is None else tuple(state)
        out = []
        for at, _, _, body in finds:
            body = body or ""
            if state is not None and at >= state[1]:
                out.append(self._row(url, "expired", state[1], state))
                state = None
            if state is None:
                state = (at, at + self.horizon, body)
                out.append(self._row(url, "new", at, state))
            elif len(body) > len(state[2]):
                state = (state[0], state[1], body)
                out.append(self._row(url, "longer", at, state))
        if state != before:
            self.state.update(state)
            if before is None or before[1] != state[1]:
                if before is not None:
                    self.handle.deleteTimer(_timer(before[1]))
                self.handle.registerTimer(_timer(state[1]))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.state.get()
        if state is not None:
            self.state.clear()
            yield self._row(key[0], "expired", state[1], tuple(state))

    def close(self) -> None:
        pass


def _timer(at: int) -> int:
    """Timers are in milliseconds, and must not fire early."""
    return -(-at // 1000)


def article_events(finds: DataFrame, horizon: dt.timedelta = dt.timedelta(hours=72), late: str = "1 hour") -> DataFrame:
    """The events (url, event, at, first_seen, body) of a stream of finds (url, seq, found_at, body). late: how late a find may come."""
    rows = finds.select("url", "seq", "found_at", F.unix_micros("found_at").alias("at"), "body").withWatermark("found_at", late)
    processor = ArticleState(int(horizon.total_seconds() * 1_000_000))
    events = rows.groupBy("url").transformWithState(processor, outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    return events.select("url", "event", F.timestamp_micros("at").alias("at"), F.timestamp_micros("first_seen").alias("first_seen"), "body")


def run_events(events: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there, appended to the events below the path; the checkpoint remembers the states."""
    conf = events.sparkSession.conf
    before = conf.get(PROVIDER_KEY, None)
    conf.set(PROVIDER_KEY, PROVIDER)
    try:
        query = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.unset(PROVIDER_KEY) if before is None else conf.set(PROVIDER_KEY, before)


def lives(events: DataFrame) -> DataFrame:
    """url, first_seen, body and gone of each life of a URL: one for each time that it began anew."""
    return events.groupBy("url", "first_seen").agg(F.max_by("body", F.length("body")).alias("body"), F.bool_or(F.col("event") == "expired").alias("gone"))
