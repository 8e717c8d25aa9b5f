"""Sliding views of the last N hours from hourly partial counts that are kept up by batch.

A batch is counted by hour and group, and only these counts are written, as a folder of its own. Folders of equally many batches are merged in pairs, so there are at most
as many as the number of batches has binary digits, and a count is written again as often. A view adds whole hours up; the hour that its beginning cuts is counted from
the rows themselves, by a filter on their time that reaches the scan. So a view reads counts and one hour of rows, not the window.

Defined results: equal to counting the rows, for any `as_of`; rows without a time are in no window; null groups are a group; a batch that is added again changes nothing;
batches are numbered from 0 without gaps; groups without a row in any window have no row in a view.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HOUR = 3_600_000_000
#: The windows that a listing offers (fixed values), in hours.
PRESETS = (1, 3, 6, 12, 24, 48, 72, 168)


def _hour(time: Column) -> Column:
    """The beginning of the time's hour in microseconds."""
    micros = F.unix_micros(time)
    return micros - F.pmod(micros, F.lit(_HOUR))


class HourlyCounts:
    """Counts below a path, by hour of `time` and the columns `by`."""

    def __init__(self, spark: SparkSession, path: str, by: list[str], time: str = "found_at"):
        self.spark, self.path, self.by, self.time = spark, path.rstrip("/"), by, time
        self._folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def spans(self) -> list[tuple[int, int]]:
        """First and last batch of each folder that counts; those that a merged one has taken in are left out."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder)] if self._files.exists(self._folder) else []
        found = sorted((int(a), -int(b)) for a, b in (n.split("-") for n in names if n[0].isdigit()))
        spans: list[tuple[int, int]] = []
        for first, last in found:
            if not spans or first > spans[-1][1]:
                spans.append((first, -last))
        return spans

    def _write(self, counts: DataFrame, first: int, last: int) -> None:
        draft = f"_{uuid.uuid4().hex}"
        counts.write.parquet(f"{self.path}/{draft}")
        if not self._files.rename(self._at(draft), self._at(f"{first}-{last}")):
            raise RuntimeError(f"batches {first} to {last} of {self.path} were written by another writer")

    def _read(self, spans: list[tuple[int, int]]) -> DataFrame:
        rows = self.spark.read.parquet(*[f"{self.path}/{a}-{b}" for a, b in spans])
        return rows.groupBy("hour", *self.by).agg(F.sum("n").alias("n"))

    def add(self, rows: DataFrame, batch: int) -> None:
        spans = self.spans()
        last = spans[-1][1] if spans else -1
        if batch <= last:
            return
        if batch != last + 1:
            raise ValueError(f"batch {batch} comes after {last}")
        timed = rows.where(F.col(self.time).isNotNull())
        self._write(timed.groupBy(_hour(F.col(self.time)).alias("hour"), *self.by).agg(F.count("*").alias("n")), batch, batch)
        spans.append((batch, batch))
        width = lambda s: s[1] - s[0] + 1
        due = 1
        while due < len(spans) and width(spans[-due - 1]) == spans[-1][1] - spans[-due][0] + 1:
            due += 1
        if due > 1:
            merged = spans[-due:]
            self._write(self._read(merged), merged[0][0], merged[-1][1])
            for a, b in merged:
                self._files.delete(self._at(f"{a}-{b}"), True)

    def counts(self) -> DataFrame:
        """hour (a timestamp), the groups, n."""
        return self._read(self.spans()).withColumn("hour", F.timestamp_micros("hour"))

    def sliding(self, hours: tuple[int, ...] = PRESETS) -> DataFrame:
        """For each hour in which a group has rows, what the windows that end with it hold of that group: hour, the groups, hours, n."""
        frame = Window.partitionBy(*self.by).orderBy("hour")
        sums = [F.struct(F.lit(h).alias("hours"), F.sum("n").over(frame.rangeBetween(-(h - 1) * _HOUR, 0)).alias("n")) for h in hours]
        rows = self._read(self.spans()).select("hour", *self.by, F.array(*sums).alias("w"))
        return rows.select(F.timestamp_micros("hour").alias("hour"), *self.by, F.inline("w"))

    def view(self, rows: DataFrame, as_of: Column, hours: tuple[int, ...] = PRESETS) -> DataFrame:
        """The groups, hours, n: how many of the rows each group has from `hours` before as_of on. rows: those that have been added, for the hours that are cut."""
        begin = {h: as_of - F.make_dt_interval(hours=F.lit(h)) for h in hours}
        whole = {h: F.unix_micros(b) + F.pmod(-F.unix_micros(b), F.lit(_HOUR)) for h, b in begin.items()}
        time = F.col(self.time)
        cut = {h: (time >= b) & (time < F.timestamp_micros(whole[h])) for h, b in begin.items()}
        any_cut = F.lit(False)
        for c in cut.values():
            any_cut = any_cut | c
        of_counts = self._read(self.spans()).groupBy(*self.by).agg(*[F.sum(F.when(F.col("hour") >= whole[h], F.col("n"))).alias(str(h)) for h in hours])
        of_rows = rows.where(any_cut).groupBy(*self.by).agg(*[F.count_if(cut[h]).alias(str(h)) for h in hours])
        both = of_counts.unionByName(of_rows).groupBy(*self.by).agg(*[F.coalesce(F.sum(f"`{h}`"), F.lit(0)).alias(str(h)) for h in hours])
        found = both.select(*self.by, F.inline(F.array(*[F.struct(F.lit(h).alias("hours"), F.col(f"`{h}`").alias("n")) for h in hours])))
        return found.where("n > 0")
