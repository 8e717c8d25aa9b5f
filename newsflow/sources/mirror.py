"""A mirror that takes upserts in requests of at most 100 rows, written by a committed writer, in batch or as a stream.

Each task writes its requests to a file of its own, one request a line; the rows of a request have different keys. What a batch consists of is decided at its commit alone, by a small
file that lists the files of the tasks that Spark counts: files of failed or repeated attempts are not in it, and go, at the latest with the next commit. A batch
that is written again replaces itself. `compact` folds all committed batches but the last into one, so the mirror grows with its keys, not with its history.

Defined results: of a key's rows in one batch the one of the largest `seq` counts, of batches the last; null keys are one key; equal `seq` are decided by
the row's JSON, the largest; a batch without rows commits an empty list; a batch
that has been folded with others gives an error if it is written again (the last one never is). A mirror has one writer at a time. The path is one that pyarrow opens.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

FORMAT = "newsflow_mirror"
#: Rows of one request at most.
REQUEST_ROWS = 100
_ROW = "key string, seq bigint, row string"
_DIGITS = 12


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    requests: int
    rows: int


class _Target:
    """The files below a path, and what its commits say."""

    def __init__(self, uri: str):
        self.uri = uri

    def open(self) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.uri)
        return files, path.rstrip("/")

    def commits(self) -> dict[int, dict]:
        """The batches that count: those that a later one has taken in are left out."""
        files, path = self.open()
        listed = files.get_file_info(fs.FileSelector(f"{path}/_commits", allow_not_found=True))
        numbers = sorted((int(f.base_name.removesuffix(".json")) for f in listed if f.base_name.endswith(".json") and f.base_name[0].isdigit()), reverse=True)
        found, first = {}, None
        for n in numbers:
            if first is None or n < first:
                with files.open_input_stream(f"{path}/_commits/{n:0{_DIGITS}}.json") as stream:
                    found[n] = json.loads(stream.read())
                first = found[n]["first"]
        return found

    def write(self, rows: Iterator[Row], run: str) -> _Written:
        files, path = self.open()
        requests, total, name = 0, 0, None
        first = next(rows, None)
        if first is None:
            return _Written(None, 0, 0)
        name = f"data/{run}/{uuid.uuid4().hex}.jsonl"
        files.create_dir(f"{path}/data/{run}", recursive=True)
        rows = itertools.chain([first], rows)
        with files.open_output_stream(f"{path}/{name}") as out:
            while chunk := list(itertools.islice(rows, REQUEST_ROWS)):
                upserts = [{"key": r["key"], "seq": r["seq"], "row": r["row"]} for r in chunk]
                out.write(json.dumps({"upserts": upserts}, ensure_ascii=False).encode() + b"\n")
                requests, total = requests + 1, total + len(chunk)
        return _Written(name, requests, total)

    def commit(self, messages: list, run: str, batch: int, first: int) -> None:
        files, path = self.open()
        done, known = [m for m in messages if m is not None], self.commits()
        if any(c["first"] <= batch <= n and c["first"] < first for n, c in known.items()):
            raise ValueError(f"batch {batch} has been folded with others and cannot be replaced")
        before = {n: c for n, c in known.items() if first <= n <= batch}
        state = {"batch": batch, "first": first, "files": [m.path for m in done if m.path], "requests": sum(m.requests for m in done), "rows": sum(m.rows for m in done)}
        files.create_dir(f"{path}/_commits", recursive=True)
        draft = f"{path}/_commits/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(state).encode())
        files.move(draft, f"{path}/_commits/{batch:0{_DIGITS}}.json")
        self._remove_others(run, set(state["files"]))
        for n, old in before.items():
            if n != batch:
                files.delete_file(f"{path}/_commits/{n:0{_DIGITS}}.json")
            for name in old["files"]:
                if name not in state["files"] and files.get_file_info(f"{path}/{name}").type == fs.FileType.File:
                    files.delete_file(f"{path}/{name}")
        listed = {name.split("/")[1] for c in self.commits().values() for name in c["files"]}
        for f in files.get_file_info(fs.FileSelector(f"{path}/data", allow_not_found=True)):
            if f.base_name not in listed:  # of runs that were lost before their commit, or replaced
                files.delete_dir(f.path)

    def _remove_others(self, run: str, kept: set[str]) -> None:
        files, path = self.open()
        for f in files.get_file_info(fs.FileSelector(f"{path}/data/{run}", allow_not_found=True)):
            if f"data/{run}/{f.base_name}" not in kept:
                files.delete_file(f.path)

    def abort(self, run: str) -> None:
        self._remove_others(run, set())


class _BatchWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.run = _Target(options["path"]), uuid.uuid4().hex
        self.batch = int(options["batch"])
        self.first = int(options.get("first", self.batch))

    def write(self, iterator: Iterator[Row]) -> _Written:
        return self.target.write(iterator, self.run)

    def commit(self, messages: list) -> None:
        self.target.commit(messages, self.run, self.batch, self.first)

    def abort(self, messages: list) -> None:
        self.target.abort(self.run)


class MirrorSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _ROW

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(dict(self.options))


def _upserts(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """key, seq and JSON of the last row of each key."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"})
    each = rows.select(F.col(key).alias("key"), F.col(seq).cast("bigint").alias("seq"), whole.alias("row"))
    return each.groupBy("key").agg(F.max(F.struct("seq", "row")).alias("last")).select("key", "last.seq", "last.row")


def push(rows: DataFrame, path: str, batch: int, key: str = "url", seq: str = "seq") -> None:
    """Write a batch of upserts to the mirror below the path, all of it or nothing."""
    rows.sparkSession.dataSource.register(MirrorSink)
    _upserts(rows, key, seq).write.format(FORMAT).mode("append").option("path", path).option("batch", batch).save()


def push_stream(rows: DataFrame, path: str, checkpoint: str, key: str = "url", seq: str = "seq") -> StreamingQuery:
    """All that a stream holds, then stop. Batches have the stream's numbers, so one that is run again after a failure replaces itself; each has its keys once."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        push(batch, path, number, key, seq)

    spark.dataSource.register(MirrorSink)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _requests(spark: SparkSession, path: str) -> DataFrame:
    target = _Target(path)
    listed = [(n, name) for n, commit in target.commits().items() for name in commit["files"]]
    if not listed:
        return spark.createDataFrame([], "batch bigint, key string, seq bigint, row string")
    read = spark.read.schema("upserts array<struct<key:string,seq:bigint,row:string>>")
    runs = spark.createDataFrame(sorted({(name.split("/")[1], n) for n, name in listed}), "run string, batch bigint")
    lines = read.json([f"{path.rstrip('/')}/{name}" for _, name in listed])
    rows = lines.select(F.regexp_extract(F.input_file_name(), r"/data/([0-9a-f]+)/[^/]+$", 1).alias("run"), F.explode("upserts").alias("u"))
    return rows.join(F.broadcast(runs), "run").select("batch", "u.*")


def mirrored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that the mirror holds: of each key the last one of the last batch that has it."""
    last = _requests(spark, path).groupBy("key").agg(F.max_by("row", F.struct("batch", "seq")).alias("row"))
    return last.select(F.from_json("row", schema).alias("r")).select("r.*")


def compact(spark: SparkSession, path: str) -> None:
    """Fold all committed batches but the last, which a stream may have to write again; what they consisted of goes when the fold is committed."""
    numbers = _Target(path).commits()
    folded = {n: c for n, c in numbers.items() if n < max(numbers)}
    if len(folded) < 2:
        return
    spark.dataSource.register(MirrorSink)
    rows = _requests(spark, path).where(F.col("batch") < max(numbers))
    last = rows.groupBy("key").agg(F.max_by(F.struct("seq", "row"), F.struct("batch", "seq")).alias("last")).select("key", "last.seq", "last.row")
    first = min(c["first"] for c in folded.values())
    last.write.format(FORMAT).mode("append").option("path", path).option("batch", max(folded)).option("first", first).save()
