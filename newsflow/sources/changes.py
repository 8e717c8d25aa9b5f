"""What the commits of an article store added, as a stream source: each commit's rows once, however their times lie.

A high-water mark on a row's time loses rows that come later with an equal or an earlier time. The offset here is the number of a commit, which only grows and
which the store gives out after the rows are written, so no row can arrive below it. A batch is all commits after its start up to its end; its
part files are dealt to tasks of 64 MB, which read them by batches of Arrow rows. Only the driver's listing of commits is not distributed: one small file a commit.

Defined results: `changes` = "new" gives the articles that a commit was the first to hold (or that began anew after they had gone), "all" every key that it wrote, with
the values that it wrote, not yet folded with older ones. Commits without rows give none. A stream that starts without `after` begins before the first commit
that is kept, which must be the store's first; else, and where a stream has fallen behind the commits that are kept, it ends with an
error instead of leaving rows out: read `ArticleStore.read(commit)` as a batch, and start a stream `after` that commit.
The path is one that pyarrow opens (a local or mounted folder, or a URI of HDFS or an object store).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from newsflow.schemas import ARTICLE

FORMAT = "newsflow_changes"
#: Bytes of part files up to which a task reads several.
TASK_BYTES = 64 << 20
#: Columns of every row besides the article's own.
_MORE = "commit bigint, fresh boolean"


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.after, self.new = options["path"], options.get("after"), options.get("changes", "new") == "new"
        self.schema = schema

    def _files(self) -> tuple[fs.FileSystem, str]:
        files, path = fs.FileSystem.from_uri(self.path)
        return files, path.rstrip("/")

    def _commits(self) -> dict[int, str]:
        files, path = self._files()
        listed = files.get_file_info(fs.FileSelector(f"{path}/_commits", allow_not_found=True))
        return {int(f.base_name.removesuffix(".json")): f.path for f in listed if f.base_name.endswith(".json") and f.base_name[0].isdigit()}

    def initialOffset(self) -> dict:
        if self.after is not None:
            return {"commit": int(self.after)}
        first = min(self._commits(), default=0)
        if first:
            raise ValueError(f"{self.path} holds no commits before {first}: read that one as a batch and start after it")
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": max(self._commits(), default=-1 if self.after is None else int(self.after))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        commits, (files, path) = self._commits(), self._files()
        found = []
        for number in range(start["commit"] + 1, end["commit"] + 1):
            if number not in commits:
                raise ValueError(f"{self.path} holds commit {number} no more: the stream has fallen behind")
            with files.open_input_stream(commits[number]) as stream:
                added = json.loads(stream.read()).get("added", {})
            for folder in sorted({folder for folder, _ in added.values()}):
                found += [f for f in files.get_file_info(fs.FileSelector(f"{path}/{folder}", recursive=True)) if f.base_name.startswith("part-")]
        parts: list[list[str]] = []
        room = 0
        for f in found:
            if room < f.size:
                parts.append([])
                room = TASK_BYTES
            parts[-1].append(f.path)
            room -= f.size
        return [InputPartition(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = self._files()
        target = to_arrow_schema(self.schema)
        for name in partition.value:
            with files.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(4096, columns=target.names):
                    rows = pa.Table.from_batches([batch])
                    if self.new:
                        rows = rows.filter(rows["fresh"])
                    if rows.num_rows:
                        yield from rows.select(target.names).cast(target).combine_chunks().to_batches()


class ArticleChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{ARTICLE}, {_MORE}"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options), schema)


def change_stream(spark: SparkSession, path: str, changes: str = "new", after: int | None = None) -> DataFrame:
    """The changes of the store below the path, as a stream of articles with `commit` and `fresh`."""
    if changes not in ("new", "all"):
        raise ValueError(f"changes are new or all, not {changes}")
    spark.dataSource.register(ArticleChanges)
    reader = spark.readStream.format(FORMAT).option("path", path).option("changes", changes)
    return (reader if after is None else reader.option("after", after)).load()
