"""Collectors as Spark data sources: a class with a schema and a function from options to rows becomes spark.read.format(name)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def register_collector(spark: SparkSession, name: str, schema: str, partitions: Callable[[dict], list], rows: Callable[[dict, object], Iterator[tuple]]) -> None:
    """partitions(options) lists what can be read at once; rows(options, part) yields the tuples of one part, on an executor."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(p) for p in partitions(self.options)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from rows(self.options, partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader(dict(self.options))

    spark.dataSource.register(Source)


def unregistered(extractors: DataFrame, names: DataFrame, key: str = "domain") -> DataFrame:
    """Domains that only one of the two tables of a source registration has."""
    only = lambda a, b, where: a.select(key).join(b.select(key), key, "left_anti").selectExpr(key, f"'{where}' AS missing_in")
    return only(extractors, names, "names").unionByName(only(names, extractors, "extractors"))
