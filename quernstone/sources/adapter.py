"""Storage of a user's own as a Spark data source, so that it is read and written by the executors, part by part."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def register_adapter(spark: SparkSession, name: str, schema: str, parts: Callable[[dict], Iterable], read: Callable[[dict, object], Iterator[tuple]], write: Callable[[dict, Iterator], None] | None = None) -> None:
    """Makes spark.read.format(name) and df.write.format(name) known. parts(options) names the pieces that may be read apart, read(options,
    piece) gives a piece's rows, write(options, rows) stores those of one task."""

    class Part(InputPartition):
        def __init__(self, value):
            self.value = value

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self) -> list[InputPartition]:
            return [Part(x) for x in parts(self.options)]

        def read(self, part: InputPartition) -> Iterator[tuple]:
            return read(self.options, part.value)

    class Writer(DataSourceWriter):
        def __init__(self, options: dict):
            self.options = options

        def write(self, rows: Iterator) -> WriterCommitMessage:
            write(self.options, rows)
            return WriterCommitMessage()

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(dict(self.options))

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            if write is None:
                raise ValueError(f"{name} cannot be written")
            return Writer(dict(self.options))

    spark.dataSource.register(Source)


def adapted(spark: SparkSession, name: str, **options: str) -> DataFrame:
    return spark.read.format(name).options(**options).load()
