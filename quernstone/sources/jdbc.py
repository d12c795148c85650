"""Tables of relational databases through JDBC, read in parallel by ranges of a numeric or time column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task asks the server for at a time, and writes to it at a time.
FETCH, BATCH = 10_000, 5_000


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 64, **options: str) -> DataFrame:
    """A table, or a SELECT in brackets with an alias. With key, `parts` tasks read a range of it each, between its least and its
    largest value, which the server is asked for; rows with a null key come with the first range. Without key one task reads all.
    Filters, projections and limits on the result are left to the server."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=str(FETCH), pushDownLimit="true", **options)
    if not key:
        return reader.load()
    whole = reader.load()
    low, high = whole.agg(F.min(key).cast("string"), F.max(key).cast("string")).first()
    if low is None or low == high:
        return whole
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=str(parts)).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", parts: int | None = None, **options: str) -> None:
    """Each task writes its rows in batches; parts bounds the connections at a time. With overwrite a table keeps its definition."""
    rows = df.coalesce(parts) if parts else df
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(BATCH), truncate="true", **options).mode(mode).save()
