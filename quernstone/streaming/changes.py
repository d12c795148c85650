"""Change tables, observers and event-time windows on Structured Streaming.

Event-time windows, watermarks and deduplication go beyond the queries that the engine takes over; they are Spark's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import quoted

CHANGE = T.StructType([T.StructField("table", T.StringType()), T.StructField("op", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("row", T.StringType()), T.StructField("old", T.StringType())])


class ChangeLog:
    """Writes the changes of a database's tables to a folder, as (table, op, at, row and old row as JSON), from where they stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __call__(self, table: str, op: str, rows: DataFrame) -> None:
        """For Database.changes."""
        self._append(table, op, rows.select(F.to_json(F.struct("*")).alias("row"), F.lit(None).cast("string").alias("old")))

    def event(self, told: dict) -> None:
        """For Database.listen_to: the same, with the row that was there before."""
        if told.get("key") is None:
            return
        key = quoted(told["key"])
        side = lambda df, name: df.select(F.col(key).alias("k"), F.to_json(F.struct("*")).alias(name))
        self._append(told["target"], told["event"], side(told["result"], "row").join(side(told["old"], "old"), "k", "left").select("row", "old"))

    def _append(self, table: str, op: str, rows: DataFrame) -> None:
        rows.select(F.lit(table).alias("table"), F.lit(op).alias("op"), F.current_timestamp().alias("at"), "row", "old").write.mode("append").parquet(self.path)

    def stream(self, table: str | None = None, op: str | None = None) -> DataFrame:
        """All events, or those of a table, and of a kind: upsert, delete, or change for both."""
        df = self.spark.readStream.schema(CHANGE).parquet(self.path)
        if table:
            df = df.where(F.col("table") == table)
        return df if op in (None, "change", "*") else df.where(F.col("op") == op)


def listen(log: ChangeLog, tables: list[str], rerun: Callable[[], DataFrame], deliver: Callable[[DataFrame], None], checkpoint: str, unique: bool = True, trigger: dict | None = None):
    """Reruns a query whenever one of its tables (base, joined or graph) changes; with unique, a result that equals the last is not
    delivered. Gives the StreamingQuery; stop() ends it."""
    last: list = [None]

    def batch(changes: DataFrame, _: int) -> None:
        if changes.isEmpty():
            return
        rows = rerun()
        mark = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*map(quoted, rows.columns)).cast("decimal(38,0)"))).first() if unique else object()
        if mark != last[0]:
            last[0] = mark
            deliver(rows)

    events = log.stream().where(F.col("table").isin(tables))
    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by time window and event type; works on batches and streams alike."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        ts = ts.withWatermark("ts", late)
    return ts.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
