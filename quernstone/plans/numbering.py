"""Consecutive numbers for the rows of a distributed table, without bringing the rows into one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A row's id is its partition's number, shifted by this many bits, and its place there.
BITS = 33


def kept(df: DataFrame) -> DataFrame:
    """df made once: written to the folder that spark.checkpoint.dir names, so that it survives lost executors; persisted
    where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        return df.persist()
    path = fresh_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession) -> str:
    """A new name in the shared folder; in a temporary one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quernstone-")
    return f"{shared.rstrip('/')}/quernstone-{uuid.uuid4().hex}"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with column name: 1, 2, 3 ... in the order of partitions and of rows in them, so in that of a sort before.

    Ids are made once, with the rows. Only one count a partition is brought together, and broadcast as running sums."""
    held = kept(df.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", BITS)
    counts = held.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_rows")
    starts = counts.select("_part", before.alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << BITS) - 1))
    return held.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + place + 1).drop("_id", "_part", "_before")
