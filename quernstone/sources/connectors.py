"""Stores with a Spark connector of their own, which the cluster has to have: the formats and options that these connectors document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Kind -> format, and option names of a table and of where it is; fixed values of the public connectors.
FORMATS = {
    "mongodb": ("mongodb", {"uri": "connection.uri", "database": "database", "table": "collection"}),
    "cassandra": ("org.apache.spark.sql.cassandra", {"uri": "spark.cassandra.connection.host", "database": "keyspace", "table": "table"}),
    "redis": ("org.apache.spark.sql.redis", {"uri": "host", "database": "dbNum", "table": "table", "key": "key.column"}),
    "dynamodb": ("dynamodb", {"uri": "region", "table": "tableName"}),
}
FORMATS["scylladb"] = FORMATS["cassandra"]


def options_of(kind: str, **place: str) -> tuple[str, dict[str, str]]:
    """Format and options for a place given by uri, database, table and, for Redis, key; others are passed on as they are."""
    if kind not in FORMATS:
        raise ValueError(f"no store {kind!r} among {sorted(FORMATS)}")
    format_, names = FORMATS[kind]
    return format_, {names.get(k, k): str(v) for k, v in place.items() if v is not None}


def read_store(spark: SparkSession, kind: str, **place: str) -> DataFrame:
    """The table as a DataFrame; filters and projections on it are left to the connector. Partitioning is the connector's."""
    format_, options = options_of(kind, **place)
    return spark.read.format(format_).options(**options).load()


def write_store(df: DataFrame, kind: str, mode: str = "append", **place: str) -> None:
    format_, options = options_of(kind, **place)
    df.write.format(format_).options(**options).mode(mode).save()
