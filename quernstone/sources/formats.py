"""Import and export as JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import quoted


def csv_lines(df: DataFrame, header: bool = True) -> DataFrame:
    """One line of CSV text a row (column line): text quoted with doubled quotes, nested values as quoted JSON, null empty; with
    header, a first column `at` puts the header line (0) before the rows (1)."""

    def cell(f: T.StructField):
        c = F.col(quoted(f.name))
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        elif not isinstance(f.dataType, T.StringType):
            return F.coalesce(c.cast("string"), F.lit(""))
        return F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))

    lines = df.select(F.lit(1).alias("at"), F.concat_ws(",", *map(cell, df.schema)).alias("line"))
    if not header:
        return lines
    names = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    return df.sparkSession.createDataFrame([(0, names)], "at int, line string").unionAll(lines)


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """CSV with a header, quotes as in RFC 4180. Columns that hold only true and false become booleans; columns whose texts all begin with
    { or [ and are JSON become the structures that they hold; others stay text. One pass more over the text finds that out."""
    df = spark.read.option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    tests = lambda i, c: (F.bool_and(c.isin("true", "false")).alias(f"b{i}"), F.bool_and(c.rlike(r"^\s*[\[{]")).alias(f"j{i}"))
    flags = df.agg(F.count(F.lit(1)), *(x for i, c in enumerate(df.columns) for x in tests(i, F.col(quoted(c))))).first()

    def typed(i: int, name: str):
        c = F.col(quoted(name))
        if flags[f"b{i}"]:
            return c == "true"
        if flags[f"j{i}"]:
            cells = F.concat(F.lit('{"v":'), c, F.lit("}"))
            kind = spark.read.json(df.where(c.isNotNull()).select(cells.alias("v")).rdd.map(lambda r: r[0])).schema
            if kind.names == ["v"]:
                return F.from_json(cells, kind)["v"]
        return c

    return df.select(*(typed(i, c).alias(c) for i, c in enumerate(df.columns)))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def dump(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_dump(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
