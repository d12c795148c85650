"""Small helpers beside the query functions, as Columns or tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def title_case(c: Column) -> Column:
    """The first character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def slug(c: Column) -> Column:
    """White space becomes a hyphen; of what is left only letters a-z, digits and hyphens stay, in lower case."""
    hyphens = F.regexp_replace(c.cast("string"), r"\s+", "-")
    return F.lower(F.regexp_replace(hyphens, "[^0-9A-Za-z-]", ""))


def every(spark: SparkSession, length: int, step: int = 1, offset: int = 0) -> DataFrame:
    """A table of one column, n: the multiples of step from 0 to length, both included, each plus offset."""
    return spark.range(0, length + 1, step or 1).select((F.col("id") + offset).alias("n"))


#: Type of the data model -> Python's, for written-out classes; fixed values. Others are Any.
PYTHON = {"int": "int", "float": "float", "number": "float", "bool": "bool", "boolean": "bool", "string": "str", "safestr": "str", "uuid": "str", "timeId": "str", "timeIdms": "str", "date": "str", "blob": "bytes"}


def class_text(name: str, model: dict) -> str:
    """The text of a dataclass for the rows of a table's model; models in models become classes of their own, before it."""
    before, lines = "", []
    for key, props in model.items():
        column, _, kind = key.partition(":")
        if column == "*":
            continue
        inner, lists = kind.rstrip("[]"), kind.count("[]")
        if props.get("model"):
            type_ = name + column.title().replace("_", "")
            before += class_text(type_, props["model"]) + "\n\n"
        else:
            type_ = "dict[str, float]" if inner == "geo" else PYTHON.get(inner, "object")
        type_ = "list[" * lists + type_ + "]" * lists
        lines.append(f"    {column}: {type_} | None = None")
    return before + f"@dataclass\nclass {name}:\n" + ("\n".join(lines) or "    pass") + "\n"
