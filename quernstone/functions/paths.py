"""Paths such as a.b[0].c and list.length, resolved against a schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_step = re.compile(r"\[(?:(\d+)|([^\]]+))\]|\.?([^.\[\]]+)")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column(df: DataFrame, path: str) -> tuple[str, str]:
    """The column that a path begins with, and the rest of it. Joined rows have columns named table.column; a bare name
    means the only, else the first, column of that name."""
    names = sorted(df.columns, key=len, reverse=True)
    for c in names:
        if path == c or path.startswith((f"{c}.", f"{c}[")):
            return c, path[len(c) :]
    for c in df.columns:
        end = c.rpartition(".")[2]
        if "." in c and (path == end or path.startswith((f"{end}.", f"{end}["))):
            return c, path[len(end) :]
    raise ValueError(f"no column for {path!r} among {df.columns}")


def reads(df: DataFrame, path: str, column: str) -> bool:
    """Whether a path of df begins with that column."""
    return _column(df, path)[0] == column


def has(df: DataFrame, path: str) -> bool:
    try:
        resolve(df, path)
    except ValueError:
        return False
    return True


def resolve(df: DataFrame, path: str) -> Column:
    name, rest = _column(df, path)
    col, kind = F.col(quoted(name)), df.schema[name].dataType
    for number, key, field in _step.findall(rest):
        part = key.strip("'\"") or field
        if part == "length" and isinstance(kind, (T.ArrayType, T.StringType)):
            col, kind = (F.size(col) if isinstance(kind, T.ArrayType) else F.length(col)), T.IntegerType()
        elif number and isinstance(kind, T.ArrayType):
            col, kind = F.get(col, F.lit(int(number))), kind.elementType
        elif isinstance(kind, T.StructType) and part in kind.names:
            col, kind = col.getField(part), kind[part].dataType
        elif isinstance(kind, T.MapType):
            col, kind = F.try_element_at(col, F.lit(part or number)), kind.valueType
        elif isinstance(kind, T.StringType):  # text that holds JSON
            col = F.get_json_object(col, f"$[{number}]" if number else f"$.{part}")
        else:
            raise ValueError(f"{path!r}: no {part or number!r} in {kind.simpleString()}")
    return col


def kind_of(df: DataFrame, col: Column) -> T.DataType:
    return df.select(col.alias("_")).schema["_"].dataType
