"""Scalar functions by name, all of them Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import kind_of

PLANET_RADIUS = 6371.0


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rounded(c: Column) -> Column:
    """Half toward positive infinity."""
    return F.floor(c.cast("double") + 0.5).cast("double")


def _fold(f: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *args: reduce(f, [a.cast("double") for a in args])


def replace_first(s: Column, find: Column, by: Column) -> Column:
    at = F.call_function("instr", s, find)
    return F.when(at > 0, F.call_function("overlay", s, by, at, F.length(find))).otherwise(s)


def truncated(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def low_bits(c: Column) -> Column:
    return truncated(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def distance(place: Column, lat: Column, lon: Column, radius: float = PLANET_RADIUS) -> Column:
    """Great-circle distance of a struct (lat, lon) from a point."""
    return haversine(place.getField("lat"), place.getField("lon"), lat, lon, radius)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = PLANET_RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * radius) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def box(lat: Column, lon: Column, at_lat: float, at_lon: float, most: float, radius: float = PLANET_RADIUS) -> Column:
    """Ranges of latitude and longitude that hold all places within `most` of a point; they reach the scan. Boxes over a pole take
    all longitudes, boxes over the date line two ranges."""
    d = math.degrees(most / radius)
    south, north = at_lat - d, at_lat + d
    held = lat.between(max(-90.0, south), min(90.0, north))
    if south > -90 and north < 90:
        spread = math.degrees(math.asin(min(1.0, math.sin(math.radians(min(d, 90.0))) / math.cos(math.radians(at_lat)))))
        west, east = at_lon - spread, at_lon + spread
        if west < -180:
            held &= (lon >= west + 360) | (lon <= east)
        elif east > 180:
            held &= (lon >= west) | (lon <= east - 360)
        else:
            held &= lon.between(west, east)
    return held


def within(lat: Column, lon: Column, at_lat: float, at_lon: float, most: float, radius: float = PLANET_RADIUS) -> Column:
    """Exact distance test behind a bounding box."""
    return box(lat, lon, at_lat, at_lon, most, radius) & (haversine(lat, lon, F.lit(at_lat), F.lit(at_lon), radius) <= most)


def cast(df: DataFrame, c: Column, kind: str) -> Column:
    """The casts of the data model."""
    kind = kind.strip()
    if kind.endswith("[]"):
        inner = kind[:-2]
        return F.transform(F.coalesce(c, F.array()), lambda x: _cast_scalar(x, inner, isinstance(kind_of(df, c), T.ArrayType)))
    return _cast_scalar(c, kind, isinstance(kind_of(df, c), T.BooleanType))


#: Characters that safe text escapes, & first; fixed values.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"), ("`", "&#x60;"), ("=", "&#x3D;"))


def _cast_scalar(c: Column, kind: str, boolean: bool = False) -> Column:
    if kind == "int":
        return F.coalesce(F.floor(c.try_cast("double") + 0.5), F.lit(0)).cast("long")
    if kind in ("float", "number"):
        return F.coalesce(c.try_cast("double"), F.lit(0.0))
    if kind in ("bool", "boolean"):
        return F.coalesce(c.cast("string").isin("true", "1", "1.0"), F.lit(False))
    if kind == "safestr":
        return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, c.cast("string"))
    if kind == "date":
        return c.try_cast("timestamp")
    if kind in ("string", "uuid", "timeId", "timeIdms"):
        return c.cast("string")
    return c


def _if(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), yes).otherwise(no)


def _strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "GREATEST": F.greatest,
    "LEAST": F.least,
    "LOWER": lambda c: F.lower(c.cast("string")),
    "UPPER": lambda c: F.upper(c.cast("string")),
    "TRIM": lambda c: F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""),
    "FORMAT_NUMBER": lambda c, d=None: F.call_function("format_number", c.cast("double"), F.lit(2) if d is None else d.cast("int")),
    "CONCAT": lambda *a: F.concat(*map(text, a)),
    "CONCAT_WS": lambda sep, *a: F.call_function("concat_ws", sep, *map(text, a)),
    "REPLACE": replace_first,
    "STRCMP": _strcmp,
    "LEVENSHTEIN": F.levenshtein,
    "IF": _if,
    "CROW": distance,
    "ADD": _fold(lambda a, b: a + b),
    "SUB": _fold(lambda a, b: a - b),
    "MULT": _fold(lambda a, b: a * b),
    "DIV": _fold(F.try_divide),
    "MOD": lambda a, b: F.try_mod(a.cast("double"), b.cast("double")),
    "TRUNCATE": lambda c, d: F.call_function("round", c.cast("double"), d.cast("int")),
    "LENGTH": F.length,
    "ABS": F.abs, "ACOS": F.acos, "ASIN": F.asin, "ATAN": F.atan, "ATAN2": F.atan2, "ACOSH": F.acosh, "ASINH": F.asinh, "ATANH": F.atanh,
    "CBRT": F.cbrt, "COS": F.cos, "SIN": F.sin, "TAN": F.tan, "COSH": F.cosh, "SINH": F.sinh, "TANH": F.tanh, "EXP": F.exp, "EXPM1": F.expm1,
    "LOG": F.ln, "LOG10": F.log10, "LOG1P": F.log1p, "LOG2": F.log2, "POW": F.pow, "SIGN": F.signum, "SQRT": F.sqrt, "RANDOM": F.rand,
    "CEIL": lambda c: F.ceil(c).cast("double"),
    "FLOOR": lambda c: F.floor(c).cast("double"),
    "ROUND": rounded,
    "TRUNC": truncated,
    "FROUND": lambda c: c.cast("float").cast("double"),
    "HYPOT": lambda *a: F.sqrt(reduce(lambda x, y: x + y, [x.cast("double") * x for x in a])),
    "CLZ32": lambda c: F.when(low_bits(c) == 0, 32).otherwise(32 - F.length(F.bin(low_bits(c)))),
    "IMUL": lambda a, b: F.shiftright(F.shiftleft((truncated(a).cast("int").cast("long") * truncated(b).cast("int").cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)), 32), 32),
}
CONSTANTS = {"PI": math.pi, "E": math.e, "LN2": math.log(2), "LN10": math.log(10), "LOG2E": 1 / math.log(2), "LOG10E": 1 / math.log(10), "SQRT1_2": math.sqrt(0.5), "SQRT2": math.sqrt(2)}
FUNCTIONS |= {k: (lambda v: lambda: F.lit(v))(v) for k, v in CONSTANTS.items()}


def register(name: str, build: Callable[..., Column]) -> None:
    """A user's function: from argument Columns to a Column."""
    FUNCTIONS[name.upper()] = build


def _crow_box(args: list[Column], values: list, op: str, value) -> Column | None:
    """Before CROW(place, latitude, longitude) < distance, with numbers for all three."""
    if op not in ("<", "<=") or len(args) != 3 or not all(isinstance(v, (int, float)) for v in (*values[1:], value)) or not 0 <= value < math.pi * PLANET_RADIUS / 2 or abs(values[1]) >= 90:
        return None
    return box(args[0].getField("lat"), args[0].getField("lon"), float(values[1]), float(values[2]), float(value) * (1 + 1e-9))


#: Conditions on a function that can be narrowed before it is computed: name -> (its arguments as Columns, their literal
#: values or None, operator, value) -> a Column that holds wherever the condition does, or None.
PREFILTERS: dict[str, Callable[[list[Column], list, str, object], Column | None]] = {"CROW": _crow_box}
