"""Aggregate functions, name -> (rows, arguments, whether the argument is *) -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import kind_of


def truthy(df: DataFrame, c: Column) -> Column:
    """Neither null, 0, NaN, false nor empty text."""
    kind = kind_of(df, c)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce((c != 0) & ~F.isnan(c.cast("double")), F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def number(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def _count(df: DataFrame, args: list[Column], star: bool) -> Column:
    return F.count(F.lit(1)) if star else F.count_if(truthy(df, args[0]))


def _extreme(f: Callable[[Column], Column]) -> Callable:
    def build(df: DataFrame, args: list[Column], star: bool) -> Column:
        zero = isinstance(kind_of(df, args[0]), T.NumericType)  # a null number counts as 0
        return f(F.coalesce(args[0], F.lit(0)) if zero else args[0])

    return build


def _sum(df: DataFrame, args: list[Column], star: bool) -> Column:
    return F.coalesce(F.sum(number(args[0])), F.lit(0.0))


def _avg(df: DataFrame, args: list[Column], star: bool) -> Column:
    return F.coalesce(F.try_divide(F.sum(number(args[0])), F.count(F.lit(1))), F.lit(0.0))


FUNCTIONS: dict[str, Callable[[DataFrame, list[Column], bool], Column]] = {"COUNT": _count, "MAX": _extreme(F.max), "MIN": _extreme(F.min), "SUM": _sum, "AVG": _avg}


def register(name: str, build: Callable[[Column], Column]) -> None:
    """A user's aggregate: a function from argument Columns to an aggregate Column."""
    FUNCTIONS[name.upper()] = lambda df, args, star: build(*args)
