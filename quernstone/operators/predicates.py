"""Conditions [left, operator, value] and their combinations, with two-valued logic.

A comparison that is null counts as false. AND and OR never turn a null into true, and neither a filter, a join nor a CASE
takes a null for true, so comparisons stay bare and reach the scan; only what is negated is made sure of first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import build, column, parse, searched
from ..functions.paths import kind_of
from ..functions.scalars import PREFILTERS

LIST_OPERATORS = {"IN", "NOT IN", "BETWEEN", "NOT BETWEEN", "INTERSECT", "INTERSECT ALL", "NOT INTERSECT"}
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def like_pattern(value: str) -> str:
    """A LIKE pattern (% _ and \\ escapes), as a pattern for rlike that takes in the whole text in any case."""
    out, at = "", 0
    while at < len(value):
        c = value[at]
        if c == "\\" and at + 1 < len(value):
            at += 1
            out += re.escape(value[at])
        else:
            out += {"%": ".*", "_": "."}.get(c) or (re.escape(c) if c.isascii() else c)
        at += 1
    return rf"(?isu)\A{out}\z"


def heads(value: str, most: int = 3) -> list[str]:
    """The ways in which a text that a LIKE pattern takes in may begin, in its first characters: a condition that reaches the scan.
    k and s have further forms in other scripts, so the heads end before them."""
    ways: list[tuple[str, ...]] = []
    for c in value[:most]:
        if c in "%_\\kKsS" or not c.isascii():
            break
        ways.append(tuple({c.lower(), c.upper()}))
    return sorted(map("".join, product(*ways))) if ways else []


def literal(value) -> Column:
    return F.array(*map(literal, value)) if isinstance(value, (list, tuple)) else F.lit(value)


def _timed(kind: T.DataType, value) -> Column:
    """A literal for a column of that time type: text is read as a time, and so as the column's type that the column is not cast."""
    if not isinstance(value, str):
        return F.lit(value)
    if isinstance(kind, T.DateType) and len(value) <= 10:
        return F.lit(value).try_cast("date")
    read = F.lit(value).try_cast("timestamp")
    return read.cast("timestamp_ntz") if isinstance(kind, T.TimestampNTZType) else read


def compare(df: DataFrame, left: Column, operator: str, value, right: Column | None = None) -> Column:
    """value: a literal, or right: a Column (in joins)."""
    op = " ".join(operator.upper().split())
    if right is None and isinstance(value, str) and value in ("NULL", "NOT NULL"):
        text = isinstance(kind_of(df, left), T.StringType)
        if (value == "NULL") == (op in ("=", "LIKE")):
            return left.isNull() | (left == "") if text else left.isNull()
        return left.isNotNull() & (left != "") if text else left.isNotNull()
    if right is None and op in LIST_OPERATORS and not isinstance(value, (list, tuple)):
        raise ValueError(f"{op} takes a list")
    make = F.lit
    if right is None and isinstance(value, (str, list, tuple)) and isinstance(kind := kind_of(df, left), TIMES):
        make = lambda v: _timed(kind, v)
    if right is not None:
        r = right
    elif op not in ("IN", "NOT IN", "BETWEEN", "NOT BETWEEN"):
        r = literal(value) if isinstance(value, (list, tuple)) else make(value)
    if op in ("LIKE", "NOT LIKE"):
        words = F.coalesce(left.cast("string"), F.lit(""))
        found = words.rlike(like_pattern(value)) if right is None and isinstance(value, str) else sure(F.call_function("ilike", words, r.cast("string")))
        if op == "NOT LIKE":
            return ~found
        first = heads(value) if right is None and isinstance(value, str) and isinstance(kind_of(df, left), T.StringType) else []
        for i, head in enumerate(first):
            begins = left.startswith(head) if not i else begins | left.startswith(head)
        return begins & found if first else found
    if op in ("=", "!="):
        if right is None and value is None:
            return left.isNull() if op == "=" else left.isNotNull()
        return left == r if op == "=" else ~left.eqNullSafe(r)
    if op in ("<", ">", "<=", ">="):
        return {"<": left < r, ">": left > r, "<=": left <= r, ">=": left >= r}[op]
    if op in ("IN", "NOT IN"):
        if right is None and not value:
            return F.lit(op == "NOT IN")
        found = left.isin(*map(make, value)) if right is None else F.array_contains(r, left)
        return found if op == "IN" else ~sure(found)
    if op in ("REGEX", "REGEXP"):
        return F.coalesce(left.cast("string"), F.lit("")).rlike(value)
    if op in ("BETWEEN", "NOT BETWEEN"):
        low, high = (r[0], r[1]) if right is not None else map(make, value)
        return left.between(low, high) if op == "BETWEEN" else (left <= low) | (left >= high)
    if op in ("INCLUDES", "NOT INCLUDES"):
        found = F.array_contains(left, r)
        return found if op == "INCLUDES" else ~sure(found)
    if op == "INCLUDES LIKE":
        if right is None and isinstance(value, str):
            return F.exists(left, lambda x: sure(x.cast("string").rlike(like_pattern(value))))
        return F.exists(left, lambda x: sure(F.call_function("ilike", x.cast("string"), r.cast("string"))))
    if op in ("INTERSECT", "NOT INTERSECT"):
        found = F.arrays_overlap(left, r)
        return found if op == "INTERSECT" else ~sure(found)
    if op == "INTERSECT ALL":
        return left.isNotNull() & (F.size(F.array_except(r, F.coalesce(left, F.array()))) == 0)
    raise ValueError(f"no operator {operator}")


def is_condition(where) -> bool:
    return isinstance(where, (list, tuple)) and len(where) == 3 and isinstance(where[0], str) and isinstance(where[1], str) and where[1].upper() not in ("AND", "OR")


def fold(where, one: Callable[[list], Column]) -> Column:
    """Conditions joined strictly from left to right: a OR b AND c is (a OR b) AND c."""
    if callable(where) or is_condition(where):
        return one(where)
    out, how = None, "AND"
    for x in where:
        if isinstance(x, str):
            how = x.upper()
            if how not in ("AND", "OR"):
                raise ValueError(f"AND or OR is wanted, not {x}")
        else:
            c = fold(x, one)
            out = c if out is None else out & c if how == "AND" else out | c
    if out is None:
        raise ValueError("an empty condition")
    return out


def condition(df: DataFrame, where, aliases: dict[str, Column] | None = None) -> Column:
    def one(c) -> Column:
        if callable(c):
            return c(df)
        node = parse(c[0])
        if node.kind == "call" and node.value == "SEARCH":
            return searched(node, df, c[1], c[2]).isNotNull()
        exact = compare(df, build(node, df, aliases), c[1], c[2])
        if node.kind == "call" and node.value in PREFILTERS:
            values = [a.value if a.kind == "value" else None for a in node.args]
            first = PREFILTERS[node.value]([build(a, df, aliases) for a in node.args], values, c[1], c[2])
            return exact if first is None else first & exact
        return exact

    return fold(where, one)


def join_condition(df: DataFrame, on) -> Column:
    """Both sides of a join's conditions are columns of df, which has those of both tables."""

    def one(c) -> Column:
        if callable(c):
            return c(df)
        return compare(df, column(c[0], df), c[1], None, column(c[2], df))

    return fold(on, one)


def columns_in(where, both: bool = False) -> list[str]:
    """The paths on the left of all conditions, or on both sides of them; a function has none that can be seen."""
    if callable(where):
        return ["?"]
    if is_condition(where):
        out: list[str] = []

        def walk(n) -> None:
            if n.kind == "path":
                out.append(n.value)
            for a in n.args:
                walk(a)

        for side in (where[0], where[2]) if both else where[:1]:
            walk(parse(side))
        return out
    return [p for x in where if not isinstance(x, str) for p in columns_in(x, both)]
