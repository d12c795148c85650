"""Expressions such as UPPER(TRIM(name)) AS n: text to a tree, tree to a Column."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import aggregates, scalars, search
from .paths import quoted, resolve

_token = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<mark>[(),])|(?P<op><=|>=|!=|=|<|>)|(?P<name>[^\s(),'"<>=!]+))""")
_alias = re.compile(r"\s+as\s+(?=[^()'\"]*$)", re.IGNORECASE)


@dataclass
class Node:
    kind: str  # call, path, value, star, compare
    value: object
    args: list[Node] = field(default_factory=list)


def split_alias(text: str) -> tuple[str, str | None]:
    parts = _alias.split(text.strip())
    return (parts[0], parts[-1].strip()) if len(parts) > 1 else (text.strip(), None)


def parse(text: str) -> Node:
    tokens, at = [], 0
    while at < len(text) and text[at:].strip():
        m = _token.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r} in {text!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    node, rest = _operand(tokens, text)
    if rest:
        raise ValueError(f"{rest[0][1]!r} is left over in {text!r}")
    return node


def _operand(tokens: list, text: str) -> tuple[Node, list]:
    node, tokens = _single(tokens, text)
    if tokens and tokens[0][0] == "op":
        right, rest = _single(tokens[1:], text)
        return Node("compare", tokens[0][1], [node, right]), rest
    return node, tokens


def _single(tokens: list, text: str) -> tuple[Node, list]:
    if not tokens:
        raise ValueError(f"{text!r} ends too early")
    (kind, value), tokens = tokens[0], tokens[1:]
    if kind == "text":
        return Node("value", re.sub(r"\\(.)", r"\1", value[1:-1])), tokens
    if kind == "number":
        return Node("value", float(value) if re.search(r"[.eE]", value) else int(value)), tokens
    if kind == "name" and tokens and tokens[0] == ("mark", "("):
        args, tokens = [], tokens[1:]
        while tokens and tokens[0] != ("mark", ")"):
            arg, tokens = _operand(tokens, text)
            args.append(arg)
            if tokens and tokens[0] == ("mark", ","):
                tokens = tokens[1:]
        if not tokens:
            raise ValueError(f"a bracket is open in {text!r}")
        return Node("call", value.upper(), args), tokens[1:]
    if kind == "name":
        if value == "*":
            return Node("star", "*"), tokens
        word = {"true": True, "false": False, "null": None}
        return (Node("value", word[value.lower()]) if value.lower() in word else Node("path", value)), tokens
    raise ValueError(f"{value!r} was not expected in {text!r}")


def is_aggregate(node: Node) -> bool:
    return node.kind == "call" and (node.value in aggregates.FUNCTIONS or any(map(is_aggregate, node.args)))


def first_aggregate(node: Node) -> Node | None:
    if node.kind == "call" and node.value in aggregates.FUNCTIONS:
        return node
    return next((x for a in node.args if (x := first_aggregate(a))), None)


def build(node: Node, df: DataFrame, aliases: dict[str, Column] | None = None) -> Column:
    if node.kind == "value":
        return F.lit(node.value)
    if node.kind == "path":
        return aliases[node.value] if aliases and node.value in aliases else resolve(df, node.value)
    if node.kind == "star":
        return F.lit(1)
    if node.kind == "compare":
        a, b = (build(x, df, aliases) for x in node.args)
        return F.coalesce({"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[node.value], F.lit(False))
    if node.value == "SEARCH":
        return searched(node, df)
    args = [build(x, df, aliases) for x in node.args]
    if node.value in aggregates.FUNCTIONS:
        return aggregates.FUNCTIONS[node.value](df, args, node.args[0].kind == "star" if node.args else True)
    if node.value == "CAST":
        return scalars.cast(df, args[0], str(node.args[1].value))
    if node.value not in scalars.FUNCTIONS:
        raise ValueError(f"no function {node.value}")
    return scalars.FUNCTIONS[node.value](*args)


def searched(node: Node, df: DataFrame, op: str = "<=", value: float = math.inf) -> Column:
    """SEARCH(column or *, 'term', ...): the least score of those that are met (op value), null where none is. * stands for all columns of text;
    a last argument 'tokenizer:name' names the tokenizer, else it is english."""
    first, *terms = node.args
    words = [str(t.value) for t in terms]
    mode = next((w.partition(":")[2] for w in words if w.startswith("tokenizer:")), "english")
    columns = [F.col(quoted(n)) for n, k in df.dtypes if k == "string"] if first.kind == "star" else [build(first, df)]
    return search.score(columns, [w for w in words if not w.startswith("tokenizer:")], op, value, mode, single=value == math.inf)


def column(text: str, df: DataFrame) -> Column:
    return build(parse(text), df)
