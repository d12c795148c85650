"""The query builder, and its compilation to one DataFrame.

Order: left filter, joins, graphs, filter on joined columns, grouping, select list, having, distinct, order, offset, limit.
Nothing is run or collected here, so Catalyst plans the whole.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import expressions as E
from ..functions.aggregates import number
from ..functions.paths import has, kind_of, quoted, reads
from ..operators.predicates import columns_in, condition, fold, is_condition, join_condition
from .numbering import kept

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


@dataclass
class Query:
    """A description of a query: plain data, changed by none of its methods, run by none of them but the sinks."""

    database: Any
    source: Any
    name: str | None = None
    select_: list[str] | None = None
    where_: Any = None
    joins: list[dict] = field(default_factory=list)
    graphs: list[dict] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    having_: Any = None
    order: list[str] = field(default_factory=list)
    distinct_: list[str] = field(default_factory=list)
    union_: tuple[list[Query], bool] | None = None
    limit_: int | None = None
    offset_: int = 0
    notes: dict = field(default_factory=dict)
    action: tuple[str, dict] | None = None  # upsert or delete, run by exec() or write()

    def _with(self, **changes) -> Query:
        q = copy.copy(self)
        for k, v in changes.items():
            setattr(q, k, v)
        return q

    def select(self, columns: list[str] | None = None) -> Query:
        return self._with(select_=columns)

    def where(self, where) -> Query:
        return self._with(where_=where)

    def join(self, joins: dict | list[dict]) -> Query:
        return self._with(joins=[*self.joins, *(joins if isinstance(joins, list) else [joins])])

    def graph(self, graphs: dict | list[dict]) -> Query:
        return self._with(graphs=[*self.graphs, *(graphs if isinstance(graphs, list) else [graphs])])

    def group_by(self, columns: list[str] | dict) -> Query:
        return self._with(group=_sort_list(columns))

    def having(self, where) -> Query:
        return self._with(having_=where)

    def order_by(self, columns: list[str] | dict) -> Query:
        return self._with(order=_sort_list(columns))

    def distinct(self, columns: list[str]) -> Query:
        return self._with(distinct_=columns)

    def union(self, queries: list[Query], keep_all: bool = False) -> Query:
        return self._with(union_=(queries, keep_all))

    def limit(self, n: int) -> Query:
        return self._with(limit_=n)

    def offset(self, n: int) -> Query:
        return self._with(offset_=n)

    def from_(self, source, alias: str | None = None) -> Query:
        return self._with(source=source, name=alias)

    def into(self, table: str) -> Query:
        return self._with(source=table)

    on = into

    # changes of the table, run by exec() or write()
    def upsert(self, rows) -> Query:
        """Rows, or with a condition one patch (a dict) of all rows that it holds for."""
        return self._with(action=("upsert", {"rows": rows}))

    def delete(self) -> Query:
        return self._with(action=("delete", {}))

    def update_immutable(self, patch: dict) -> Query:
        return self._with(action=("upsert", {"rows": patch, "immutable": True}))

    def ttl(self, seconds: float = 60, columns: list[str] | None = None) -> Query:
        """The rows that are upserted, or only those columns of them, live so many seconds."""
        return self._with(notes=self.notes | {"ttl": (seconds, columns)})

    def comment(self, text: str) -> Query:
        return self._with(notes=self.notes | {"comment": text})

    def tag(self, text: str) -> Query:
        return self._with(notes=self.notes | {"tags": [*self.notes.get("tags", []), text]})

    def extend(self, key: str, value) -> Query:
        return self._with(notes=self.notes | {key: value})

    def emit(self) -> dict:
        """The description as plain data, not run."""
        return {k.rstrip("_"): v for k, v in self.__dict__.items() if k != "database" and v not in (None, [], {}, 0)}

    # sinks
    def df(self) -> DataFrame:
        return compile_query(self)

    def write(self) -> DataFrame:
        """Runs the change, and gives the rows written or deleted."""
        db, (what, more) = self.database, self.action
        if what == "delete":
            return db.delete(self.source, self.where_)
        rows = more["rows"]
        if isinstance(rows, dict) and (self.where_ is not None or more.get("immutable")):
            if "ttl" in self.notes:
                raise ValueError("a time to live is given with the rows, not with a condition")
            return db.update(self.source, rows, self.where_, more.get("immutable", False))
        seconds, columns = self.notes.get("ttl", (None, None))
        return db.upsert(self.source, [rows] if isinstance(rows, dict) else rows, seconds, columns)

    def exec(self, events: bool = False) -> list[dict]:
        """The rows; with events each in an envelope of target, event, query and result."""
        start = time.time()
        rows = [r.asDict(recursive=True) for r in (self.write() if self.action else self.df()).collect()]
        table = self.source if isinstance(self.source, str) else self.name
        if not self.action:
            self.database.fire("select", table, result=rows)
        took, slow = time.time() - start, self.notes.get("slow")
        if slow is not None and took > slow:
            self.database.fire("slow query", table, query=self.emit(), took=took)
        what = self.action[0] if self.action else "select"
        return [{"target": table, "event": what, "query": self.emit(), "result": r} for r in rows] if events else rows

    def stream(self) -> Iterator[dict]:
        return (r.asDict(recursive=True) for r in self.df().toLocalIterator())

    def to_csv(self, header: bool = True) -> DataFrame:
        from ..sources.formats import csv_lines

        return csv_lines(self.df(), header)

    def cache(self, key: str, page: int | None = None) -> DataFrame | Iterator[DataFrame]:
        """The result made once under that key, for Database.page; whole, or as pages of so many rows."""
        held = self.database.page(key, self, 0, 2**62)
        if page is None:
            return held
        return (self.database.page(key, None, i, page) for i in range(0, held.count(), page))

    def tables(self) -> list[str]:
        """Names of all tables that the query reads: its own, joined ones and those of graphs and unions."""
        named = [self.source, *(j["with"]["table"] for j in self.joins)]

        def graphs(found) -> None:
            for g in found if isinstance(found, list) else [found]:
                named.append(g["with"]["table"])
                graphs(g.get("graph", []))

        graphs(self.graphs)
        inner = [t for q in (self.union_[0] if self.union_ else []) for t in q.tables()]
        return list(dict.fromkeys([*(t for t in named if isinstance(t, str) and t in self.database.tables), *inner]))

    def listen(self, log, deliver: Callable[[DataFrame], None], checkpoint: str, unique: bool = True, trigger: dict | None = None):
        """The query run anew whenever a table that it reads has changed, as told by a ChangeLog; see streaming.changes.listen."""
        from ..streaming.changes import listen

        return listen(log, self.tables(), self.df, deliver, checkpoint, unique, trigger)

    def copy_to(self, table: str, mutate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The result, made once, also goes into another table."""
        rows = kept(self.df())
        self.database.upsert(table, mutate(rows) if mutate else rows)
        return rows


def _sort_list(columns: list[str] | dict) -> list[str]:
    return [f"{k} {v}" for k, v in columns.items()] if isinstance(columns, dict) else list(columns)


def sort_key(text: str) -> tuple[str, bool]:
    """A sort text's expression, and whether it ascends."""
    head, _, last = text.strip().rpartition(" ")
    return (head.strip(), last.lower() == "asc") if head and last.lower() in ("asc", "desc") else (text.strip(), True)


def ordered(df: DataFrame, order: list[str]) -> list[Column]:
    """Nulls last when ascending, first when descending."""
    out = []
    for text in order:
        e, up = sort_key(text)
        c = F.col(quoted(e)) if e in df.columns else E.column(e, df)
        out.append(c.asc_nulls_last() if up else c.desc_nulls_first())
    return out


def qualified(df: DataFrame, name: str) -> DataFrame:
    return df.toDF(*(c if c.startswith(f"{name}.") else f"{name}.{c}" for c in df.columns))


def compile_query(q: Query) -> DataFrame:
    if q.union_:
        return _united(q)
    df = q.database.rows(q.source, q.where_)
    if q.joins:
        df = _joined(q, df)
    elif q.where_ is not None:
        df = df.where(condition(df, q.where_))
    for g in q.graphs:
        df = _with_graph(q, df, g)
    return _finished(q, df)


def _united(q: Query) -> DataFrame:
    first, *rest = (x.df() for x in q.union_[0])
    for x in rest:
        first = first.unionAll(x.toDF(*first.columns))
    df = first if q.union_[1] else first.distinct()
    if q.where_ is not None:
        df = df.where(condition(df, q.where_))
    return _finished(q, df)


def _joined(q: Query, df: DataFrame) -> DataFrame:
    left = q.name or (q.source if isinstance(q.source, str) else None)
    if not left:
        raise ValueError("a joined source without a table name needs an alias")
    late = None
    if q.where_ is not None:
        early = []
        parts = [q.where_] if callable(q.where_) or is_condition(q.where_) else list(q.where_)
        if all(not isinstance(p, str) or p.upper() == "AND" for p in parts):  # AND alone: each part goes as low as it can
            for p in (p for p in parts if not isinstance(p, str)):
                names = [n.removeprefix(f"{left}.") for n in columns_in(p)]
                (early if all(has(df, n) for n in names) else (late := late or [])).append(p)
        else:
            names = [n.removeprefix(f"{left}.") for n in columns_in(q.where_)]
            early, late = ([q.where_], None) if all(has(df, n) for n in names) else ([], [q.where_])
        for p in early:
            df = df.where(fold(p, lambda c, df=df: c(df) if callable(c) else condition(df, [c[0].replace(f"{left}.", ""), c[1], c[2]])))
    df = qualified(df, left)
    for j in q.joins:
        side = j["with"]
        name = side.get("as") or side["table"]
        right = qualified(q.database.rows(side["table"], None), name)
        kind = KINDS[j.get("type", "inner")]
        if kind == "cross" or "on" not in j:
            df = df.crossJoin(right)
            continue
        both = df.limit(0).crossJoin(right.limit(0))
        df = df.join(right, join_condition(both, j["on"]), kind)
    for p in late or []:
        df = df.where(condition(df, p))
    return df


def _with_graph(q: Query, df: DataFrame, g: dict) -> DataFrame:
    """Adds column g["key"]: the matching child rows of each row, as an array of structs, or with single the last of them.

    Children are matched, grouped, sorted, cut and gathered per parent, by one join and one aggregation."""
    side = g["with"]
    name = side.get("as") or side["table"]
    child = q.database.rows(side["table"], None)
    for inner in g.get("graph", []) if isinstance(g.get("graph", []), list) else [g["graph"]]:
        child = _with_graph(q._with(source=side["table"], name=name), child, inner)
    parent = q.name or (q.source if isinstance(q.source, str) else "_parent")
    left = df if q.joins else qualified(df, parent)
    right = qualified(child, name)
    empty = left.limit(0).crossJoin(right.limit(0))
    seen = columns_in(g["on"], both=True)
    # children are gathered once for each combination of the parents' columns that the condition reads
    needed = [n for n, (_, k) in zip(left.columns, df.dtypes, strict=True) if not k.startswith(("map", "variant")) and ("?" in seen or any(reads(empty, p, n) for p in seen))]
    own = dict(zip(left.columns, df.columns, strict=True))
    df = df.withColumn("_row", F.struct(*(F.col(quoted(own[n])).alias(f"k{i}") for i, n in enumerate(needed))) if needed else F.lit(0))
    rows = df.select("_row").distinct().select("_row", *(F.col(f"_row.k{i}").alias(n) for i, n in enumerate(needed)))
    both = rows.limit(0).crossJoin(right.limit(0))
    met = rows.join(right, join_condition(both, g["on"]), "inner")
    kids = met.select("_row", *(F.col(quoted(f"{name}.{c}")).alias(c) for c in child.columns))
    sub = Query(q.database, kids, select_=g.get("select"), group=_sort_list(g.get("groupBy", [])), order=_sort_list(g.get("orderBy", [])))
    order = sub.order or [child.columns[0]]
    if sub.group or any(E.is_aggregate(E.parse(E.split_alias(s)[0])) for s in sub.select_ or []):
        made = sub._with(group=["_row", *sub.group], select_=["_row", *(sub.select_ or child.columns)], order=[]).df()
        order = [o for o in order if sort_key(o)[0] in made.columns] or [made.columns[-1]]
    else:
        made = kids
    place = F.row_number().over(W.partitionBy("_row").orderBy(*ordered(made, order), *(F.col(quoted(c)) for c, k in made.dtypes if c != "_row" and not k.startswith(("map", "array", "struct")))))
    made = made.withColumn("_place", place)
    low, most = g.get("offset", 0), g.get("limit")
    if low or most is not None:
        made = made.where((F.col("_place") > low) & (F.col("_place") <= low + most if most is not None else F.lit(True)))
    if sub.select_ and made.columns[:1] == ["_row"] and not sub.group and not any(E.is_aggregate(E.parse(E.split_alias(s)[0])) for s in sub.select_):
        made = made.select("_row", "_place", *(E.column(e, made).alias(a or e) for e, a in map(E.split_alias, sub.select_)))
    fields = [c for c in made.columns if c not in ("_row", "_place")]
    gathered = F.sort_array(F.collect_list(F.struct("_place", F.struct(*(F.col(quoted(c)) for c in fields)).alias("r"))))
    lists = made.groupBy("_row").agg(F.transform(gathered, lambda x: x["r"]).alias(g["key"]))
    out = df.join(lists, "_row", "left")
    value = F.try_element_at(g["key"], F.lit(-1)) if g.get("single") else F.coalesce(g["key"], F.array().cast(lists.schema[g["key"]].dataType))
    return out.withColumn(g["key"], value).select(*(c for c in map(quoted, df.columns) if c != "`_row`"), quoted(g["key"]))


def _finished(q: Query, df: DataFrame) -> DataFrame:
    items = [(*E.split_alias(s), s) for s in q.select_ or []]
    nodes = [(E.parse(e), a or e) for e, a, _ in items if e != "*"]
    grouped = bool(q.group) or any(E.is_aggregate(n) for n, _ in nodes)
    if grouped:
        df, keys = _grouped(q, df, nodes)
        if not q.order and any(g.strip().lower().endswith((" asc", " desc")) for g in q.group):  # groups come in the order that was asked for
            q = q._with(order=[f"{keys[sort_key(g)[0]]} {'asc' if sort_key(g)[1] else 'desc'}" for g in q.group])
        nodes = [(E.Node("path", name), name) for _, name in nodes]
    if q.having_ is not None:
        aliases = {name: (F.col(quoted(name)) if grouped else E.build(n, df)) for n, name in nodes}
        df = df.where(condition(df, _renamed(q.having_, set(df.columns) | set(aliases)), aliases))
    star = not q.select_ or any(e == "*" for e, _, _ in items)
    if q.distinct_:
        if not q.select_:
            df = df.select(*(E.column(c, df).alias(c) for c in q.distinct_)).distinct()
            star = True
        else:
            key = [E.column(c, df) for c in q.distinct_]
            w = W.partitionBy(*key).orderBy(*(ordered(df, q.order) or [F.col(quoted(df.columns[0]))]))
            df = df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
            nodes += [(E.parse(c), c) for c in q.distinct_ if c not in {n for _, n in nodes}]
    made = {name: F.col(quoted(name)) if grouped else E.build(n, df) for n, name in nodes}
    out = df if star and not made else df.select(*([F.col(quoted(c)) for c in df.columns if c not in made] if star else []), *(c.alias(n) for n, c in made.items()))
    if q.order:
        keys = []
        hidden = {}
        for i, text in enumerate(q.order):
            e, up = sort_key(text)
            if e in out.columns:
                c = F.col(quoted(e))
            else:  # a sort by what is not selected
                hidden[f"_sort{i}"] = E.build(E.parse(e), df)
                c = F.col(f"_sort{i}")
            keys.append(c.asc_nulls_last() if up else c.desc_nulls_first())
        if hidden:
            base = [F.col(quoted(c)) for c in df.columns if c not in made] if star else []
            wide = df.select(*base, *(c.alias(n) for n, c in made.items()), *(c.alias(n) for n, c in hidden.items()))
            out = wide.orderBy(*keys)
            return _cut(q, out).drop(*hidden)
        out = out.orderBy(*keys)
    return _cut(q, out)


def _cut(q: Query, df: DataFrame) -> DataFrame:
    if q.offset_:
        df = df.offset(q.offset_)
    return df.limit(q.limit_) if q.limit_ is not None else df


def _renamed(where, names: set[str]):
    """Having names columns by alias or by their literal text, such as COUNT(*)."""
    if callable(where):
        return where
    if is_condition(where):
        if where[0] in names:
            return lambda df: _on(df, where)
        return where
    return [x if isinstance(x, str) else _renamed(x, names) for x in where]


def _on(df: DataFrame, where) -> Column:
    from ..operators.predicates import compare

    return compare(df, F.col(quoted(where[0])), where[1], where[2])


def _grouped(q: Query, df: DataFrame, nodes: list[tuple[E.Node, str]]) -> tuple[DataFrame, dict[str, str]]:
    """One row a group, and the names of the keys' columns; with select-list columns by name. A bare column takes its value from one row of the group: the extreme one if
    the first aggregate is MAX or MIN, else the first in sort order."""
    keys = {sort_key(g)[0]: E.column(sort_key(g)[0], df) for g in q.group}
    names = {k: next((n for node, n in nodes if node.kind == "path" and node.value == k), k) for k in keys}
    first = next((x for n, _ in nodes if (x := E.first_aggregate(n))), None)
    order = [E.column(sort_key(o)[0], df) for o in q.order if has(df, sort_key(o)[0])] + [F.col(quoted(c)) for c, k in df.dtypes if not k.startswith(("map", "variant"))][:1]
    if first is not None and first.value in ("MAX", "MIN"):
        value = E.build(first.args[0], df)
        value = number(value) if isinstance(kind_of(df, value), T.NumericType) else value
        pick = (lambda c: F.max_by(c, value)) if first.value == "MAX" else (lambda c: F.min_by(c, value))
    else:
        pick = lambda c: F.min_by(c, F.struct(*order))
    if not nodes:  # the first row of each group, whole
        nodes = [(E.Node("path", c), c) for c in df.columns]
    texts = {E.split_alias(t)[0]: t for t in q.select_ or []}
    out = {}
    for node, name in nodes:
        plain = node.value if node.kind == "path" else next((e for e in texts if E.parse(e) == node), None) if node.kind != "star" else None
        if plain in keys:
            continue
        out[name] = E.build(node, df) if E.is_aggregate(node) else pick(E.build(node, df))
    made = df.groupBy(*(c.alias(f"_key{i}") for i, c in enumerate(keys.values()))).agg(*(c.alias(n) for n, c in out.items()) if out else [F.count(F.lit(1)).alias("_n")])
    back = {k: f"_key{i}" for i, k in enumerate(keys)}
    aliases = {k: next((E.split_alias(t)[1] or k for e, t in texts.items() if e == k), names[k]) for k in keys}
    chosen = [F.col(back[k]).alias(aliases[k]) for k in keys] + [F.col(quoted(n)) for n in out]
    return made.select(*chosen), aliases
