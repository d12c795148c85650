"""A database: named tables with models, and reads and writes on them as pure DataFrame transformations."""

from __future__ import annotations

import copy
import math
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import has, quoted, resolve
from ..functions.scalars import cast
from ..functions.search import SearchIndex
from ..operators.predicates import condition, sure
from ..plans.numbering import kept, numbered
from ..plans.query import Query

KINDS = {"int": T.LongType(), "number": T.DoubleType(), "float": T.DoubleType(), "bool": T.BooleanType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "blob": T.BinaryType(), "geo": T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])}


def type_of(kind: str, model: dict | None = None) -> T.DataType:
    """Model type -> Spark type; unknown and open types are text."""
    if kind.endswith("[]"):
        return T.ArrayType(type_of(kind[:-2], model))
    if kind == "array":
        return T.ArrayType(T.StringType())
    if kind in ("object", "obj", "map"):
        return schema_of(model) if model else T.MapType(T.StringType(), T.StringType())
    return KINDS.get(kind, T.StringType())


def schema_of(model: dict) -> T.StructType:
    """{"id:int": {"pk": True}, ...} -> StructType."""
    return T.StructType([T.StructField(*_named(k, v)) for k, v in model.items() if k != "*"])


def _named(key: str, props: dict) -> tuple[str, T.DataType]:
    name, _, kind = key.partition(":")
    return name, type_of(kind or "any", props.get("model"))


@dataclass
class Table:
    name: str
    df: DataFrame
    model: dict = field(default_factory=dict)
    pk: str = "_id"
    indexes: dict = field(default_factory=dict)
    ttl: DataFrame | None = None  # key, until (a time), cols (null: the whole row)
    changes: int = 0  # since the table was last written out
    search: SearchIndex | None = None


class Cancelled(Exception):  # noqa: N818
    """Raised by a hook to stop what it was called for."""


#: A table is written out after so many changes, so that no plan holds more of them.
CHANGES = 4
NAME = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
#: Names that a table cannot have, as they stand for other things in queries; fixed values.
RESERVED = frozenset({"select", "from", "where", "values", "table"})
#: Types that a key cannot have; fixed values.
NO_KEYS = frozenset({"geo", "obj", "object", "array", "map"})


class Database:
    def __init__(self, spark: SparkSession, name: str = "main"):
        self.spark, self.name = spark, name
        self.dir: str | None = None  # where its files are, if they are in one folder
        self.tables: dict[str, Table] = {}
        self.filters: dict[str, list[tuple[int, Callable]]] = {}
        self.actions: dict[str, Callable] = {}
        self.views: dict[str, Callable[..., Query]] = {}
        self.presets: dict[str, Callable[..., Query]] = {}
        self.changes: list[Callable[[str, str, DataFrame], None]] = []
        self.path_changes: list[tuple[str, str, Callable[[DataFrame], None]]] = []
        self.listeners: list[tuple[str, str | None, Callable[[dict], None]]] = []
        self.caches: dict[str, DataFrame] = {}
        self.version = 0
        self._held: list[Callable[[], None]] | None = None  # events of a transaction that is open

    def connect(self) -> Database:
        """Tells the hooks and listeners of the start; hooks may change the name."""
        self.name = self._through("config", {"name": self.name})["name"]
        for hook in ("willConnect", "postConnect", "ready"):
            self._through(hook, self)
        for event in ("connect", "ready"):
            self.fire(event)
        return self

    def disconnect(self) -> None:
        """Hooks and listeners are told, and the temporary views of the tables go."""
        self._through("disconnect", self)
        self.fire("disconnect")
        for name in self.tables:
            self.spark.catalog.dropTempView(name)

    # definition
    def attach(self, name: str, df: DataFrame, pk: str | None = None) -> None:
        """An existing DataFrame as a table; the first column is its key unless one is named."""
        self.tables[name] = Table(name, df, pk=pk or df.columns[0])
        df.createOrReplaceTempView(name)

    def create_table(self, name: str, model: dict, if_not_exists: bool = False, indexes: dict | None = None) -> None:
        if name in self.tables:
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        if not NAME.fullmatch(name) or name.lower() in RESERVED:
            raise ValueError(f"{name!r} is no table name")
        model, indexes = self._through("configTable", (model, indexes or {}), name)
        for key, props in model.items():
            col, _, kind = key.partition(":")
            if not col or (props.get("pk") and kind.lower().removesuffix("[]") in NO_KEYS):
                raise ValueError(f"{key!r} cannot be {'a key' if col else 'a column'}")
        if sum(bool(v.get("pk")) for v in model.values()) > 1:
            raise ValueError(f"{name} has more than one key")
        for key, props in indexes.items():
            fk = props.get("foreignKey")
            if fk and fk["target"].partition(".")[0] not in {*self.tables, name}:
                raise ValueError(f"{key} of {name} refers to a table that is not there")
        pk = next((k.partition(":")[0] for k, v in model.items() if v.get("pk")), None)
        if pk is None:
            model, pk = {"_id:uuid": {"pk": True}, **model}, "_id"
        self.tables[name] = Table(name, self.spark.createDataFrame([], schema_of(model)), model, pk, indexes)
        self._through("createTable", name)

    def alter_table(self, name: str, model: dict, indexes: dict | None = None) -> None:
        """A new model, and new indexes if they are given; rows stay as they are until they are conformed. The key cannot change."""
        t = self.tables[name]
        pk = next((k.partition(":")[0] for k, v in model.items() if v.get("pk")), "_id")
        if pk != t.pk:
            raise ValueError(f"the key of {name} is {t.pk}")
        t.model, t.indexes = self._through("configTable", (model, t.indexes if indexes is None else indexes), name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        """The table goes, and with its rows what its foreign keys say of other tables' rows."""
        if if_exists and name not in self.tables:
            return
        self._through("dropTable", name)
        self._delete(name, self.tables[name].df, told=False)
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in sorted(self.tables)], "table string")

    def describe(self, name: str) -> DataFrame:
        t = self.tables[name]
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.name == t.pk) for f in t.df.schema], "column string, type string, pk boolean")

    def describe_indexes(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(k.partition(":")[0], k.partition(":")[2], bool(v.get("unique"))) for k, v in self.tables[name].indexes.items()], "index string, type string, unique boolean")

    def total(self, name: str) -> DataFrame:
        return self.tables[name].df.agg(F.count(F.lit(1)).alias("total"))

    # hooks and plugins
    def on(self, hook: str, f: Callable, priority: int = 0) -> None:
        """f(value, ...) -> value is called at the hook, those of a higher priority first. Cancelled, raised by it, ends what
        goes on there. Hooks: config, willConnect, postConnect, ready, disconnect, query, customQuery, read, write, conformRow, addRow,
        updateRow, deleteRow, configTable, createTable, dropTable, event, actionView, extend."""
        self.filters.setdefault(hook, []).append((priority, f))
        self.filters[hook].sort(key=lambda e: -e[0])

    def off(self, hook: str, f: Callable) -> None:
        self.filters[hook] = [e for e in self.filters.get(hook, []) if e[1] is not f]

    def _through(self, hook: str, value, *more):
        for _, f in self.filters.get(hook, []):
            value = f(value, *more)
        return value

    def listen_to(self, event: str, f: Callable[[dict], None], table: str | None = None) -> None:
        """f gets {target, event, ...} of events of the database (connect, ready, disconnect, slow query, custom ones) and of
        tables: select, upsert, delete, change (both) and * (all), with result and old rows as DataFrames."""
        self.listeners.append((event, table, f))

    def unlisten(self, f: Callable[[dict], None]) -> None:
        self.listeners = [x for x in self.listeners if x[2] is not f]

    def fire(self, event: str, table: str | None = None, **more) -> None:
        told = self._through("event", {"target": table or self.name, "event": event, **more})
        for kind, only, f in self.listeners:
            if (kind in (event, "*") or (kind == "change" and event in ("upsert", "delete"))) and only in (None, table):
                f(told)

    def define(self, name: str, make: Callable[..., Query], args: dict | None = None) -> None:
        """A preset query. args ({"least:int": {"default": 0}}) names its parameters: values are cast, others refused."""
        self.presets[name] = make if args is None else lambda db, **given: make(db, **_arguments(name, args, given))

    def preset(self, name: str, **args) -> Query:
        return self.presets[name](self, **args)

    def on_path(self, table: str, path: str, f: Callable[[DataFrame], None]) -> None:
        """f gets the key, old and new value of each row whose value at path an upsert or update has changed."""
        self.path_changes.append((table, path, f))

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """All changes to tables in the block, or none if it raises; events wait for its end. Tables are immutable
        DataFrames, so what is kept for going back are only their plans."""
        if self._held is not None:
            raise RuntimeError("a transaction is open")
        before, self._held = {n: copy.copy(t) for n, t in self.tables.items()}, []
        try:
            yield self
        except BaseException:
            self.tables, self._held = before, None
            raise
        told, self._held = self._held, None
        for event in told:
            event()

    def migrate(self, target: int, step: Callable[[Database, int], int]) -> None:
        """Calls step(database, version), which gives the version it has reached, until that is target."""
        while self.version != target:
            reached = step(self, self.version)
            if reached == self.version:
                raise ValueError(f"the step from version {reached} does not lead on to {target}")
            self.version = reached

    def do_action(self, name: str, **args):
        name, args = self._through("actionView", (name, args))
        return self.actions[name](self, **args)

    def view(self, name: str, **args) -> Query:
        name, args = self._through("actionView", (name, args))
        return self.views[name](self, **args)

    def custom(self, action: str, table: str, **args):
        """An action that a plugin's customQuery hook answers; rebuild search and rebuild indexes are there from the start."""
        if action == "rebuild search":
            return self.rebuild_search(table)
        if action == "rebuild indexes":  # files need none; what a join or filter wants to know of a table is its size
            return self.total(table)
        answer = self._through("customQuery", None, action, table, args)
        if answer is None:
            raise ValueError(f"no action {action}")
        return answer

    def rebuild_search(self, name: str) -> SearchIndex:
        """Builds the search index of the table's columns that have one in its indexes ({"text:string": {"search": {"tokenizer": ...}}})."""
        t = self.tables[name]
        found = {k.partition(":")[0]: v["search"] for k, v in t.indexes.items() if v.get("search")}
        mode = next((v.get("tokenizer") for v in found.values() if isinstance(v, dict)), None) or "english"
        t.search = SearchIndex.built(t.df, t.pk, list(found), mode)
        return t.search

    # reading
    def query(self, source, alias: str | None = None) -> Query:
        """A query on a table's name, a list of rows, a DataFrame, or a function from the condition to a DataFrame."""
        q = Query(self, source, alias)
        return self._through("query", q)

    def rows(self, source, where=None) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        if isinstance(source, str):
            return self._through("read", self._living(self.tables[source]), source)
        if callable(source):
            return source(where)
        return self.spark.createDataFrame(source)

    def _living(self, t: Table, now: Column | None = None) -> DataFrame:
        """The table's rows whose time is not over; of rows of which only some columns have a time, those are null after it."""
        if t.ttl is None:
            return t.df
        over = t.ttl.where(F.col("until") <= (F.current_timestamp() if now is None else now)).select(F.col("key").alias("_key"), "cols", F.lit(True).alias("_over"))
        rows = t.df.join(over, F.col(quoted(t.pk)) == F.col("_key"), "left").where("_over IS NULL OR cols IS NOT NULL")
        return rows.select(*(F.when(F.array_contains("cols", c), None).otherwise(F.col(quoted(c))).alias(c) if c != t.pk else F.col(quoted(c)) for c in t.df.columns))

    def page(self, key: str, q: Query | None, offset: int, limit: int) -> DataFrame:
        """Pages of a result that is made once."""
        if key not in self.caches:
            self.caches[key] = numbered(q.df(), "_n")
        return self.caches[key].where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")

    def clear_cache(self, key: str) -> None:
        self.caches.pop(key).unpersist()

    # writing
    def conformed(self, name: str, rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
        """rows cast to the table's model, with defaults, and errors for what breaks a constraint; columns `more` as they are."""
        t = self.tables[name]
        if not t.model:
            return rows
        out = []
        for key, props in t.model.items():
            if key == "*":
                continue
            col, _, kind = key.partition(":")
            c = F.col(quoted(col)) if col in rows.columns else F.lit(None)
            if kind == "uuid" and props.get("pk"):
                c = F.coalesce(c.cast("string"), F.uuid())
            elif kind in ("timeId", "timeIdms") and props.get("pk"):
                unit = F.unix_millis(F.current_timestamp()) if kind == "timeIdms" else F.unix_timestamp()
                c = F.coalesce(c.cast("string"), F.format_string("%013d-%s" if kind == "timeIdms" else "%010d-%s", unit, F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 8)))
            elif props.get("ai"):
                start = t.df.agg(F.coalesce(F.max(quoted(col)), F.lit(0)).alias("m"))
                if col not in rows.columns:
                    rows = rows.withColumn(col, F.lit(None).cast("long"))
                whole = rows.withColumn(col, F.col(quoted(col)).try_cast("long"))
                fresh = numbered(whole.where(F.col(quoted(col)).isNull()), "_n").crossJoin(F.broadcast(start))
                fresh = fresh.withColumn(col, F.col("m") + F.col("_n")).select(*map(quoted, rows.columns))
                rows = whole.where(F.col(quoted(col)).isNotNull()).select(*map(quoted, rows.columns)).unionAll(fresh)
                c = F.col(quoted(col))
            elif "default" in props:
                d = props["default"]
                d = d(rows) if callable(d) else F.lit(d)
                c = F.coalesce(c.cast("string"), d.cast("string")) if kind in ("int", "float", "number") else F.coalesce(c, d)
            wide = type_of(kind or "any", props.get("model"))
            c = c.cast(wide) if isinstance(wide, (T.StructType, T.MapType)) else F.when(c.isNotNull(), cast(rows, c, kind)) if not kind.endswith("[]") else F.transform(F.coalesce(c, F.array().cast(wide)), lambda x, k=kind: cast(rows.select(F.lit(0)), x, k[:-2]))
            c = c.cast(wide)
            for bad, what in ((c.isNull() if props.get("notNull") else None, "is null"), (c < props["min"] if "min" in props else None, "is too small"), (c > props["max"] if "max" in props else None, "is too large")):
                if bad is not None:
                    c = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{name}.{col} {what}")).cast(wide)).otherwise(c)
            out.append(c.alias(col))
        return rows.select(*out, *more)

    def upsert(self, name: str, rows, ttl: float | None = None, ttl_columns: list[str] | None = None) -> DataFrame:
        """New rows, and patches of those whose key exists: each column that a row has replaces the old value, also by null. Of
        rows with one key the later ones patch the earlier; the order is that of the list, or of the DataFrame's partitions and
        rows. Rows in a list need not have the same columns. With ttl the rows, or only ttl_columns of them, live so many seconds."""
        t = self.tables[name]
        new, has_ = _patches(self.spark, rows) if isinstance(rows, list) else (self.rows(rows), None)
        new = self._through("addRow", self._through("write", new, name), name)
        given = [c for c in new.columns if c != has_]
        checked = self._conformed_with(name, new.withColumn("_at", F.monotonically_increasing_id()), [c for c in ("_at", has_) if c])
        columns_new = [c for c in checked.columns if c not in ("_at", has_)]

        def latest(c: str) -> Column:  # of the rows that have the column
            place = F.col("_at") if has_ is None or c not in given else F.when(F.array_contains(has_, c), F.col("_at"))
            return F.max_by(F.struct(F.col(quoted(c))), place).alias(c)

        more = [F.flatten(F.collect_set(has_)).alias(has_)] if has_ else [F.lit(True).alias("_new")]
        new = checked.groupBy(quoted(t.pk)).agg(*(latest(c) for c in columns_new if c != t.pk), *more)
        if any(v.get("pk") and k.partition(":")[2] in ("uuid", "timeId", "timeIdms") for k, v in t.model.items()):
            new = kept(new)  # a key that is made up must be made once
        value = lambda c: F.col(f"_patch.{quoted(c)}") if c == t.pk else F.col(f"_patch.{quoted(c)}")[c]
        flat = new.alias("_patch").select(*(value(c).alias(c) for c in columns_new))
        for key, props in t.indexes.items():
            if props.get("unique"):
                self._check_unique(t, flat, key.partition(":")[0], bool(props.get("ignore_case")))
        frozen = {k.partition(":")[0] for k, v in t.model.items() if v.get("immutable")}
        before = t.df
        mine, patches = before.alias("_row"), new.withColumn("_new", F.lit(True)).alias("_patch")
        both = lambda how: mine.join(patches, F.col(f"_row.{quoted(t.pk)}") == F.col(f"_patch.{quoted(t.pk)}"), how).select(*(merged(c).alias(c) for c in columns))

        def merged(c: str) -> Column:
            old = F.col(f"_row.{quoted(c)}") if c in before.columns else F.lit(None)
            if c == t.pk:
                return F.coalesce(old, F.col(f"_patch.{quoted(c)}"))
            if c not in columns_new:
                return old
            patch = value(c)
            if c not in given:  # a default fills only new rows
                return F.when(F.col(f"_row.{quoted(t.pk)}").isNull(), patch).otherwise(old)
            if c in frozen:
                return F.coalesce(old, patch)
            here = F.col("_patch._new").isNotNull() if has_ is None else sure(F.array_contains(F.col(f"_patch.{has_}"), c)) | F.col(f"_row.{quoted(t.pk)}").isNull()
            return F.when(here, patch).otherwise(old)

        columns = list(dict.fromkeys([*before.columns, *columns_new]))
        self._set(t, self._through("updateRow", both("full"), name))
        if ttl is not None:
            until = F.current_timestamp() + F.make_dt_interval(secs=F.lit(float(ttl)))
            cols = F.array(*map(F.lit, ttl_columns)) if ttl_columns else F.lit(None).cast("array<string>")
            self._live(t, kept(flat.select(F.col(quoted(t.pk)).alias("key"), until.alias("until"), cols.alias("cols"))))
        # the rows written, without all others: not where a hook has a say, nor where the table has just been written out
        short = t.search is not None and t.changes and not self.filters.get("updateRow")
        self._changed(name, "upsert", flat, before, both("right").where(F.col(quoted(t.pk)).isNotNull()) if short else None)
        return flat

    def _conformed_with(self, name: str, rows: DataFrame, more: list[str]) -> DataFrame:
        """rows cast to the model, the columns `more` as they are."""
        if not self.tables[name].model:
            return rows
        done = self.conformed(name, rows.withColumn("_more", F.struct(*more)).drop(*more), ("_more",))
        return done.select(*(quoted(c) for c in done.columns if c != "_more"), "_more.*")

    def _set(self, t: Table, df: DataFrame) -> None:
        """The table's rows after a change; written out after some changes, so that plans stay short."""
        t.changes += 1
        if t.changes >= CHANGES:
            df, t.changes = kept(df), 0
        t.df = df

    def update(self, name: str, patch: dict, where=None, immutable: bool = False) -> DataFrame:
        """One patch (literals or Columns; nested paths a.b too) on every row that the condition holds for; gives the rows as
        they are then. name may be a path
        in a table (t.a), under which the patch goes. Immutable columns stay, where they have a value, unless immutable is set."""
        name, _, inside = name.partition(".")
        t = self.tables[name]
        frozen = set() if immutable else {k.partition(":")[0] for k, v in t.model.items() if v.get("immutable")}
        before = t.df
        df = before.withColumn("_hit", F.lit(True) if where is None else sure(condition(before, where)))
        for path, v in patch.items():
            path = f"{inside}.{path}" if inside else path
            top, _, rest = path.partition(".")
            v = v if isinstance(v, Column) else F.lit(v)
            v = F.col(quoted(top)).withField(rest, v) if rest else v.cast(df.schema[top].dataType) if top in df.columns else v
            old = F.col(quoted(top)) if top in df.columns else F.lit(None)
            mine = F.col("_hit") & old.isNull() if top in frozen else F.col("_hit")
            df = df.withColumn(top, F.when(mine, v).otherwise(old))
        df = self._through("updateRow", df, name)
        changed = df.where("_hit").drop("_hit")
        self._set(t, df.drop("_hit"))
        self._changed(name, "upsert", changed, before)
        return changed

    def update_immutable(self, name: str, patch: dict, where=None) -> DataFrame:
        return self.update(name, patch, where, immutable=True)

    def delete(self, name: str, where=None) -> DataFrame:
        """Deletes rows, following foreign keys, and gives the deleted ones."""
        t = self.tables[name]
        gone = t.df if where is None else t.df.where(condition(t.df, where))
        self._delete(name, gone, None if where is None else ~sure(condition(t.df, where)))
        return gone

    def _delete(self, name: str, gone: DataFrame, others: Column | None = None, told: bool = True) -> None:
        """gone: the rows to delete; others: a condition that holds for the rest, where there is one."""
        t = self.tables[name]
        gone = self._through("deleteRow", gone, name)
        keys = gone.select(F.col(quoted(t.pk)).alias("_k")).distinct()
        for child, fk in self._children(name):
            c, col = self.tables[child], fk["column"]
            match = F.col(quoted(col)) == F.col("_k")
            how = fk.get("onDelete", "NONE").upper()
            if how == "RESTRICT" and c.df.join(keys, match, "left_semi").limit(1).count():
                raise ValueError(f"rows of {child} refer to rows of {name}")
            if how == "CASCADE":
                self._delete(child, c.df.join(keys, match, "left_semi"))
            elif how == "SET_NULL":
                mark = keys.withColumn("_hit", F.lit(True))
                self._set(c, c.df.join(mark, match, "left").withColumn(col, F.when(F.col("_hit"), None).otherwise(F.col(quoted(col)))).drop("_k", "_hit"))
        if others is not None and not self.filters.get("deleteRow"):
            self._set(t, t.df.where(others))
        else:
            self._set(t, t.df.join(keys, F.col(quoted(t.pk)) == F.col("_k"), "left_anti"))
        if t.ttl is not None:
            t.ttl = t.ttl.join(keys, F.col("key") == F.col("_k"), "left_anti")
        if told:
            self._changed(name, "delete", gone)

    def conform_rows(self, name: str, change: Callable[[DataFrame], DataFrame] | None = None, where=None) -> None:
        """Rows, all or those of the condition, changed by `change` and cast to the model."""
        t = self.tables[name]
        mine = t.df if where is None else t.df.where(condition(t.df, where))
        done = self._through("conformRow", self.conformed(name, change(mine) if change else mine), name)
        self._set(t, done if where is None else done.unionByName(t.df.where(~sure(condition(t.df, where))), allowMissingColumns=True))

    def clone(self, name: str, path: str) -> DataFrame | Database:
        """Copies a table to a folder, and gives it as read from there. * copies all tables, each to a folder of its name, and gives a
        database of the copies, with their models and indexes."""
        if name != "*":
            self.tables[name].df.write.mode("overwrite").parquet(path)
            return self.spark.read.parquet(path)
        out = Database(self.spark, f"{self.name}-copy")
        for t in self.tables.values():
            out.tables[t.name] = Table(t.name, self.clone(t.name, f"{path}/{t.name}"), t.model, t.pk, t.indexes)
        return out

    # time to live
    def _live(self, t: Table, times: DataFrame) -> None:
        if t.ttl is not None:
            times = t.ttl.join(times.select("key"), "key", "left_anti").unionByName(times)
        t.ttl = kept(times)

    def expires(self, name: str, key) -> DataFrame:
        """key, until, seconds (left, negative when over) and cols of the row with that key, if it has a time."""
        t = self.tables[name]
        if t.ttl is None:
            return self.spark.createDataFrame([], T.StructType([t.df.schema[t.pk]]).add("until", "timestamp").add("seconds", "double").add("cols", "array<string>")).withColumnRenamed(t.pk, "key")
        left = F.unix_micros("until") - F.unix_micros(F.current_timestamp())
        return t.ttl.where(F.col("key") == F.lit(key)).select("key", "until", (left / 1e6).alias("seconds"), "cols")

    def clear_ttl(self, name: str, key) -> None:
        t = self.tables[name]
        if t.ttl is not None:
            t.ttl = t.ttl.where(F.col("key") != F.lit(key))

    def sweep(self, name: str, now: Column | None = None) -> None:
        """Rows whose time is over are deleted, following foreign keys, and columns whose time is over become null."""
        t = self.tables[name]
        if t.ttl is None:
            return
        now = F.current_timestamp() if now is None else now
        over = kept(t.ttl.where(F.col("until") <= now))
        rows = kept(self._living(t, now))
        gone = t.df.join(over.where("cols IS NULL"), F.col(quoted(t.pk)) == F.col("key"), "left_semi")
        t.ttl = t.ttl.join(over.select("key"), "key", "left_anti")
        self._delete(name, gone)
        self._set(t, rows)

    def expire(self, name: str, now: Column, column: str = "expires_at", only: list[str] | None = None) -> None:
        """The same by a column of the table that holds the time: rows past it go, or only some of their columns become null."""
        t = self.tables[name]
        over = sure(F.col(quoted(column)) <= now)
        self._set(t, t.df.withColumns({c: F.when(over, None).otherwise(F.col(quoted(c))) for c in only}) if only else t.df.where(~over))

    def _check_unique(self, t: Table, new: DataFrame, col: str, fold: bool) -> None:
        value = F.upper(quoted(col)) if fold else F.col(quoted(col))
        rows = t.df.join(new.select(t.pk), t.pk, "left_anti").select(value.alias("v")).unionAll(new.select(value.alias("v")))
        if rows.where("v IS NOT NULL").groupBy("v").count().where("count > 1").limit(1).count():
            raise ValueError(f"unique index on {t.name}.{col}: a value is there already")

    def _children(self, name: str):
        for t in self.tables.values():
            for key, props in t.indexes.items():
                fk = props.get("foreignKey")
                if fk and fk["target"].partition(".")[0] == name:
                    yield t.name, fk | {"column": key.partition(":")[0]}

    def _changed(self, name: str, what: str, rows: DataFrame, before: DataFrame | None = None, written: DataFrame | None = None) -> None:
        """written: the table's rows of the keys of `rows` as they are now, if there is a shorter way to them than through all rows."""
        t = self.tables[name]
        events = [lambda f=f: f(name, what, rows) for f in self.changes]
        if self.listeners:
            old = rows if before is None else before.join(rows.select(t.pk), t.pk, "left_semi")
            events.append(lambda: self.fire(what, name, key=t.pk, result=rows, old=old))
        if t.search is not None:
            now = written if written is not None else t.df.join(rows.select(t.pk), t.pk, "left_semi")
            t.search = t.search.changed(rows, gone=True) if what == "delete" else t.search.changed(now, keys=rows)
        for table, path, f in self.path_changes:
            if table == name and before is not None:
                events.append(lambda f=f, changed=_changed_at(before, t.df, t.pk, path): f(changed))
        if self._held is not None:
            self._held += events
            return
        for event in events:
            event()

    # import
    def load_js(self, name: str, rows: list[dict], progress: Callable[[float], None] | None = None, batch: int = 10_000) -> None:
        """Upserts rows in batches; progress gets the percentage done."""
        for i in range(0, len(rows), batch):
            self.upsert(name, rows[i : i + batch])
            if progress:
                progress(100.0 * min(len(rows), i + batch) / len(rows))

    def load_csv(self, name: str, path: str, row_map: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Upserts the rows of CSV files, as read_csv reads them, changed by row_map."""
        from .formats import read_csv

        rows = read_csv(self.spark, path)
        self.upsert(name, row_map(rows) if row_map else rows)

    # SQL text
    def sql(self, text: str, args: dict | list | None = None) -> DataFrame:
        """One statement. args: values of :name, $name or @name (a dict), or of ? (a list). Statements that change tables give the
        rows that they have written or deleted."""
        from .dialect import execute

        for t in self.tables.values():
            self.rows(t.name).createOrReplaceTempView(t.name)
        return execute(self, text, args)


class Databases:
    """Databases by name; one of them is in use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known, self.current = spark, {}, None

    def create(self, name: str) -> Database:
        if name in self.known:
            raise ValueError(f"database {name} exists")
        self.known[name] = Database(self.spark, name).connect()
        return self.use(name)

    def use(self, name: str) -> Database:
        self.current = self.known[name]
        return self.current

    def names(self) -> list[str]:
        return sorted(self.known)

    def drop(self, name: str) -> None:
        """The database's tables are dropped, and it is disconnected."""
        d = self.known.pop(name)
        d.disconnect()
        d.tables.clear()
        if self.current is d:
            self.current = None


def _patches(spark: SparkSession, rows: list) -> tuple[DataFrame, str | None]:
    """Rows in a list as a DataFrame, in one partition and so in order; if they have different columns, with a column that
    names those each row has."""
    if not rows or not isinstance(rows[0], dict):
        return spark.createDataFrame(rows).coalesce(1), None
    names = list(dict.fromkeys(k for r in rows for k in r))
    alike = all(r.keys() == rows[0].keys() for r in rows)
    some = [n for n in names if any(r.get(n) is not None for r in rows)]
    made = spark.createDataFrame([{n: r.get(n) for n in some} | ({} if alike else {"_has": list(r)}) for r in rows]).coalesce(1)
    return made.withColumns({n: F.lit(None) for n in names if n not in some}), None if alike else "_has"


def _changed_at(before: DataFrame, after: DataFrame, pk: str, path: str) -> DataFrame:
    """(key, old, new) of the rows whose value at path differs; a row or a path that was not there counts as null."""
    pick = lambda df, name: df.select(F.col(quoted(pk)).alias("key"), (resolve(df, path) if has(df, path) else F.lit(None)).alias(name))
    return pick(after, "new").join(pick(before, "old"), "key", "left").where(~F.col("old").eqNullSafe(F.col("new"))).select("key", "old", "new")


def _arguments(name: str, known: dict, given: dict) -> dict:
    kinds = {k.partition(":")[0]: (k.partition(":")[2], props) for k, props in known.items()}
    if strange := set(given) - set(kinds):
        raise ValueError(f"{name} has no parameter {sorted(strange)}")
    out = {}
    for k, (kind, props) in kinds.items():
        v = given.get(k, props.get("default"))
        if v is None and props.get("notNull"):
            raise ValueError(f"{name} needs {k}")
        out[k] = v if v is None else _argument(v, kind)
    return out


def _argument(v, kind: str):
    """A value from outside, cast as the data model casts columns."""
    if kind.endswith("[]"):
        return [_argument(x, kind[:-2]) for x in v]
    if kind in ("int", "float", "number"):
        try:
            n = float(v)
        except (TypeError, ValueError):
            n = 0.0
        return math.floor(n + 0.5) if kind == "int" else n
    if kind in ("bool", "boolean"):
        return v in (True, 1, "true", "1")
    return str(v) if kind in ("string", "uuid") else v
