"""SQL text: spellings that Spark SQL lacks, put into its own, and statements that change tables, carried out on a Database.

Quoted text, quoted names and comments are taken out before anything is looked for, and put back at the end, so that no
rule reaches into them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import quoted
from .formats import read_csv, read_json

_quoted = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.DOTALL)
_mark = re.compile("\x01(\\d+)\x02")
M = "\x01\\d+\x02"
_glob = re.compile(rf"(\S+)\s+(not\s+)?glob\s+({M})", re.IGNORECASE)
_nocase = re.compile(rf"((?:[\w.]|{M})+)\s+collate\s+nocase", re.IGNORECASE)
_fetch = re.compile(r"\b(?:offset\s+(\d+)\s+rows?\s+)?fetch\s+(?:next|first)\s+(\d+)\s+rows?\s+only\b", re.IGNORECASE)
_apply = re.compile(r"\b(cross|outer)\s+apply\s*\(", re.IGNORECASE)
_top = re.compile(r"\bselect\s+((?:distinct|all)\s+)?top\s+(\d+(?:\.\d+)?)(\s+percent)?\s+", re.IGNORECASE)
_file = re.compile(rf"\b(from|join)\s+(?:(csv|tab|tsv|json|parquet)\s*\(\s*({M})\s*\)|({M}))", re.IGNORECASE)
_corresponding = re.compile(r"\b(union\s+all|union|except|intersect)\s+corresponding\b(?:\s+by\s*\(([^)]*)\))?", re.IGNORECASE)
_arrow = re.compile(rf"([A-Za-z_][\w.]*)((?:\s*->\s*(?:\w+|{M}))+)(?!\s*\()")
_words = (
    (re.compile(r"\bselect\s+unique\b", re.IGNORECASE), "select distinct"),
    (re.compile(r"\bgetdate\s*\(\s*\)", re.IGNORECASE), "current_timestamp()"),
    (re.compile(r"\bifnull\s*\(", re.IGNORECASE), "nvl("),
    (re.compile(r"\bgrouping\s+set\s*\(", re.IGNORECASE), "GROUPING SETS ("),
    (re.compile(r"\bconvert\s*\(\s*(\w+)\s*,\s*([^()]+|[^()]*\([^()]*\)[^()]*)\)", re.IGNORECASE), r"cast(\2 AS \1)"),
    (re.compile(r"(?<![:\w])[$@]([A-Za-z_]\w*)"), r":\1"),
)


class Text:
    """SQL with its quoted parts taken out."""

    def __init__(self, text: str):
        self.parts: list[str] = []
        self.bare = _quoted.sub(self._out, text).strip().rstrip(";").strip()

    def _out(self, m: re.Match) -> str:
        if m[0].startswith(("--", "/*")):
            return " "
        self.parts.append(m[0])
        return f"\x01{len(self.parts) - 1}\x02"

    def whole(self, bare: str) -> str:
        return _mark.sub(lambda m: self.parts[int(m[1])], bare)

    def value(self, mark: str) -> str:
        """What a quoted part says."""
        part = self.whole(mark.strip())
        return part[1:-1].replace(part[0] * 2, part[0])


def glob_pattern(text: str) -> str:
    return "^" + "".join({"*": ".*", "?": "."}.get(c) or (c if c in "[]" else re.escape(c)) for c in text) + "$"


def _end(bare: str, at: int) -> int:
    """Where the select that `at` lies in ends: at the bracket that closes it, a set operator, or the end of the text."""
    depth = 0
    for m in re.finditer(r"[()]|\b(?:union|except|intersect)\b", bare[at:], re.IGNORECASE):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth -= 1
            if depth < 0:
                return at + m.start()
        elif depth == 0:
            return at + m.start()
    return len(bare)


def _split(bare: str, by: str = ",") -> list[str]:
    """Parts between separators that stand in no bracket."""
    out, depth, last = [], 0, 0
    for m in re.finditer(rf"[()]|{by}", bare, re.IGNORECASE):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth == 0:
            out.append(bare[last : m.start()].strip())
            last = m.end()
    return [*out, bare[last:].strip()]


def _rewritten(t: Text, bare: str, run: Callable[[str], DataFrame], view: Callable[[DataFrame], str]) -> str:
    for pattern, by in _words:
        bare = pattern.sub(by, bare)
    bare = _glob.sub(lambda m: f"{m[1]} {m[2] or ''}RLIKE r'{glob_pattern(t.value(m[3]))}'", bare)
    bare = _nocase.sub(r"lower(\1)", bare)
    bare = _fetch.sub(lambda m: f"LIMIT {m[2]}" + (f" OFFSET {m[1]}" if m[1] else ""), bare)
    bare = _apply.sub(lambda m: ("CROSS" if m[1].lower() == "cross" else "LEFT OUTER") + " JOIN LATERAL (", bare)
    bare = _arrow.sub(lambda m: f"get_json_object({m[1]}, '$" + "".join(f"[{x}]" if x.isdigit() else f".{t.value(x) if x[0] == chr(1) else x}" for x in re.split(r"\s*->\s*", m[2])[1:]) + "')", bare)
    bare = _file.sub(lambda m: f"{m[1]} {view(_read(run, t, m[2], m[3] or m[4]))}" if m[2] or t.whole(m[4])[0] == "'" else m[0], bare)
    while found := [*_top.finditer(bare)]:  # the last one first, so that inner selects are done before those around them
        m = found[-1]
        end = _end(bare, m.end())
        inner = f"select {m[1] or ''}{bare[m.end() : end].rstrip()}"
        if m[3]:
            rows = run(t.whole(inner))
            inner = f"select * from {view(rows.limit(math.ceil(rows.count() * float(m[2]) / 100)))} "
        else:
            inner = f"{inner} LIMIT {m[2]} "
        if re.search(r"\b(union|all|distinct|except|intersect)$", bare[: m.start()].rstrip(), re.IGNORECASE) or bare[end : end + 1].strip(")"):
            inner = f"({inner}) "  # one side of a set operation
        bare = bare[: m.start()] + inner + bare[end:]
    if m := next((m for m in _corresponding.finditer(bare) if bare[: m.start()].count("(") == bare[: m.start()].count(")")), None):
        left, right = (_rewritten(t, x, run, view) for x in (bare[: m.start()], bare[m.end() :]))
        sides = [view(run(t.whole(x))) for x in (left, right)]
        a, b = (run(f"SELECT * FROM {x}").columns for x in sides)
        names = [n.strip() for n in m[2].split(",")] if m[2] else [c for c in a if c.lower() in {x.lower() for x in b}]
        if not names:
            raise ValueError("CORRESPONDING: no common columns")
        bare = f" {m[1]} ".join(f"SELECT {', '.join(quoted(n) for n in names)} FROM {x}" for x in sides)
    return bare


def _read(run: Callable, t: Text, kind: str | None, mark: str) -> DataFrame:
    """A file that a FROM names, by its function or its ending."""
    path, spark = t.value(mark), run("SELECT 1").sparkSession
    kind = (kind or path.rpartition(".")[2]).lower()
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tab", "tsv", "txt"):
        return read_csv(spark, path, "," if kind == "csv" else "\t")
    raise ValueError(f"{path}: no reader for {kind}")


def execute(db: Any, text: str, args: dict | list | None = None) -> DataFrame:
    """Carries out one statement on a Database, whose tables are views of the session."""
    t, views = Text(text), []

    def run(sql: str) -> DataFrame:
        names = set(re.findall(r":([A-Za-z_]\w*)", sql))
        given = {k: v for k, v in args.items() if k in names} if isinstance(args, dict) else args
        return db.spark.sql(sql, args=given) if given else db.spark.sql(sql)

    def view(df: DataFrame) -> str:
        views.append(f"_made{len(views)}")
        df.createOrReplaceTempView(views[-1])
        return views[-1]

    def query(bare: str) -> DataFrame:
        return run(t.whole(_rewritten(t, bare, run, view)))

    try:
        first = t.bare.split(None, 1)[0].lower() if t.bare else ""
        change = {"insert": _insert, "update": _update, "delete": _delete, "merge": _merge, "truncate": _truncate, "create": _create, "drop": _drop, "alter": _alter}.get(first)
        return change(db, t, query) if change else query(t.bare)
    finally:
        for name in views:
            db.spark.catalog.dropTempView(name)


def _match(pattern: str, t: Text) -> re.Match:
    m = re.fullmatch(pattern, t.bare, re.IGNORECASE | re.DOTALL)
    if not m:
        raise ValueError(f"cannot read {t.whole(t.bare)!r}")
    return m


def _name(t: Text, text: str) -> str:
    text = text.strip()
    return t.value(text) if text.startswith("\x01") else text


NAME = rf"(\w+|{M})"


def _insert(db, t: Text, query) -> DataFrame:
    """INSERT INTO table [(columns)] VALUES ... or a select; rows whose key is there patch the old ones."""
    m = _match(rf"insert\s+(?:or\s+\w+\s+)?into\s+(?:table\s+)?{NAME}\s*(?:\(([^)]*)\)\s*)?(values\b.*|select\b.*|with\b.*)", t)
    name = _name(t, m[1])
    rows = query(f"SELECT * FROM {m[3]}" if m[3].lower().startswith("values") else m[3])
    names = [_name(t, c) for c in m[2].split(",")] if m[2] else db.tables[name].df.columns
    if len(names) != len(rows.columns):
        raise ValueError(f"{len(rows.columns)} values for the columns {names}")
    return db.upsert(name, rows.toDF(*names))


def _assigned(t: Text, text: str) -> dict[str, str]:
    """column = expression, ... -> column: expression."""
    out = {}
    for part in _split(text):
        left, _, right = part.partition("=")
        out[_name(t, left.rpartition(".")[2])] = right.strip()
    return out


def _update(db, t: Text, query) -> DataFrame:
    m = _match(rf"update\s+{NAME}\s+set\s+(.*)", t)
    name = _name(t, m[1])
    sets, where = (*_split(m[2], r"\bwhere\b"), None)[:2]
    patch = _assigned(t, sets)
    where = f" WHERE {where}" if where else ""
    if re.search(r"\bselect\b", m[2], re.IGNORECASE):  # with sub-queries: the changed rows by a query
        pk = quoted(db.tables[name].pk)
        return db.upsert(name, query(f"SELECT {pk}, {', '.join(f'{e} AS {quoted(c)}' for c, e in patch.items())} FROM {quoted(name)}{where}"))
    cond = (lambda df: F.expr(t.whole(where[7:]))) if where else None
    return db.update(name, {c: F.expr(t.whole(e)) for c, e in patch.items()}, cond)


def _delete(db, t: Text, query) -> DataFrame:
    m = _match(rf"delete\s+from\s+{NAME}(?:\s+where\s+(.*))?", t)
    name = _name(t, m[1])
    if m[2] and re.search(r"\bselect\b", m[2], re.IGNORECASE):
        gone = query(f"SELECT * FROM {quoted(name)} WHERE {m[2]}")
        db._delete(name, gone)
        return gone
    return db.delete(name, (lambda df: F.expr(t.whole(m[2]))) if m[2] else None)


def _truncate(db, t: Text, query) -> DataFrame:
    return db.delete(_name(t, _match(rf"truncate\s+(?:table\s+)?{NAME}", t)[1]))


def _merge(db, t: Text, query) -> DataFrame:
    """MERGE INTO table [AS a] USING table or (select) [AS b] ON condition WHEN [NOT] MATCHED [AND condition] THEN UPDATE SET ...,
    DELETE or INSERT (columns) VALUES (...): all clauses read the tables as they were; of those of a kind the first that holds counts."""
    m = _match(rf"merge\s+into\s+{NAME}(?:\s+(?:as\s+)?(?!using\b)(\w+))?\s+using\s+({NAME}|\(.*?\))(?:\s+(?:as\s+)?(?!on\b)(\w+))?\s+on\s+(.*?)\s+(when\s+.*)", t)
    name, a = _name(t, m[1]), m[2] or _name(t, m[1])
    b = m[5] or _name(t, m[4] or "")
    target, source, on = f"{quoted(name)} AS {a}", f"{m[3]} AS {b}", m[6]
    pk, work, seen = db.tables[name].pk, [], {True: [], False: []}
    for clause in re.split(r"\bwhen\s+", m[7], flags=re.IGNORECASE)[1:]:
        c = re.fullmatch(r"(not\s+)?matched(?:\s+by\s+target)?(?:\s+and\s+(.*?))?\s+then\s+(update\s+set\s+.*|delete|insert\s+.*)", clause.strip(), re.IGNORECASE | re.DOTALL)
        if not c:
            raise ValueError(f"cannot read WHEN {t.whole(clause)}")
        met, what = not c[1], c[3]
        before = [f"NOT coalesce({x}, false)" for x in seen[met]]
        where = " AND ".join([*before, *([f"({c[2]})"] if c[2] else [])])
        where = f" WHERE {where}" if where else ""
        seen[met].append(c[2] or "true")
        rows = f"{target} JOIN {source} ON {on}{where}" if met else f"{source} LEFT ANTI JOIN {target} ON {on}{where}"
        if what.lower() == "delete":
            work.append(("delete", query(f"SELECT {a}.* FROM {rows}")))
        elif met:
            patch = _assigned(t, re.sub(r"^update\s+set\s+", "", what, flags=re.IGNORECASE))
            work.append(("upsert", query(f"SELECT {a}.{quoted(pk)}, {', '.join(f'{e} AS {quoted(k)}' for k, e in patch.items() if k != pk)} FROM {rows}")))
        else:
            i = re.fullmatch(r"insert\s*\(([^)]*)\)\s*values\s*\((.*)\)", what, re.IGNORECASE | re.DOTALL)
            if not i:
                raise ValueError(f"cannot read {t.whole(what)}")
            work.append(("upsert", query("SELECT " + ", ".join(f"{e} AS {quoted(_name(t, k))}" for k, e in zip(i[1].split(","), _split(i[2]), strict=True)) + f" FROM {rows}")))
    for what, rows in work:
        if what == "delete":
            db._delete(name, rows)
        else:
            db.upsert(name, rows)
    return db.rows(name)


#: SQL type -> type of the data model; fixed values. Types that are not here are text.
TYPES = {"int": "int", "integer": "int", "bigint": "int", "smallint": "int", "tinyint": "int", "float": "float", "double": "float", "real": "float", "number": "float", "numeric": "float", "decimal": "float", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "date", "timestamp": "date", "uuid": "uuid"}


def _column(t: Text, text: str) -> tuple[str, dict]:
    words = text.split()
    name, kind = _name(t, words[0]), TYPES.get(re.sub(r"\(.*", "", words[1]).lower() if len(words) > 1 else "", "string")
    rest, props = " ".join(words[2:]).lower(), {}
    if "primary key" in rest:
        props["pk"] = True
    if re.search(r"auto_?increment|\bidentity\b", rest):
        props["ai"] = True
    if "not null" in rest:
        props["notNull"] = True
    if d := re.search(rf"\bdefault\s+({M}|\S+)", " ".join(words[2:]), re.IGNORECASE):
        v = t.value(d[1]) if d[1].startswith("\x01") else d[1]
        props["default"] = v if d[1].startswith("\x01") or kind == "string" else {"true": True, "false": False}.get(v.lower(), v) if kind == "boolean" else float(v) if kind == "float" else int(v)
    return f"{name}:{kind}", props


def _create(db, t: Text, query) -> DataFrame:
    """CREATE TABLE with columns or AS a select, CREATE VIEW, CREATE INDEX."""
    head = re.match(rf"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:(unique)\s+)?(table|view|index)\s+(if\s+not\s+exists\s+)?{NAME}\s*", t.bare, re.IGNORECASE)
    if not head:
        raise ValueError(f"cannot read {t.whole(t.bare)!r}")
    name, rest = _name(t, head[4]), t.bare[head.end() :]
    if head[2].lower() == "index":
        m = re.fullmatch(rf"on\s+{NAME}\s*\(\s*{NAME}[^)]*\)", rest, re.IGNORECASE)
        if not m:
            raise ValueError(f"cannot read {t.whole(t.bare)!r}")
        table = _name(t, m[1])
        db.tables[table].indexes[f"{_name(t, m[2])}:string"] = {"unique": bool(head[1]), "name": name}
        return db.describe_indexes(table)
    if as_ := re.match(r"as\s+", rest, re.IGNORECASE):
        if name not in db.tables or head[2].lower() == "view":
            db.attach(name, query(rest[as_.end() :]))
        elif not head[3]:
            raise ValueError(f"table {name} exists")
        return db.describe(name)
    model, indexes = {}, {}
    for part in _split(rest.strip()[1:-1]):
        if key := re.match(rf"primary\s+key\s*\(\s*{NAME}\s*\)", part, re.IGNORECASE):
            model = {k: (v | {"pk": True} if k.partition(":")[0] == _name(t, key[1]) else v) for k, v in model.items()}
        elif key := re.match(rf"foreign\s+key\s*\(\s*{NAME}\s*\)\s*references\s+{NAME}\s*\(\s*{NAME}\s*\)(?:\s+on\s+delete\s+(cascade|restrict|set\s+null|no\s+action))?", part, re.IGNORECASE):
            how = {"": "NONE", "noaction": "NONE", "setnull": "SET_NULL"}.get(re.sub(r"\s", "", key[4] or "").lower(), (key[4] or "").upper())
            indexes[f"{_name(t, key[1])}:string"] = {"foreignKey": {"target": f"{_name(t, key[2])}.{_name(t, key[3])}", "onDelete": how}}
        else:
            column, props = _column(t, part)
            model[column] = props
            if re.search(r"\bunique\b", part, re.IGNORECASE):
                indexes[column] = {"unique": True}
    db.create_table(name, model, bool(head[3]), indexes)
    return db.describe(name)


def _drop(db, t: Text, query) -> DataFrame:
    m = _match(rf"drop\s+(?:table|view)\s+(if\s+exists\s+)?{NAME}", t)
    db.drop(_name(t, m[2]), bool(m[1]))
    return db.show_tables()


def _alter(db, t: Text, query) -> DataFrame:
    """ADD, DROP and RENAME COLUMN: the rows are changed with the model."""
    m = _match(rf"alter\s+table\s+{NAME}\s+(?:(add)\s+(?:column\s+)?(.*)|(drop)\s+(?:column\s+)?{NAME}|(rename)\s+(?:column\s+)?{NAME}\s+to\s+{NAME})", t)
    name = _name(t, m[1])
    table = db.tables[name]
    if m[2]:
        column, props = _column(t, m[3])
        db.alter_table(name, (table.model or _model(table)) | {column: props})
        db.conform_rows(name)
    else:
        old = _name(t, m[5] or m[7])
        if old == table.pk:
            raise ValueError(f"{old} is the key of {name}")
        new = _name(t, m[8]) if m[6] else None
        renamed = lambda k: f"{new}{k[len(old) :]}" if k.partition(":")[0] == old else k
        table.model = {renamed(k) if new else k: v for k, v in table.model.items() if new or k.partition(":")[0] != old}
        table.df = table.df.withColumnRenamed(old, new) if new else table.df.drop(old)
    return db.describe(name)


def _model(table) -> dict:
    kinds = {"bigint": "int", "int": "int", "double": "float", "float": "float", "boolean": "boolean", "timestamp": "date", "timestamp_ntz": "date"}
    return {f"{f.name}:{kinds.get(f.dataType.simpleString(), 'string')}": {"pk": True} if f.name == table.pk else {} for f in table.df.schema}
