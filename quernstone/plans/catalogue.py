"""The engine's queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates, scalars
from ..functions.scalars import within
from ..functions.search import search
from ..sources.formats import csv_lines, dump, load_dump, read_csv, read_json
from ..sources.tables import Database
from ..streaming.changes import sessions, windowed
from .numbering import fresh_path, numbered
from .query import Query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def database(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.dir = sf_dir
    for t in TABLES:
        db.attach(t, spark.read.parquet(f"{sf_dir}/{t}.parquet"))
    return db


def add(name: str, build: Callable[[Database], Query | DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = build(database(spark, sf_dir))
        return made.df() if isinstance(made, Query) else made

    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


add(
    "flagship",
    lambda db: db.query("customer").join({"type": "inner", "with": {"table": "orders"}, "on": ["customer.c_custkey", "=", "orders.o_custkey"]}).where(["c_acctbal", ">", 0])
    .select(["customer.c_mktsegment AS segment", "COUNT(*) AS n", "SUM(orders.o_totalprice) AS total"]).group_by(["customer.c_mktsegment ASC"]).having(["n", ">", 10]).order_by(["total DESC"]).limit(10),
    "SELECT c_mktsegment AS segment, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 0 GROUP BY 1 HAVING count(*) > 10 ORDER BY total DESC LIMIT 10",
)
# sums of doubles are rounded on both sides
QUERIES["flagship"], _raw = (lambda spark, d: _raw(spark, d).withColumn("total", F.round("total", 2))), QUERIES["flagship"]
ORACLE_SQL["flagship"] = ORACLE_SQL["flagship"].replace("sum(o_totalprice) AS total", "round(sum(o_totalprice), 2) AS total")

# ---- comparators. v: nulls on every fifth nation, as the tables have none
_customers = "(SELECT *, nullif(c_nationkey % 5, 0) AS v, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE [c_nationkey % 3, c_nationkey % 7] END AS arr, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE [c_mktsegment, c_name] END AS words FROM customer)"


def _nullable(db: Database) -> DataFrame:
    n = F.col("c_nationkey")
    none = n % 4 == 0
    return db.rows("customer").withColumns({"v": F.nullif(n % 5, F.lit(0)), "arr": F.when(~none, F.array(n % 3, n % 7)), "words": F.when(~none, F.array("c_mktsegment", "c_name"))})


def _where(name: str, where, sql: str) -> None:
    add(f"where_{name}", lambda db: db.query(_nullable(db)).select(["c_custkey", "c_name"]).where(where), f"SELECT c_custkey, c_name FROM {_customers} WHERE {sql}")


for _name, _cond, _sql in (
    ("eq", ["v", "=", 2], "v = 2"),
    ("ne", ["v", "!=", 2], "v IS DISTINCT FROM 2"),
    ("lt", ["c_acctbal", "<", 1000], "c_acctbal < 1000"),
    ("gt", ["v", ">", 2], "v > 2"),
    ("le", ["v", "<=", 2], "v <= 2"),
    ("ge", ["v", ">=", 3], "v >= 3"),
    ("in", ["v", "IN", [1, 3]], "v IN (1, 3)"),
    ("not_in", ["v", "NOT IN", [1, 3]], "coalesce(v NOT IN (1, 3), true)"),
    ("between", ["c_acctbal", "BETWEEN", [100, 900]], "c_acctbal BETWEEN 100 AND 900"),
    ("not_between", ["v", "NOT BETWEEN", [2, 3]], "v <= 2 OR v >= 3"),
    ("like", ["c_mktsegment", "LIKE", "%u_l%"], "c_mktsegment ILIKE '%u_l%'"),
    ("like_prefix", ["c_name", "LIKE", "customer#00000001%"], "c_name ILIKE 'customer#00000001%'"),
    ("not_like", ["c_mktsegment", "NOT LIKE", "b%"], "NOT coalesce(c_mktsegment, '') ILIKE 'b%'"),
    ("regexp", ["c_name", "REGEXP", "[02468]$"], "regexp_matches(c_name, '[02468]$')"),
    ("includes", ["arr", "INCLUDES", 2], "coalesce(list_contains(arr, 2), false)"),
    ("not_includes", ["arr", "NOT INCLUDES", 2], "NOT coalesce(list_contains(arr, 2), false)"),
    ("includes_like", ["words", "INCLUDES LIKE", "auto%"], "c_nationkey % 4 <> 0 AND (c_mktsegment ILIKE 'auto%' OR c_name ILIKE 'auto%')"),
    ("intersect", ["arr", "INTERSECT", [1, 6]], "coalesce(list_has_any(arr, [1, 6]), false)"),
    ("intersect_all", ["arr", "INTERSECT ALL", [2, 5]], "coalesce(list_has_all(arr, [2, 5]), false)"),
    ("not_intersect", ["arr", "NOT INTERSECT", [1, 6]], "NOT coalesce(list_has_any(arr, [1, 6]), false)"),
    ("null", ["v", "=", "NULL"], "v IS NULL"),
    ("not_null", ["v", "=", "NOT NULL"], "v IS NOT NULL"),
    ("left_to_right", [["v", "=", 1], "OR", ["c_acctbal", ">", 5000], "AND", ["c_nationkey", "<", 10]], "(coalesce(v = 1, false) OR c_acctbal > 5000) AND c_nationkey < 10"),
    ("nested", [["v", "=", 1], "AND", [["c_acctbal", ">", 5000], "OR", ["c_acctbal", "<", 0]]], "v = 1 AND (c_acctbal > 5000 OR c_acctbal < 0)"),
    ("function", lambda df: F.col("c_custkey") % 7 == 3, "c_custkey % 7 = 3"),
    ("in_function", ["LEVENSHTEIN(c_mktsegment, 'BUILDINGS')", "<", 3], "levenshtein(c_mktsegment, 'BUILDINGS') < 3"),
    ("path_index", ["arr[1]", "=", 5], "arr[2] = 5"),
    ("length", ["arr.length", "=", 2], "len(arr) = 2"),
):
    _where(_name, _cond, _sql)
add("where_date", lambda db: db.query("orders").select(["o_orderkey"]).where([["o_orderdate", ">=", "1996-01-01"], "AND", ["o_orderdate", "<", "1996-07-01"]]), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-07-01'")
add("where_json_path", lambda db: db.query("events").select(["event_id", "props.k AS k"]).where(["props.k", "LIKE", "1%"]), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') LIKE '1%'")

# ---- scans
add("scan_point", lambda db: db.query("customer").where(["c_custkey", "=", 42]), "SELECT * FROM customer WHERE c_custkey = 42")
add("scan_range", lambda db: db.query("orders").where(["o_orderkey", "BETWEEN", [100, 500]]), "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 500")
add("scan_multi_get", lambda db: db.query("part").where(["p_partkey", "IN", [1, 5, 9, 700]]), "SELECT * FROM part WHERE p_partkey IN (1, 5, 9, 700)")
add("scan_rows", lambda db: db.query([{"id": 1, "s": "a"}, {"id": 2, "s": "b"}]).where(["id", ">", 1]), "SELECT 2::BIGINT AS id, 'b' AS s")
add("scan_function", lambda db: db.query(lambda where: db.rows("nation")).where(["n_regionkey", "=", 1]), "SELECT * FROM nation WHERE n_regionkey = 1")
add("scan_page", lambda db: db.page("p", db.query("customer").select(["c_custkey"]).order_by(["c_custkey ASC"]), 100, 50), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
add("total", lambda db: db.total("lineitem"), "SELECT count(*) AS total FROM lineitem")
add("show_tables", lambda db: db.show_tables(), "SELECT unnest(['region','nation','customer','supplier','part','orders','lineitem','events']) AS \"table\"")
add("export_csv", lambda db: csv_lines(db.rows("nation"), header=False), "SELECT 1 AS at, n_nationkey || ',\"' || n_name || '\",' || n_regionkey AS line FROM nation")


# ---- functions: rounded where the last bits of doubles may differ
def _functions(name: str, table: str, key: str, pairs: dict[str, tuple[str, str]], digits: int | None = None) -> None:
    def build(db: Database) -> DataFrame:
        df = db.query(table).select([key, *(f"{e} AS {a}" for a, (e, _) in pairs.items())]).df()
        return df.select(key, *(F.round(F.col(a).cast("double"), digits).alias(a) for a in pairs)) if digits is not None else df

    wrap = (lambda s: f"round(CAST({s} AS DOUBLE), {digits})") if digits is not None else (lambda s: s)
    add(name, build, f"SELECT {key}, {', '.join(f'{wrap(s)} AS {a}' for a, (_, s) in pairs.items())} FROM {table}")


_functions("fn_strings", "customer", "c_custkey", {
    "lo": ("LOWER(c_name)", "lower(c_name)"), "up": ("UPPER(c_mktsegment)", "upper(c_mktsegment)"), "tr": ("TRIM(CONCAT(' \t', c_name, ' '))", "c_name"), "cc": ("CONCAT(c_name, '-', c_nationkey)", "c_name || '-' || c_nationkey"),
    "cw": ("CONCAT_WS('/', c_name, c_mktsegment)", "concat_ws('/', c_name, c_mktsegment)"), "rp": ("REPLACE(c_name, '0', 'X')", "regexp_replace(c_name, '0', 'X')"), "sc": ("STRCMP(c_mktsegment, 'FURNITURE')", "CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment > 'FURNITURE' THEN 1 ELSE 0 END"),
    "le": ("LEVENSHTEIN(c_mktsegment, 'MACHINERY')", "levenshtein(c_mktsegment, 'MACHINERY')::INT"), "ln": ("c_name.length", "length(c_name)::INT"), "iff": ("IF(c_acctbal > 0, 'pos', 'neg')", "CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END"),
    "nest": ("UPPER(TRIM(LOWER(c_name)))", "upper(trim(lower(c_name)))"), "gr": ("GREATEST(c_nationkey, 7)", "greatest(c_nationkey, 7)"), "lt": ("LEAST(c_nationkey, 7)", "least(c_nationkey, 7)"),
})
_functions("fn_cast", "customer", "c_custkey", {"i": ("CAST(c_acctbal, 'int')", "floor(c_acctbal + 0.5::DOUBLE)::BIGINT"), "s": ("CAST(c_nationkey, 'string')", "c_nationkey::VARCHAR"), "n": ("CAST(c_name, 'number')", "coalesce(try_cast(c_name AS DOUBLE), 0.0::DOUBLE)"), "e": ("CAST(CONCAT('<', c_name, '>'), 'safestr')", "'&lt;' || replace(c_name, '/', '&#x2F;') || '&gt;'")})
_functions("fn_arithmetic", "lineitem", "l_orderkey", {
    "ad": ("ADD(l_quantity, l_tax, 1)", "l_quantity + l_tax + 1"), "su": ("SUB(l_quantity, l_tax)", "l_quantity - l_tax"), "mu": ("MULT(l_quantity, l_discount, 2)", "l_quantity * l_discount * 2"), "di": ("DIV(l_extendedprice, l_quantity)", "l_extendedprice / l_quantity"),
    "mo": ("MOD(l_linenumber, 3)", "l_linenumber % 3"), "pi": ("PI()", "pi()"), "hy": ("HYPOT(l_quantity, l_linenumber)", "sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)"),
}, 7)
_functions("fn_math", "lineitem", "l_orderkey", {
    "ab": ("ABS(SUB(0, l_quantity))", "l_quantity"), "ce": ("CEIL(l_extendedprice)", "ceil(l_extendedprice)"), "fl": ("FLOOR(l_extendedprice)", "floor(l_extendedprice)"), "ex": ("EXP(l_discount)", "exp(l_discount)"), "lo": ("LOG(l_quantity)", "ln(l_quantity)"), "l10": ("LOG10(l_quantity)", "log10(l_quantity)"), "l2": ("LOG2(l_quantity)", "log2(l_quantity)"),
    "sq": ("SQRT(l_quantity)", "sqrt(l_quantity)"), "cb": ("CBRT(l_quantity)", "cbrt(l_quantity)"), "po": ("POW(l_discount, 2)", "pow(l_discount, 2)"), "si": ("SIGN(SUB(l_quantity, 25))", "sign(l_quantity - 25)"), "sn": ("SIN(l_quantity)", "sin(l_quantity)"), "co": ("COS(l_quantity)", "cos(l_quantity)"), "ta": ("TAN(l_discount)", "tan(l_discount)"),
    "ac": ("ACOS(l_discount)", "acos(l_discount)"), "asn": ("ASIN(l_discount)", "asin(l_discount)"), "atn": ("ATAN(l_quantity)", "atan(l_quantity)"), "at2": ("ATAN2(l_tax, l_quantity)", "atan2(l_tax, l_quantity)"), "snh": ("SINH(l_discount)", "sinh(l_discount)"), "csh": ("COSH(l_discount)", "cosh(l_discount)"), "tnh": ("TANH(l_discount)", "tanh(l_discount)"),
    "ash": ("ASINH(l_discount)", "asinh(l_discount)"), "ach": ("ACOSH(ADD(l_discount, 1))", "acosh(l_discount + 1)"), "ath": ("ATANH(l_discount)", "atanh(l_discount)"), "em": ("EXPM1(l_discount)", "exp(l_discount) - 1"), "lp": ("LOG1P(l_discount)", "ln(1 + l_discount)"), "tru": ("TRUNC(SUB(l_quantity, 25.5))", "trunc(l_quantity - 25.5::DOUBLE)"), "rnd": ("ROUND(SUB(l_quantity, 25.5))", "floor(l_quantity - 25.5::DOUBLE + 0.5::DOUBLE)"),
    "clz": ("CLZ32(l_quantity)", "32 - length(bin(l_quantity::BIGINT))"), "imu": ("IMUL(l_quantity, 3)", "l_quantity * 3"), "fr": ("FROUND(l_discount)", "l_discount::FLOAT::DOUBLE"),
}, 5)

_functions("fn_format_number", "lineitem", "l_orderkey", {"f": ("FORMAT_NUMBER(l_extendedprice, 1)", "format('{:,.1f}', l_extendedprice)"), "z": ("FORMAT_NUMBER(MULT(l_quantity, 1000), 0)", "format('{:,.0f}', l_quantity * 1000)")})
_functions("fn_truncate", "lineitem", "l_orderkey", {"a": ("TRUNCATE(l_extendedprice, 1)", "round(l_extendedprice, 1)"), "b": ("TRUNCATE(l_quantity, 0)", "round(l_quantity, 0)")}, 4)
_functions("fn_constants", "nation", "n_nationkey", {"e": ("E()", "exp(1)"), "ln2": ("LN2()", "ln(2)"), "ln10": ("LN10()", "ln(10)"), "l2e": ("LOG2E()", "1 / ln(2)"), "l10e": ("LOG10E()", "1 / ln(10)"), "s12": ("SQRT1_2()", "sqrt(0.5)"), "s2": ("SQRT2()", "sqrt(2)")}, 9)
scalars.register("DISCOUNTED", lambda price, by: price * (1 - by))
aggregates.register("SPREAD", lambda c: F.max(c) - F.min(c))
_functions("udf", "lineitem", "l_orderkey", {"p": ("DISCOUNTED(l_extendedprice, l_discount)", "l_extendedprice * (1 - l_discount)")}, 5)
add("udaf", lambda db: db.query("lineitem").select(["l_returnflag", "SPREAD(l_quantity) AS s"]).group_by(["l_returnflag"]), "SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS s FROM lineitem GROUP BY 1")

# ---- aggregation
_seg = "c_mktsegment"
add("group_aggregates", lambda db: db.query(_nullable(db)).select([_seg, "COUNT(*) AS n", "COUNT(v) AS nv", "MAX(v) AS mx", "MIN(v) AS mn", "SUM(v) AS su", "AVG(v) AS av"]).group_by([f"{_seg} ASC"]),
    f"SELECT c_mktsegment, count(*) AS n, count(v) FILTER (v <> 0) AS nv, max(coalesce(v, 0)) AS mx, min(coalesce(v, 0)) AS mn, sum(coalesce(v, 0))::DOUBLE AS su, sum(coalesce(v, 0))::DOUBLE / count(*) AS av FROM {_customers} GROUP BY 1")
add("group_by_function", lambda db: db.query("customer").select([f"LOWER({_seg}) AS s", "COUNT(*) AS n"]).group_by([f"LOWER({_seg}) ASC"]), "SELECT lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY 1")
add("global_aggregate", lambda db: db.query("customer").select(["COUNT(*) AS n", "MAX(c_acctbal) AS mx", "MIN(c_acctbal) AS mn"]).where(["c_custkey", ">", 10]), "SELECT count(*) AS n, max(c_acctbal) AS mx, min(c_acctbal) AS mn FROM customer WHERE c_custkey > 10")
add("global_aggregate_empty", lambda db: db.query("customer").select(["COUNT(*) AS n", "SUM(c_acctbal) AS su", "AVG(c_acctbal) AS av"]).where(["c_custkey", "<", 0]), "SELECT 0::BIGINT AS n, 0.0::DOUBLE AS su, 0.0::DOUBLE AS av")
add("group_first_row", lambda db: db.query("customer").select(["c_custkey", "c_name", "c_nationkey"]).group_by(["c_nationkey ASC"]), "SELECT min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name, c_nationkey FROM customer GROUP BY c_nationkey")
add("bare_column_max", lambda db: db.query("customer").select([_seg, "MAX(c_acctbal) AS top", "c_name AS who"]).group_by([_seg]), "SELECT c_mktsegment, max(c_acctbal) AS top, arg_max(c_name, c_acctbal) AS who FROM customer GROUP BY 1")
add("bare_column_count", lambda db: db.query("customer").select([_seg, "COUNT(*) AS n", "c_name AS who"]).group_by([_seg]), "SELECT c_mktsegment, count(*) AS n, arg_min(c_name, c_custkey) AS who FROM customer GROUP BY 1")
add("having_literal", lambda db: db.query("orders").select(["o_custkey", "COUNT(*)"]).group_by(["o_custkey"]).having(["COUNT(*)", ">", 15]), "SELECT o_custkey, count(*) AS \"COUNT(*)\" FROM orders GROUP BY 1 HAVING count(*) > 15")
add("aggregate_of_path", lambda db: db.query(_nullable(db)).select([_seg, "AVG(arr.length) AS av"]).group_by([_seg]), f"SELECT c_mktsegment, sum(coalesce(len(arr), 0))::DOUBLE / count(*) AS av FROM {_customers} GROUP BY 1")
add("group_json_path", lambda db: db.query("events").select(["props.k AS k", "COUNT(*) AS n"]).group_by(["props.k"]), "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")

# ---- sort, limit, distinct, sets
add("order_limit_offset", lambda db: db.query("customer").select(["c_custkey", "c_acctbal"]).order_by(["c_acctbal DESC", "c_custkey ASC"]).offset(5).limit(20), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
add("order_by_function", lambda db: numbered(db.query("customer").select(["c_custkey"]).order_by(["UPPER(c_mktsegment) ASC", "c_custkey DESC"]).df(), "place"), "SELECT c_custkey, row_number() OVER (ORDER BY upper(c_mktsegment), c_custkey DESC) AS place FROM customer")
add("order_nulls", lambda db: numbered(db.query(_nullable(db)).select(["c_custkey", "v"]).order_by({"v": "desc", "c_custkey": "asc"}).df(), "place"), f"SELECT c_custkey, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, c_custkey) AS place FROM {_customers}")
add("offset_only", lambda db: db.query("nation").order_by(["n_nationkey ASC"]).offset(20), "SELECT * FROM nation ORDER BY n_nationkey OFFSET 20")
add("distinct_columns", lambda db: db.query("customer").distinct(["c_nationkey", _seg]), "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
add("distinct_with_select", lambda db: db.query("customer").select(["c_custkey"]).distinct(["c_nationkey"]), "SELECT min(c_custkey) AS c_custkey, c_nationkey FROM customer GROUP BY c_nationkey")
add("union_distinct", lambda db: db.query("x").union([db.query("customer").select(["c_nationkey AS k"]), db.query("supplier").select(["s_nationkey"])]), "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("union_all", lambda db: db.query("x").union([db.query("customer").select(["c_nationkey AS k"]), db.query("supplier").select(["s_nationkey"])], True).where(["k", "<", 9]), "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) WHERE k < 9")
add("union_clauses", lambda db: db.query("x").union([db.query("customer").select(["c_nationkey AS k", "c_acctbal AS b"]), db.query("supplier").select(["s_nationkey", "s_acctbal"])], True).where(["b", ">", 0]).having(["k", ">", 2]).distinct(["k"]).order_by(["k DESC"]).offset(1).limit(9), "SELECT DISTINCT k FROM (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) WHERE b > 0 AND k > 2 ORDER BY k DESC LIMIT 9 OFFSET 1")
add("group_order", lambda db: numbered(db.query("orders").select(["o_custkey", "COUNT(*) AS n"]).group_by(["o_custkey DESC"]).df(), "place"), "SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY o_custkey DESC) AS place FROM orders GROUP BY 1")

# ---- joins
_on = ["customer.c_nationkey", "=", "nation.n_nationkey"]


# every ninth supplier's nation is null, so that there are rows without a match
def _join(name: str, kind: str, sql: str) -> None:
    def build(db: Database) -> Query:
        nation = F.when(F.col("s_suppkey") % 9 != 0, F.col("s_nationkey"))
        return db.query(db.rows("supplier").withColumn("s_nationkey", nation), "s").join({"type": kind, "with": {"table": "nation", "as": "n"}, "on": ["s.s_nationkey", "=", "n.n_nationkey"]}).select(["s.s_suppkey AS k", "s.s_name AS a", "n.n_name AS b"])

    add(f"join_{name}", build, f"SELECT s_suppkey AS k, s_name AS a, n_name AS b FROM (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 9 <> 0 THEN s_nationkey END AS k FROM supplier) {sql} JOIN nation ON k = n_nationkey")


for _name, _kind, _sql in (("inner", "inner", ""), ("left", "left", "LEFT"), ("right", "right", "RIGHT"), ("full", "outer", "FULL")):
    _join(_name, _kind, _sql)
# null keys on both sides meet nothing
add("join_null_keys", lambda db: db.query(_nullable(db), "c").join({"type": "outer", "with": {"table": db.rows("nation").withColumn("w", F.nullif(F.col("n_nationkey") % 5, F.lit(0))), "as": "n"}, "on": ["c.v", "=", "n.w"]}).select(["c.c_custkey AS k", "n.n_nationkey AS n"]), f"SELECT c_custkey AS k, n_nationkey AS n FROM {_customers} c FULL JOIN (SELECT *, nullif(n_nationkey % 5, 0) AS w FROM nation) n ON c.v = n.w")
add("join_cross", lambda db: db.query("region").join({"type": "cross", "with": {"table": "nation"}}).select(["region.r_name AS a", "nation.n_name AS b"]), "SELECT r_name AS a, n_name AS b FROM region CROSS JOIN nation")
add("join_flat_names", lambda db: db.query("nation").join({"type": "inner", "with": {"table": "region"}, "on": ["nation.n_regionkey", "=", "region.r_regionkey"]}), "SELECT n_nationkey AS \"nation.n_nationkey\", n_name AS \"nation.n_name\", n_regionkey AS \"nation.n_regionkey\", r_regionkey AS \"region.r_regionkey\", r_name AS \"region.r_name\" FROM nation JOIN region ON n_regionkey = r_regionkey")
add("join_theta", lambda db: db.query("supplier").join({"type": "inner", "with": {"table": "nation"}, "on": [["supplier.s_nationkey", "<", "nation.n_nationkey"], "AND", ["nation.n_regionkey", "=", "supplier.s_nationkey"]]}).select(["supplier.s_suppkey AS a", "nation.n_nationkey AS b"]), "SELECT s_suppkey AS a, n_nationkey AS b FROM supplier JOIN nation ON s_nationkey < n_nationkey AND n_regionkey = s_nationkey")
add("join_function", lambda db: db.query("region").join({"type": "inner", "with": {"table": "nation"}, "on": lambda df: F.col("`region.r_regionkey`") + 1 == F.col("`nation.n_regionkey`")}).select(["region.r_name AS a", "nation.n_name AS b"]), "SELECT r_name AS a, n_name AS b FROM region JOIN nation ON r_regionkey + 1 = n_regionkey")
add("join_multi", lambda db: db.query("customer").where([["c_acctbal", ">", 5000], "AND", ["region.r_name", "LIKE", "a%"]]).join([{"type": "inner", "with": {"table": "nation"}, "on": _on}, {"type": "inner", "with": {"table": "region"}, "on": ["nation.n_regionkey", "=", "region.r_regionkey"]}]).select(["customer.c_custkey AS k", "region.r_name AS r"]), "SELECT c_custkey AS k, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000 AND r_name ILIKE 'a%'")
add("join_self", lambda db: db.query("nation", "a").join({"type": "inner", "with": {"table": "nation", "as": "b"}, "on": [["a.n_regionkey", "=", "b.n_regionkey"], "AND", ["a.n_nationkey", "<", "b.n_nationkey"]]}).select(["a.n_name AS x", "b.n_name AS y"]), "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
add("join_rows", lambda db: db.query("region").join({"type": "inner", "with": {"table": [{"id": 1, "tag": "x"}], "as": "t"}, "on": ["region.r_regionkey", "=", "t.id"]}).select(["region.r_name AS r", "t.tag AS g"]), "SELECT r_name AS r, 'x' AS g FROM region WHERE r_regionkey = 1")
for _name, _kind, _sql in (("semi", "semi", ""), ("anti", "anti", "NOT ")):
    add(f"join_{_name}", lambda db, k=_kind: db.query("customer").join({"type": k, "with": {"table": "orders"}, "on": ["customer.c_custkey", "=", "orders.o_custkey"]}).select(["customer.c_custkey AS k"]), f"SELECT c_custkey AS k FROM customer WHERE {_sql}EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

# ---- graphs, flattened so that the results can be compared
_orders = {"key": "kids", "with": {"table": "orders"}, "on": ["customer.c_custkey", "=", "orders.o_custkey"]}


def _graph(name: str, spec: dict, flat: Callable[[DataFrame], DataFrame], sql: str) -> None:
    add(f"graph_{name}", lambda db: flat(db.query("customer").graph(_orders | spec).df()), sql)


_c = "customer"
_keys = lambda kids: F.array_join(F.transform(kids, lambda k: k["o_orderkey"].cast("string")), ",")
_graph("basic", {}, lambda df: df.select("c_custkey", _keys("kids").alias("keys")), f"SELECT c_custkey, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS keys FROM {_c} LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_graph("select", {"select": ["o_orderkey", "o_orderstatus AS st"], "orderBy": ["o_orderkey DESC"], "limit": 2, "offset": 1}, lambda df: df.select("c_custkey", F.explode("kids").alias("k")).select("c_custkey", "k.o_orderkey", "k.st"),
       f"SELECT c_custkey, o_orderkey, o_orderstatus AS st FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey DESC) AS n FROM {_c} JOIN orders ON o_custkey = c_custkey) WHERE n BETWEEN 2 AND 3")
_graph("single", {"single": True, "orderBy": ["o_orderkey ASC"]}, lambda df: df.select("c_custkey", F.col("kids.o_orderkey").alias("last")), f"SELECT c_custkey, max(o_orderkey) AS last FROM {_c} LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_graph("aggregate", {"select": ["o_orderstatus AS st", "COUNT(*) AS n"], "groupBy": ["o_orderstatus"]}, lambda df: df.select("c_custkey", F.explode("kids").alias("k")).select("c_custkey", "k.st", "k.n"), f"SELECT c_custkey, o_orderstatus AS st, count(*) AS n FROM {_c} JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
_graph("nested", {"graph": [{"key": "lines", "with": {"table": "lineitem"}, "on": ["orders.o_orderkey", "=", "lineitem.l_orderkey"]}]}, lambda df: df.select("c_custkey", F.explode("kids").alias("k")).select("c_custkey", "k.o_orderkey", F.size("k.lines").cast("long").alias("n")), f"SELECT c_custkey, o_orderkey, count(l_orderkey) AS n FROM {_c} JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")


add("graph_several", lambda db: db.query("nation").graph([{"key": "who", "with": {"table": "customer"}, "on": ["nation.n_nationkey", "=", "customer.c_nationkey"], "select": ["COUNT(*) AS n"]}, {"key": "from", "with": {"table": "region"}, "on": ["nation.n_regionkey", "=", "region.r_regionkey"], "single": True}, {"key": "sold", "with": {"table": "supplier"}, "on": ["supplier.s_nationkey", "=", "nation.n_nationkey"]}]).df().select("n_nationkey", F.col("who")[0]["n"].alias("n"), F.col("from.r_name").alias("r"), F.size("sold").cast("long").alias("s")),
    "SELECT n_nationkey, (SELECT nullif(count(*), 0) FROM customer WHERE c_nationkey = n_nationkey) AS n, r_name AS r, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation JOIN region ON n_regionkey = r_regionkey")
add("graph_non_equi", lambda db: db.query("region").graph({"key": "after", "with": {"table": "nation"}, "on": [["region.r_regionkey", "<", "nation.n_regionkey"], "AND", ["nation.n_nationkey", "<=", "region.r_regionkey"]]}).df().select("r_regionkey", F.array_join(F.transform("after", lambda k: k["n_nationkey"].cast("string")), ",").alias("keys")),
    "SELECT r_regionkey, coalesce(string_agg(n_nationkey, ',' ORDER BY n_nationkey), '') AS keys FROM region LEFT JOIN nation ON r_regionkey < n_regionkey AND n_nationkey <= r_regionkey GROUP BY 1")
add("graph_null_keys", lambda db: db.query(_nullable(db), "c").graph({"key": "kids", "with": {"table": db.rows("nation").withColumn("w", F.nullif(F.col("n_nationkey") % 5, F.lit(0))), "as": "n"}, "on": ["c.v", "=", "n.w"]}).df().select("c_custkey", F.size("kids").cast("long").alias("n")), f"SELECT c_custkey, count(n_nationkey) AS n FROM {_customers} LEFT JOIN nation ON v = nullif(n_nationkey % 5, 0) GROUP BY 1")


# ---- mutations, as the table that they leave
def _left(name: str, table: str, change: Callable[[Database], object], sql: str) -> None:
    def build(db: Database) -> DataFrame:
        change(db)
        return db.rows(table)

    add(name, build, sql)


def _upserted(db: Database) -> None:
    o = db.rows("orders")
    patch = o.where("o_orderstatus = 'O'").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "renamed").alias("o_orderpriority"), F.lit(1.5).alias("o_totalprice"))
    db.upsert("orders", patch.unionAll(db.spark.createDataFrame([(-1, "new", 2.5)], "o_orderkey long, o_orderpriority string, o_totalprice double")))


def _ordered(db: Database) -> None:
    db.upsert("nation", [{"n_nationkey": 1, "n_name": "first", "n_regionkey": 7}, {"n_nationkey": 1, "n_name": "last"}, {"n_nationkey": 2, "n_regionkey": None}, {"n_nationkey": 99, "n_name": "new"}])


def _many(db: Database) -> None:  # more changes than a plan holds
    for i in range(9):
        db.update("orders", {"o_totalprice": F.col("o_totalprice") + i}, ["o_orderstatus", "=", "F"])


def _immutable(db: Database) -> None:
    n = db.tables["nation"]
    n.model = {"n_nationkey:int": {"pk": True}, "n_name:string": {"immutable": True}, "n_regionkey:int": {}}
    db.update("nation", {"n_name": "x", "n_regionkey": 9}, ["n_regionkey", "=", 2])
    db.update_immutable("nation", {"n_name": "y"}, ["n_regionkey", "=", 0])


def _cascaded(db: Database) -> None:
    db.tables["nation"].indexes = {"n_regionkey:int": {"foreignKey": {"target": "region.r_regionkey", "onDelete": "CASCADE"}}}
    db.delete("region", ["r_regionkey", "IN", [0, 3]])


def _dropped(db: Database) -> None:
    db.tables["nation"].indexes = {"n_regionkey:int": {"foreignKey": {"target": "region.r_regionkey", "onDelete": "SET_NULL"}}}
    db.drop("region")


def _living(db: Database) -> None:
    o = db.rows("orders")
    db.upsert("orders", o.where("o_orderstatus = 'F'"), ttl=-1)
    db.upsert("orders", o.where("o_orderstatus = 'O'"), ttl=-1, ttl_columns=["o_orderpriority"])
    db.upsert("orders", o.where("o_orderstatus = 'P'"), ttl=86_400)


def _conformed(db: Database) -> None:
    db.tables["customer"].model = {"c_custkey:int": {"pk": True}, "c_name:string": {}, "c_acctbal:int": {"min": -10_000, "max": 10_000}, "grade:string": {"default": "none"}}
    db.conform_rows("customer", lambda df: df.withColumn("c_name", F.lower("c_name")))


_left("upsert", "orders", _upserted, "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority WHEN o_orderkey % 2 = 0 THEN 'renamed' END AS o_orderpriority FROM orders UNION ALL SELECT -1, NULL, NULL, 2.5, NULL, 'new'")
_left("upsert_in_order", "nation", _ordered, "SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN 'last' ELSE n_name END AS n_name, CASE n_nationkey WHEN 1 THEN 7 WHEN 2 THEN NULL ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 99, 'new', NULL")
_left("update_where", "orders", lambda db: db.update("orders", {"o_orderpriority": "x"}, ["o_orderstatus", "=", "P"]), "SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE o_orderpriority END AS o_orderpriority) FROM orders")
_left("update_often", "orders", _many, "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 0 + 1 + 2 + 3 + 4 + 5 + 6 + 7 + 8 ELSE o_totalprice END AS o_totalprice) FROM orders")
_left("update_immutable", "nation", _immutable, "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'y' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
_left("delete_where", "orders", lambda db: db.delete("orders", [["o_orderstatus", "=", "F"], "AND", ["o_totalprice", ">", 1000]]), "SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)")
_left("delete_cascade", "nation", _cascaded, "SELECT * FROM nation WHERE n_regionkey NOT IN (0, 3)")
_left("drop_sets_null", "nation", _dropped, "SELECT * REPLACE (NULL::INT AS n_regionkey) FROM nation")
_left("time_to_live", "orders", _living, "SELECT * REPLACE (CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END AS o_orderpriority) FROM orders WHERE o_orderstatus <> 'F'")
_left("conform", "customer", _conformed, "SELECT c_custkey, lower(c_name) AS c_name, floor(c_acctbal + 0.5::DOUBLE)::BIGINT AS c_acctbal, 'none' AS grade FROM customer")
add("delete_returns", lambda db: db.delete("orders", ["o_orderstatus", "=", "F"]), "SELECT * FROM orders WHERE o_orderstatus = 'F'")
add("copy_to", lambda db: [db.query("orders").select(["o_custkey AS c_custkey", "COUNT(*) AS n"]).group_by(["o_custkey"]).copy_to("customer"), db.rows("customer").select("c_custkey", "c_name", "n")][1], "SELECT c_custkey, c_name, n FROM customer FULL JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) USING (c_custkey)")
add("describe", lambda db: db.describe("nation"), "SELECT * FROM (VALUES ('n_nationkey', 'int', true), ('n_name', 'string', false), ('n_regionkey', 'int', false)) t(\"column\", type, pk)")


def _indexes(db: Database) -> DataFrame:
    db.tables["nation"].indexes = {"n_name:string": {"unique": True}, "n_regionkey:int": {}}
    return db.describe_indexes("nation")


add("describe_indexes", _indexes, "SELECT * FROM (VALUES ('n_name', 'string', true), ('n_regionkey', 'int', false)) t(\"index\", type, \"unique\")")


def _through_csv(db: Database) -> DataFrame:
    """Customers with a boolean and a nested column, out as CSV and back."""
    path = fresh_path(db.spark)
    rows = db.rows("customer").select(F.col("c_custkey").alias("id"), "c_name", (F.col("c_acctbal") > 0).alias("good"), F.struct(F.col("c_nationkey").alias("nation"), F.array("c_mktsegment").alias("in")).alias("more"))
    lines = csv_lines(rows, header=False).select("line")
    head = ",".join(f'"{c}"' for c in rows.columns)
    # each file has its own header, as each is read by itself
    lines.mapInPandas(lambda parts: _headed(parts, head), "line string").write.text(path)
    back = read_csv(db.spark, path)
    return back.select(F.col("id").cast("long").alias("id"), "c_name", "good", F.col("more.nation").cast("int").alias("nation"), F.col("more.in")[0].alias("segment"))


def _headed(parts, head: str):
    import pandas as pd

    for i, x in enumerate(parts):
        yield pd.concat([pd.DataFrame({"line": [head]}), x]) if i == 0 else x


def _through_dump(db: Database) -> DataFrame:
    path = fresh_path(db.spark)
    dump({"orders": db.rows("orders")}, path)
    return load_dump(db.spark, ["orders"], path)["orders"]


def _through_json(db: Database) -> DataFrame:
    path = fresh_path(db.spark)
    db.rows("customer").write.json(path)
    db.create_table("back", {"c_custkey:int": {"pk": True}, "c_name:string": {}, "c_acctbal:float": {}})
    db.upsert("back", read_json(db.spark, path))
    return db.rows("back")


add("import_csv", _through_csv, "SELECT c_custkey AS id, c_name, c_acctbal > 0 AS good, c_nationkey AS nation, c_mktsegment AS segment FROM customer")
add("import_json", _through_json, "SELECT c_custkey, c_name, c_acctbal FROM customer")
add("raw_dump", _through_dump, "SELECT * FROM orders")
add("clone", lambda db: db.clone("*", fresh_path(db.spark)).rows("lineitem"), "SELECT * FROM lineitem")

# ---- places: derived from customer keys
_lat, _lon = "(c_custkey * 7 % 180 - 90)", "(c_custkey * 13 % 360 - 180)"


def _places(db: Database) -> DataFrame:
    return db.rows("customer").select("c_custkey", F.struct((F.col("c_custkey") * 7 % 180 - 90).cast("double").alias("lat"), (F.col("c_custkey") * 13 % 360 - 180).cast("double").alias("lon")).alias("loc"))


_crow = f"(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)))"
_havers = f"SELECT c_custkey, pow(sin(radians(40 - {_lat}) / 2), 2) + cos(radians({_lat})) * cos(radians(40.0::DOUBLE)) * pow(sin(radians(175 - {_lon}) / 2), 2) AS h FROM customer"
add("crow_distance", lambda db: db.query(_places(db)).select(["c_custkey", "CROW(loc, 40, 175) AS km"]).df().withColumn("km", F.round("km", 3)), f"SELECT c_custkey, round({_crow}, 3) AS km FROM ({_havers})")
add("crow_where", lambda db: db.query(_places(db)).select(["c_custkey"]).where(["CROW(loc, 40, 175)", "<", 2500]), f"SELECT c_custkey FROM ({_havers}) WHERE {_crow} < 2500")
add("crow_box", lambda db: _places(db).where(within(F.col("loc.lat"), F.col("loc.lon"), 40.0, 175.0, 2500.0)).select("c_custkey"), f"SELECT c_custkey FROM ({_havers}) WHERE {_crow} <= 2500")

# ---- SQL text
for _name, _text, _sql in (
    ("top", "SELECT TOP 5 n_nationkey FROM nation ORDER BY n_nationkey", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5"),
    ("glob", "SELECT n_name FROM nation WHERE n_name GLOB 'N*1?'", "SELECT n_name FROM nation WHERE n_name GLOB 'N*1?'"),
    ("cte", "WITH a AS (SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1) SELECT r, n FROM a WHERE n > 1", None),
    ("window", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS total FROM orders", None),
    ("grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    ("rollup", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    ("cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    ("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    ("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    ("count_distinct", "SELECT count(DISTINCT o_custkey) AS n FROM orders", None),
    ("case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders", None),
    ("exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    ("natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier)", None),
    ("using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) USING (k)", None),
    ("apply", "SELECT r_name, n FROM region CROSS APPLY (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey)", "SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1"),
    ("pivot", "SELECT * FROM (SELECT o_orderpriority AS p, o_orderstatus AS s FROM orders) PIVOT (count(*) FOR s IN ('F' AS f, 'O' AS o))", "SELECT o_orderpriority AS p, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o FROM orders GROUP BY 1"),
    ("unpivot", "SELECT n, what, v FROM (SELECT n_nationkey AS n, n_regionkey AS a, n_nationkey AS b FROM nation) UNPIVOT (v FOR what IN (a, b))", "SELECT n_nationkey AS n, 'a' AS what, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'b', n_nationkey FROM nation"),
    ("top_percent", "SELECT TOP 10 PERCENT o_orderkey FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey DESC) <= ceil((SELECT count(*) FROM orders) / 10.0)"),
    ("top_nested", "SELECT r_name, n.n_name FROM region JOIN (SELECT TOP 7 n_name, n_regionkey FROM nation ORDER BY n_nationkey) n ON n_regionkey = r_regionkey", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 7"),
    ("corresponding", "SELECT n_regionkey AS r, n_nationkey AS k FROM nation UNION CORRESPONDING SELECT 'x' AS other, s_nationkey AS k FROM supplier", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier"),
    ("fetch", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 3 ROWS FETCH NEXT 4 ROWS ONLY", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 4 OFFSET 3"),
    ("nocase", "SELECT n_nationkey, row_number() OVER (ORDER BY n_name COLLATE NOCASE, n_nationkey) AS place FROM nation", "SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS place FROM nation"),
    ("quoted_words", "SELECT 'select top 3 a glob ''b'' c' AS text, n_nationkey FROM nation -- top 1", "SELECT 'select top 3 a glob ''b'' c' AS text, n_nationkey FROM nation"),
    ("json_arrow", "SELECT event_id, props->k AS k FROM events WHERE props->'k' LIKE '1%'", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') LIKE '1%'"),
    ("first_last", "SELECT o_custkey, first(o_orderstatus) IS NOT NULL AS f, last(o_orderstatus) IS NOT NULL AS l FROM orders GROUP BY o_custkey", "SELECT o_custkey, true AS f, true AS l FROM orders GROUP BY 1"),
    ("unique", "SELECT UNIQUE o_orderstatus AS s FROM orders", "SELECT DISTINCT o_orderstatus AS s FROM orders"),
):
    add(f"sql_{_name}", lambda db, t=_text: db.sql(t), _sql or _text)
add("sql_parameters", lambda db: db.sql("SELECT n_name FROM nation WHERE n_regionkey = $r AND n_nationkey > :least", {"r": 1, "least": 2}), "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2")
for _name, _table, _text, _sql in (
    ("insert", "nation", "INSERT INTO nation (n_nationkey, n_name) VALUES (0, 'it''s'), (77, 'new')", "SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'it''s' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 77, 'new', NULL"),
    ("insert_select", "customer", "INSERT INTO customer (c_custkey, c_name) SELECT -1 - s_suppkey, s_name FROM supplier", "SELECT * FROM customer UNION ALL SELECT -1 - s_suppkey, s_name, NULL, NULL, NULL FROM supplier"),
    ("update", "orders", "UPDATE orders SET o_totalprice = o_totalprice * 2, o_orderpriority = concat('where ', o_orderpriority) WHERE o_orderstatus = 'F' AND o_orderkey > 10", "SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' AND o_orderkey > 10 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'F' AND o_orderkey > 10 THEN 'where ' || o_orderpriority ELSE o_orderpriority END AS o_orderpriority) FROM orders"),
    ("update_select", "nation", "UPDATE nation SET n_name = 'top' WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)", "SELECT * REPLACE (CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000) THEN 'top' ELSE n_name END AS n_name) FROM nation"),
    ("delete", "orders", "DELETE FROM orders WHERE o_orderstatus = 'F' OR o_custkey IS NULL", "SELECT * FROM orders WHERE o_orderstatus <> 'F'"),
    ("delete_select", "customer", "DELETE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    ("merge", "customer", "MERGE INTO customer AS c USING (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT -1, 5) AS o ON c.c_custkey = o.k WHEN MATCHED AND o.n > 15 THEN DELETE WHEN MATCHED THEN UPDATE SET c_acctbal = o.n, c_name = concat(c.c_name, '!') WHEN NOT MATCHED THEN INSERT (c_custkey, c_acctbal) VALUES (o.k, o.n)",
     "SELECT * EXCLUDE (n) REPLACE (CASE WHEN n IS NULL THEN c_name ELSE c_name || '!' END AS c_name, coalesce(n, c_acctbal)::DOUBLE AS c_acctbal) FROM (SELECT c.*, n FROM customer c LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey) s WHERE coalesce(n, 0) <= 15 UNION ALL BY NAME SELECT -1 AS c_custkey, 5 AS c_acctbal"),
    ("create_as", "rich", "CREATE TABLE rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0"),
    ("truncate", "region", "TRUNCATE TABLE region", "SELECT * FROM region WHERE false"),
):
    _left(f"sql_{_name}", _table, lambda db, t=_text: db.sql(t), _sql)

# ---- events
add("tumbling_window", lambda db: windowed(db.rows("events"), "1 day").select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n", F.round("total", 2).alias("total")), "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
add("session_window", lambda db: sessions(db.rows("events"), "6 hours").select("user_id", "n"),
    "WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), b AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, count(*) AS n FROM b GROUP BY user_id, s")


def _documents(db: Database) -> DataFrame:
    return db.spark.read.parquet(f"{db.dir}/documents.parquet")


# words as they are, so that SQL can follow: their places, and how far the nearest two stand apart
_raw_words = r"""(SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[-_\[\](){}\r\n\t]', ' ', 'g'), '[^a-z0-9\s.]', '', 'g'), '(^|[^0-9])\.+', '\1', 'g'), '\s+', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM documents)"""
_phrase = f"""SELECT doc_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN list_min(flatten([[abs(q - p - 1) for q in b] for p in a])) ELSE 2 END::INT AS score
FROM (SELECT doc_id, [i for i in range(1, len(w) + 1) if w[i] = 'the'] AS a, [i for i in range(1, len(w) + 1) if w[i] = 'hation'] AS b FROM {_raw_words}) WHERE len(a) + len(b) > 0"""
add("search_words", lambda db: search(_documents(db), "doc_id", "text", ["the hation"], mode="words", most=2).withColumnRenamed("id", "doc_id"), f"SELECT * FROM ({_phrase}) WHERE score <= 2")
add("search_function", lambda db: db.query(_documents(db), "d").select(["doc_id"]).where([["SEARCH(text, 'the hation', 'tokenizer:words')", "=", 0], "OR", ["SEARCH(text, 'thingering', 'tokenizer:words')", "=", 0]]), f"SELECT doc_id FROM ({_phrase}) WHERE score = 0 UNION SELECT doc_id FROM {_raw_words} WHERE list_contains(w, 'thingering')")


def _indexed(db: Database) -> DataFrame:
    """A stored index of documents, of which some are then deleted and some written anew."""
    db.attach("documents", _documents(db))
    db.tables["documents"].indexes = {"text:string": {"search": {"tokenizer": "words"}}}
    db.rebuild_search("documents")
    db.delete("documents", ["lang", "=", "en"])
    db.upsert("documents", db.rows("documents").where("lang = 'de'").select("doc_id", F.lit("now the hation").alias("text")))
    return db.tables["documents"].search.search(["the hation"], "<=", 1).withColumnRenamed("id", "doc_id")


add("search_index", _indexed, f"SELECT doc_id, score FROM ({_phrase}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE lang NOT IN ('en', 'de') AND score <= 1 UNION ALL SELECT doc_id, 0 FROM documents WHERE lang = 'de'")
add("search_phrase", lambda db: search(_documents(db), "doc_id", "text", ["the hation", "thingering"], mode="english-stem", most=2).withColumnRenamed("id", "doc_id"))
