"""Each query against the same in SQL, and the entry module."""

import math
from decimal import Decimal

import duckdb
import pytest

from quernstone.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else v if isinstance(v, bool) else str(v)


def rows(columns, found):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(([plain(r[i]) for i in at] for r in found), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, oracle, name):
    df = QUERIES[name](spark, data)
    want = oracle.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_orders_are_those_of_all_rows(spark, data, oracle):
    got = QUERIES["order_nulls"](spark, data).collect()
    assert len(got) == oracle.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    nulls = [r["v"] is None for r in sorted(got, key=lambda r: r["place"])]
    assert {True, False} == set(nulls) and nulls == sorted(nulls, reverse=True)


@pytest.mark.parametrize(("name", "pushed"), [
    ("scan_point", "EqualTo(c_custkey,42)"), ("scan_range", "GreaterThanOrEqual(o_orderkey,100)"), ("scan_multi_get", "In(p_partkey"), ("where_lt", "LessThan(c_acctbal,1000.0)"), ("where_between", "LessThanOrEqual(c_acctbal,900.0)"), ("where_date", "GreaterThanOrEqual(o_orderdate,1996-01-01"),
    ("flagship", "GreaterThan(c_acctbal,0.0)"), ("where_like_prefix", "StringStartsWith(c_name,CU)"), ("where_left_to_right", "LessThan(c_nationkey,10)"), ("join_multi", "GreaterThan(c_acctbal,5000.0)"),
])
def test_filters_reach_the_scan(spark, data, name, pushed):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert any(pushed in part.partition("ReadSchema")[0] for part in plan.split("PushedFilters:")[1:]), plan


@pytest.mark.parametrize("name", ["join_inner", "join_multi", "graph_nested", "graph_basic", "flagship"])
def test_keys_are_joined_by_plain_equality(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    keys = [line for line in plan.splitlines() if "Join" in line and "_row" not in line]
    assert keys and not any("<=>" in line for line in keys)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
