"""URL rules by a sort-merge range join, in DataFrame functions alone.

A host's labels in reverse order, each followed by a dot, make a key under which a host and all its subdomains are one
interval: net.example. covers net.example.a. and nothing else. Intervals of such prefixes are nested or apart. Rule starts and URLs are
sorted by key and swept once; at a URL, the rules that may be active are those on the stack of the last rule start before
it, its chain of enclosing rules. Of that stack those that hold the host and begin the path fit, and the longest wins.

The sweep is dealt by a hash of the URL's row, not by host: every part sweeps all rule starts and its share of the URLs, so a
host with a third of all rows is spread evenly. Rules are a stated list, and each part gets one copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def stacks(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) -> (key, stack): for each distinct rule host the rules on it and on the hosts that enclose it.
    Each key is cut at its dots and joined by equality to the keys of the rules, so nested rules meet without a cross join."""
    rules = rules.dropDuplicates(["host", "path"]).select(reversed_host(F.translate("host", UPPER, LOWER)).alias("key"), "path", "verdict", F.concat("host", "path").alias("rule"))
    labels = F.split(F.col("key"), r"\.")
    keys = rules.select("key").distinct()
    above = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("over"))
    entry = F.struct(F.length("rule").alias("size"), F.col("over").alias("key"), "path", "rule", "verdict")
    return above.join(rules.withColumnRenamed("key", "over"), "over").groupBy("key").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule (null if none fits), verdict (the rule's, else default).

    A null url, or one without ://, has an empty host and path and fits no rule. Repeated rows give repeated results; other
    columns, clashing ones included, are neither read nor given. Of rules with equal host and path one counts."""
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", reversed_host(F.col("host")))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = stacks(rules)
    nothing = starts.schema["stack"].dataType
    rows = rows.select((F.monotonically_increasing_id() % parts).cast("int").alias("part"), "key", F.lit(1).alias("kind"), F.lit(None).cast(nothing).alias("stack"), "page_id", "host", "path")
    starts = starts.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "key", F.lit(0).alias("kind"), "stack", F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    sweep = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = rows.unionAll(starts).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("active", lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))
    best = F.get(fits, F.lit(0))  # stacks are sorted by length, longest first
    return swept.withColumn("_best", best).select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: The same in one SQL query, for rules as in RULES.
ORACLE = """
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT h.page_id, h.host, h.path, rhost || rpath AS rule, rverdict,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC) AS n
      FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM m WHERE n = 1
"""
