"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, scratch, too_many, written


#: A round's tables are written by FILES tasks, or by one for each LINKS_PER_FILE links, if that is more: many tiny files
#: take longer to write than the links.
FILES, LINKS_PER_FILE = 12, 50_000


def _with_least(links: DataFrame, total: int) -> DataFrame:
    """links (u, v), `total` of them, with m, the smallest v of all links of u. Minima are formed before the exchange."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return looked_up(links, least.drop("n"), ["u"], least.where(F.col("n") > too_many(total)).drop("n"), "inner")


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node that each node can reach; nodes without a link, and
    links of a node to itself, are left out.

    Each round hangs every neighbour on the smallest one and is written to the shared folder, so the rounds are about the
    logarithm of the longest path. A node with very many links costs no task more than others."""
    links = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with scratch(links.sparkSession) as kept:
        links, mark = written(links), None
        n = links.count()
        while True:
            files = max(FILES, n // LINKS_PER_FILE)
            both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _with_least(both, 2 * n).withColumn("m", F.least("m", "u")).where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            # small star: every node and its smaller neighbours hang on the smallest of them
            ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            small = written(_with_least(written(large.coalesce(files)), n).select(F.explode(ends).alias("e")).select("e.*").where("u != v").distinct().coalesce(files))
            now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark or not now[0]:
                out = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
                return kept(out.unionAll(small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).coalesce(files))
            links, mark, n = small, now, now[0]
