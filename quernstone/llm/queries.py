"""The operators as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, near_dup, quality, secret_scan, sharding, token_count, url_rules, warc
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def sharded(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "slot", "shard")


def encoded(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), TOKENIZER, digest=True)


def counted(spark: SparkSession, d: str) -> DataFrame:
    return token_count.count_tokens(table(spark, d, "documents"), TOKENIZER)


def leaks(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def near(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, d, "documents"), k=4)


def rated(spark: SparkSession, d: str) -> DataFrame:
    out = quality.judged(table(spark, d, "documents"), table(spark, d, "labels"), carried=["doc_id"])
    return out.select("doc_id", F.round("_judged.quality", 6).alias("quality"), F.round("_judged.toxic", 6).alias("toxic"), F.col("_judged.kept").alias("kept"))


def urls(spark: SparkSession, d: str) -> DataFrame:
    return url_rules.judge(table(spark, d, "pages"))


def secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(table(spark, d, "embeddings"))


def revisits(spark: SparkSession, d: str) -> DataFrame:
    out = warc.resolve(warc.captures_of(table(spark, d, "pages")))
    header = lambda name: F.try_element_at("headers", F.lit(name))
    return out.select("record_id", "canonical_url", "ts", "resolution", "source_id", "status", "payload", header("content-type").alias("content_type"), header("date").alias("date_header"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharded,
    "op2_bpe_round_trip": encoded,
    "op3_token_counts": counted,
    "op4_decontamination": leaks,
    "op5_near_dedup": near,
    "op6_quality": rated,
    "op7_url_rules": urls,
    "op8_secret_scan": secrets,
    "op9_nearest_neighbours": neighbours,
    "op10_warc_revisits": revisits,
}
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": sharding.oracle(),
    "op5_near_dedup": near_dup.ORACLE,
    "op7_url_rules": url_rules.ORACLE,
    "op9_nearest_neighbours": ann.ORACLE,
    "op10_warc_revisits": warc.ORACLE,
}
