"""From raw documents to encoded training text, in five stages.

Each stage works on all that the one before kept, and is written as Parquet and read again. The near-duplicate stage takes
shingles of five words and a similarity of 0.8. All stages but the last give the columns of documents; the last gives
the ids and token counts of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontaminate, near_dup, quality, secret_scan
from quernstone.llm.common import table, written
from quernstone.plans.session import ship

TOKENIZER = "byte_bpe_50k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as poor or toxic, go."""
    ship(spark)
    return quality.judged(docs, table(spark, sf_dir, "labels")).where("_judged.kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id."""
    ship(spark)
    return near_dup.without_near_duplicates(docs, k=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ship(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; all documents stay."""
    ship(spark)
    return secret_scan.redacted(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of the text decoded from them."""
    ship(spark)
    out = bpe.encode(docs, TOKENIZER)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", no_benchmark),
    ("secret scans", no_secrets),
    ("BPE encoding and decoding", token_ids),
]
#: The classifier is fitted and the tokenizer is a library's, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
