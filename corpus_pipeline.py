"""A corpus prepared in stages, each an operator of the text subpackage.

``STAGES`` lists (name, function); each function takes (spark, docs, folder) and
returns a DataFrame, which is written and read again for the next one. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, near_duplicates, quality_rules, secrets
from tidemark.llm.common import documents, saved


def reject_odd(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keys = {"_q1": F.xxhash64("text"), "_q2": F.xxhash64(F.lit(1), F.col("text"))}
    # The verdict depends on text and language only, so rows with both equal share it.
    verdicts = quality_rules.judge(docs.select(F.struct(*[k.alias(n) for n, k in keys.items()], "lang").alias("key"), "text", "lang"), id_column="key")
    # Saved, so that the join may split a text with very many copies.
    rejected = saved(verdicts.where("NOT kept").select("key").distinct(), "rejected")
    marked = docs.withColumn("key", F.struct(*[k.alias(n) for n, k in keys.items()], "lang"))
    return marked.join(rejected, "key", "left_anti").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicates.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), extra=("ids",))


STAGES = [
    ("quality rules", reject_odd),
    ("near copies", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Hashes of texts and encoded ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
