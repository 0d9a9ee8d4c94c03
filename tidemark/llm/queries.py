"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents
from tidemark.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op5_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.sharding import byte_shards

    out = byte_shards(documents(spark, folder), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_block_mix(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.mixing import mix, taken_words

    out = taken_words(mix(documents(spark, folder)))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


@query
def op10_language_distance(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.quality_rules import judge

    return judge(documents(spark, folder))


@query
def op9_transducer_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.bpe import encode

    return encode(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), extra=())


@query
def op8_bayes_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.near_duplicates import similar_documents

    return similar_documents(documents(spark, folder))


@query
def op3_merged_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.repeated_strings import remove_repeated

    return remove_repeated(documents(spark, folder), with_text=False)


@query
def op6_forest_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.secrets import scan

    return scan(documents(spark, folder), ["doc_id"])


@query
def op1_license_spans(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.licenses import scan_licenses

    return scan_licenses(documents(spark, folder))


@query
def op2_ordinal_grades(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.grades import grade, rating

    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", rating().alias("grade"))
    return grade(documents(spark, folder), labels)


@query
def op4_chroma_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.audio import melody, saved_fingerprints, search

    # There are no recordings among the tables; each vector is played as one.
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    prints = saved_fingerprints(vectors, "vec_id", "embedding", melody)
    return search(prints, prints.where("vec_id % 100 = 0"), "vec_id")


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.spelling import spelling_variants

    return spelling_variants(documents(spark, folder))


@query
def op12_bit_sliced_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.simhash import near_copies

    return near_copies(documents(spark, folder))


@query
def op13_qdwh_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from tidemark.llm.whitening import whitened

    return whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))
