"""Contiguous shards of nearly equal bytes, from prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, saved, utf8_size


def byte_shards(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Deal documents, in the order of their ids, to shards of nearly equal bytes.

    The size of a row is the bytes of its text in UTF-8 plus one. Rows are range
    partitioned by id; totals of the partitions give each partition the bytes and
    rows before it, a running sum inside the partition does the rest. A row goes
    to the shard that holds the middle of its bytes, so a shard misses its equal
    share by less than one row on either side.

    Returns one row per input row: id, ``size``, ``text_crc32``, ``start`` (bytes
    before it), ``shard`` and ``slot`` (its place in the shard, from 0). Other
    columns, whatever their names, are not read. A null text is empty, a null id
    sorts first; equal ids are ordered by the text's hash, equal rows are
    interchangeable, and any group of equal rows may be split between partitions.
    A row larger than a shard makes its neighbours' shards smaller or empty. An
    empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).alias("id"),
        (utf8_size(F.col(text_column)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(text_column)).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("id").asc_nulls_first(), "tie", "row"]
    # Saved without text, so sampling the ranges does not read the texts again.
    dealt = saved(rows, "sizes").repartitionByRange(partitions(spark), *order)
    dealt = saved(dealt.withColumn("part", F.spark_partition_id()), "ranges")

    # One row per partition; a broadcast of it is bounded by the number of partitions.
    everything = Window.partitionBy()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    totals = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_size").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.join(F.broadcast(totals), "part").select(
        "id",
        "size",
        "text_crc32",
        "total",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("place"),
    )
    placed = placed.withColumn("shard", F.expr(f"CAST(least({shards - 1}L, ((2 * start + size) * {shards}L) div (2 * total)) AS INT)"))
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_column), "size", "text_crc32", "start", "shard", (F.col("place") - F.col("first_place")).alias("slot")
    )
