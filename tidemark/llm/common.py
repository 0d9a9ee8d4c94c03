"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    Cuts the lineage: a lost executor loses nothing, and values that depend on
    how rows were dealt (row numbers, partition numbers) are fixed from then on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8_size(text: Column) -> Column:
    """Bytes of a text in UTF-8, null counting as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Mark for broadcast only if it is counted to have few rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def most_frequent(counts: DataFrame, keep: int) -> DataFrame:
    """The rows with the largest ``n``, at most ``keep``; rows with equal ``n`` stay or go together.

    The cut comes from how many rows have each ``n``, so no task or driver gets more
    than ``keep`` rows, whatever the number of partitions. Rows with an ``n`` of 1
    are not frequent.
    """
    counts = saved(counts.where("n > 1"), "counts")
    sizes = counts.groupBy("n").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy(F.col("n").desc()))
    cut = sizes.withColumn("upto", upto).where(F.col("upto") <= keep).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= cut) if cut is not None else counts.limit(0)


def sorted_groups(batches, keys: list[str]):
    """Groups of consecutive equal keys, as (key, table), from sorted Arrow batches.

    Only the group at hand is held.
    """
    import numpy as np
    import pyarrow as pa

    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if starts[1] == 0:
            starts = starts[1:]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if current is not None and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)
