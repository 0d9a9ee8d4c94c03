"""Ranks, bests and samples that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def best_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], keep: int = 1, output: str | None = None) -> DataFrame:
    """The first ``keep`` rows of each group in the given order.

    Spark cuts each partition to ``keep`` rows per group before the shuffle.
    """
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    ranked = ranked.filter(F.col("__rank") <= keep)
    return ranked.withColumnRenamed("__rank", output) if output else ranked.drop("__rank")


def survivor_per_group(df: DataFrame, group: str, url: str = "url", key: str = "id") -> DataFrame:
    """Map each row of a duplicate group to the one with the longest URL.

    Equal lengths fall to the smallest key. The survivor comes from a partial
    aggregate, and rows that survive themselves are left out.
    """
    best = df.groupBy(group).agg(
        F.max_by(key, F.struct(F.length(url), -F.col(key))).alias("survivor_id"), F.count("*").alias("__n")
    )
    pairs = df.select(group, F.col(key).alias("duplicate_id")).join(best.filter("__n > 1"), group)
    return pairs.filter(F.col("duplicate_id") != F.col("survivor_id")).select(group, "duplicate_id", "survivor_id")


def latest_per_channel(df: DataFrame, by: str = "platform_id", channel: str = "channel") -> DataFrame:
    """The last row of each channel: by platform id (longer first), or by time."""
    key = F.struct(F.length(by), F.col(by)) if by == "platform_id" else F.col(by)
    row = F.struct(*[F.col(c) for c in df.columns if c != channel])
    return df.groupBy(channel).agg(F.max_by(row, key).alias("r")).select(channel, "r.*")


def oldest_and_newest(df: DataFrame, groups: Sequence[str], key: str, keep: int = 5) -> DataFrame:
    """Up to ``keep`` oldest and ``keep`` newest rows per group, without repeats."""
    oldest = best_per_group(df, groups, [F.col(key).asc()], keep)
    newest = best_per_group(df, groups, [F.col(key).desc()], keep)
    return oldest.unionByName(newest).dropDuplicates([key])
