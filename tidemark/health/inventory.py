"""How many rows each table holds, and for whom."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [t.agg(F.count("*").alias("count")).select(F.lit(n).alias("table"), "count") for n, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def row_inventory(tables: Mapping[str, DataFrame], accounts: DataFrame) -> DataFrame:
    """Rows per table, channel and account type.

    A table reaches its account through ``channeled_account_id`` if it has one,
    else through ``platform_id``; failing both, its own channel counts. Rows are
    counted by that key before the join.
    """
    parts = []
    for name, table in tables.items():
        columns = set(table.columns)
        own_channel = "channel" in columns
        if "channeled_account_id" in columns:
            key, account_key = "channeled_account_id", "id"
        elif "platform_id" in columns:
            key, account_key, own_channel = "platform_id", "platform_id", False
        else:
            key, account_key = None, None
        if key is None:
            counted = table.groupBy("channel").agg(F.count("*").alias("count")).withColumn("type", F.lit(None).cast("string"))
        else:
            keys = [F.col(key).cast("string").alias("__key"), *([F.col("channel").alias("__own")] if own_channel else [])]
            by_key = table.groupBy(*keys).agg(F.count("*").alias("__n"))
            owner = accounts.select(
                F.col(account_key).cast("string").alias("__account"), F.col("channel").alias("__channel"), F.col("type")
            )
            joined = by_key.join(owner, F.col("__key") == F.col("__account"), "left")
            channel = F.col("__own") if own_channel else F.col("__channel")
            counted = joined.groupBy(channel.alias("channel"), "type").agg(F.sum("__n").alias("count"))
        parts.append(counted.select(F.lit(name).alias("table"), "channel", "type", "count"))
    return reduce(DataFrame.unionByName, parts)
