"""A star stored in buckets, so that facts meet their configs without a shuffle."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.model import Star
from tidemark.session import shared_folder, staged
from tidemark.sources import files


def bucketed_star(star: Star, name: str, buckets: int | None = None, at_most: int = 50_000_000) -> Star:
    """Store metrics and configs as tables ``<name>_metrics`` and ``<name>_configs``, both in buckets of the config.

    Dimensions are stored with the configs. A bucket is read by one task, so a
    config with more than ``at_most`` facts is cut into pieces: each has an id and a
    copy of the config's row, and the facts are dealt over them. In the star that is
    returned ``metric_config_id`` is that of a piece and ``config_id`` the config's
    own; requests group by what configs say, so their answers stay the same.
    """
    spark = star.metrics.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = star.metrics.groupBy(F.col("metric_config_id").alias("__of")).agg(F.ceil(F.count("*") / at_most).cast("int").alias("__pieces"))
    # One row per config that is cut: at most the facts over ``at_most``.
    hot = staged(sizes.filter("__pieces > 1"), "hot-configs")

    def piece(number):
        return F.when(F.col("__pieces").isNull(), F.col("config_id")).otherwise(F.xxhash64("config_id", number))

    metrics = star.metrics.withColumnRenamed("metric_config_id", "config_id").join(hot, F.col("config_id") == F.col("__of"), "left")
    dealt = metrics.withColumn("metric_config_id", piece(F.pmod(F.xxhash64("metric_date", "value"), F.col("__pieces")).cast("int")))
    configs = star.config_frame().withColumnRenamed("id", "config_id").join(hot, F.col("config_id") == F.col("__of"), "left")
    repeated = configs.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)))
    repeated = repeated.withColumn("metric_config_id", piece(F.col("__piece")))
    folder = f"{shared_folder(spark)}/{name}"
    files.write_bucketed(dealt.drop("__of", "__pieces", "config_id"), f"{name}_metrics", "metric_config_id", buckets, f"{folder}/metrics")
    files.write_bucketed(repeated.drop("__of", "__pieces", "__piece"), f"{name}_configs", "metric_config_id", buckets, f"{folder}/configs")
    stored = spark.table(f"{name}_configs").withColumnRenamed("metric_config_id", "id")
    return replace(star, metrics=spark.table(f"{name}_metrics"), configs=stored)
