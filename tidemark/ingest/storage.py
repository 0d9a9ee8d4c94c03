"""Metric loads into tables on disk: configs, facts by month, provenance by month.

A load touches the months of its batch only. The batch is staged once, so what it
comes from runs once; every merge gives the same table if a load is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import month_of
from tidemark.ingest import metrics as M
from tidemark.ingest.merge import new_keys
from tidemark.operators.snapshot import daily_from_lifetime

FACT_SCHEMA = "metric_config_id bigint, dimensions_hash string, value double, metadata string, metric_date date, month int"
PROVENANCE_SCHEMA = "platform_id string, channel string, metric_id bigint, platform_created_at date, data string, month int"


class MetricStore:
    """The three tables under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, config_schema: str):
        """``config_schema`` names the columns of configs, ``config_signature`` among them."""
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {"configs": config_schema, "facts": FACT_SCHEMA, "provenance": PROVENANCE_SCHEMA}

    def create(self) -> None:
        """Write the tables without rows."""
        for name, schema in self.schemas.items():
            self._write(self.spark.createDataFrame([], schema), name, "overwrite")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.root}/{name}")

    def _write(self, df: DataFrame, name: str, mode: str, where: str | None = None) -> None:
        writer = df.write.mode(mode)
        if "month" in df.columns:
            writer = writer.partitionBy("month")
        if mode == "overwrite" and where is None:
            writer = writer.option("partitionOverwriteMode", "dynamic" if "month" in df.columns else "static")
        writer.parquet(where or f"{self.root}/{name}")

    def load(self, batch: DataFrame, load: str, parents: DataFrame | None = None, keep_payloads: bool = True) -> list[int]:
        """Load one batch with resolved keys and signatures; returns the months it touched.

        Lifetime rows get the change since the day before. Within the batch the
        last write of a fact counts, against stored facts the larger value.
        ``load`` names the staging folder; a load that broke off may run again.
        """
        staging = f"{self.root}/_staging/{load}"
        batch.write.mode("overwrite").parquet(f"{staging}/batch")
        batch = self.spark.read.schema(batch.schema).parquet(f"{staging}/batch")
        lifetime = batch.where(F.lower("period") == "lifetime")
        configs = self.read("configs")
        # Without lifetime rows the batch is all there is, and is staged already.
        full = batch if lifetime.isEmpty() else self._with_daily(batch, lifetime, f"{staging}/full")

        # Known signatures are skipped, so a part written before a break-off is not written again.
        fresh = new_keys(M.config_rows(full, parents), configs, ["config_signature"])
        names = configs.columns
        self._write(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).alias(c) for c in names]), "configs", "append")
        months = self._months(full)
        self._swap("facts", staging, months, M.merged_facts(self._near("facts", months), full), "metric_date")
        rows = M.load_provenance(self._near("provenance", months), full, keep_payloads)
        self._swap("provenance", staging, months, rows, "platform_created_at")
        return months

    def _with_daily(self, batch: DataFrame, lifetime: DataFrame, path: str) -> DataFrame:
        before = self._months(lifetime.select(F.date_sub("metric_date", 1).alias("metric_date")))
        known = self.read("configs").select(F.col("id").alias("metric_config_id"), F.col("config_signature").alias("signature"))
        stored = self.read("facts").where(F.col("month").isin(before)).join(known, "metric_config_id")
        full = daily_from_lifetime(batch, stored.select("signature", "metric_date", "value"), M.signature_of)
        full.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(full.schema).parquet(path)

    def _months(self, rows: DataFrame) -> list[int]:
        """Months of some rows: bounded by the calendar."""
        return sorted(r[0] for r in rows.select(month_of(F.col("metric_date"))).distinct().collect() if r[0] is not None)

    def _near(self, name: str, months: Sequence[int]) -> DataFrame:
        return self.read(name).where(F.col("month").isin(list(months))).drop("month")

    def _swap(self, name: str, staging: str, months: Sequence[int], rows: DataFrame, day: str) -> None:
        """Write the merged months aside, then over the old ones; other months stay untouched."""
        if not months:
            return
        dated = rows.withColumn("month", month_of(F.col(day))).hint("rebalance", "month")
        self._write(dated.sortWithinPartitions("month", day), name, "overwrite", f"{staging}/{name}")
        merged = self.spark.read.schema(self.schemas[name]).parquet(f"{staging}/{name}")
        self._write(merged, name, "overwrite")
