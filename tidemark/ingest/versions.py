"""Metric loads that become visible in one step, for all tables at once.

A load writes new generations of the months it touches beside the old ones. One
commit file, renamed into place at the end, names the generation of every month of
every table. Readers take the latest commit and see configs, facts, provenance and
watermarks of the same load; what a broken load left behind is named by no commit.

    <root>/<table>/month=<m>/generation=<g>/     rows of a month
    <root>/configs/generation=<g>/               configs, appended per load
    <root>/commits/<version>.json                which generations make up a version
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import month_of
from tidemark.ingest import metrics as M
from tidemark.ingest.merge import new_keys
from tidemark.ingest.storage import FACT_SCHEMA, PROVENANCE_SCHEMA
from tidemark.operators.snapshot import daily_from_lifetime
from tidemark.sources.store import Conflict, Files

WATERMARK_KEYS = ("channel", "channeled_account_id", "page_id")
WATERMARK_SCHEMA = "channel string, channeled_account_id bigint, page_id bigint, last_day date, month int"
# The name under which tables without months list their generations.
WHOLE = "*"
# Generations of configs from which a load writes them anew as one.
MOST_CONFIG_PARTS = 16


@dataclass(frozen=True)
class Version:
    """The tables as one commit left them."""

    store: VersionedStore
    number: int
    #: Generations by table and month.
    parts: dict[str, dict[str, list[str]]]

    def months(self, name: str) -> list[int]:
        return sorted(int(m) for m in self.parts[name])

    def read(self, name: str) -> DataFrame:
        """A table of this version; a filter on ``month`` is met by reading only those months."""
        base = f"{self.store.root}/{name}"
        folders = [f"{base}/generation={g}" if month == WHOLE else f"{base}/month={month}/generation={g}" for month, own in self.parts[name].items() for g in own]
        schema = self.store.schemas[name]
        if not folders:
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.schema(f"{schema}, generation string").option("basePath", base).parquet(*folders).drop("generation")

    def last_loaded_day(self, entity: str = "channeled_account_id") -> DataFrame:
        """How far each channel and account (or page) has been loaded, from the watermarks alone."""
        known = self.read("watermarks").where(F.col(entity).isNotNull())
        return known.groupBy("channel", entity).agg(F.max("last_day").alias("last_day"))


def _nothing(step: str) -> None:
    pass


class VersionedStore:
    """Configs, facts, provenance and watermarks under one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, config_schema: str):
        """``config_schema`` names the columns of configs, ``config_signature`` among them."""
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {"configs": config_schema, "facts": FACT_SCHEMA, "provenance": PROVENANCE_SCHEMA, "watermarks": WATERMARK_SCHEMA}
        self._files = Files(spark, self.root)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._files.names(f"{self.root}/commits") if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The given or the latest version; before the first load all tables are empty."""
        if number is None:
            number = max(self.versions(), default=0)
        if not number:
            return Version(self, 0, {name: {} for name in self.schemas})
        text = self.spark.read.text(f"{self.root}/commits/{number:012d}.json", wholetext=True).first()[0]
        return Version(self, number, json.loads(text)["tables"])

    def load(
        self, batch: DataFrame, load: str, parents: DataFrame | None = None, keep_payloads: bool = True, on_step: Callable[[str], None] = _nothing, attempts: int = 3
    ) -> Version:
        """Load one batch with resolved keys and signatures; returns the version it made.

        Lifetime rows get the change since the day before. Within the batch the last
        write of a fact counts, against stored facts the larger value; a load may be
        repeated. The batch is staged once. If another load commits meanwhile, the
        merge starts again from what that one left. ``on_step`` is told what has just
        been written.
        """
        staging = f"{self.root}/_staging/{load}-{uuid.uuid4().hex}"
        batch.write.parquet(f"{staging}/batch")
        batch = self.spark.read.schema(batch.schema).parquet(f"{staging}/batch")
        on_step("batch")
        for attempt in range(attempts):
            base = self.version()
            full = self._with_daily(base, batch, f"{staging}/full-{attempt}")
            generation = f"{load}-{uuid.uuid4().hex}"
            months = sorted(r[0] for r in full.select(month_of(F.col("metric_date"))).distinct().collect() if r[0] is not None)
            parts = {name: dict(own) for name, own in base.parts.items()}
            parts["configs"] = self._add_configs(base, M.config_rows(full, parents), generation)
            on_step("configs")
            merged = {
                "facts": (M.merged_facts(self._near(base, "facts", months), full), "metric_date"),
                "provenance": (M.load_provenance(self._near(base, "provenance", months), full, keep_payloads), "platform_created_at"),
                "watermarks": (self._watermarks(self._near(base, "watermarks", months), full), "last_day"),
            }
            for name, (rows, day) in merged.items():
                parts[name] |= self._write_months(name, rows, day, months, generation)
                on_step(name)
            try:
                return self._commit(base, load, parts)
            except Conflict:
                if attempt == attempts - 1:
                    raise

    def purge_channel(self, channel: str, load: str) -> Version:
        """A version without anything of one channel; only months that its watermarks name are rewritten."""
        base, generation, same = self.version(), f"{load}-{uuid.uuid4().hex}", F.coalesce(F.lower("channel") == channel.lower(), F.lit(False))
        marks = base.read("watermarks")
        months = sorted(r[0] for r in marks.where(same).select("month").distinct().collect())
        gone = base.read("configs").where(same).select(F.col("id").alias("__gone"))
        facts = self._near(base, "facts", months)
        kept = {
            "facts": (facts.join(gone, F.col("metric_config_id") == F.col("__gone"), "left_anti"), "metric_date"),
            "provenance": (self._near(base, "provenance", months).where(~same), "platform_created_at"),
            "watermarks": (self._near(base, "watermarks", months).where(~same), "last_day"),
        }
        parts = {name: dict(own) for name, own in base.parts.items()}
        for name, (rows, day) in kept.items():
            parts[name] = {m: g for m, g in parts[name].items() if int(m) not in months} | self._write_months(name, rows, day, months, generation)
        self._write_whole("configs", base.read("configs").where(~same), generation)
        parts["configs"] = {WHOLE: [generation]}
        return self._commit(base, load, parts)

    def vacuum(self, keep: int = 2) -> None:
        """Delete older versions than the last ``keep``, and files that none of these names.

        To be called while nothing is loaded, as a load under way is not yet named.
        """
        numbers = self.versions()
        for old in numbers[: max(0, len(numbers) - keep)]:
            self._files.delete(f"{self.root}/commits/{old:012d}.json")
        used = [self.version(n).parts for n in numbers[-keep:]]
        for name in self.schemas:
            for folder in self._files.names(f"{self.root}/{name}"):
                month, inner = (folder.removeprefix("month="), f"{self.root}/{name}/{folder}") if folder.startswith("month=") else (WHOLE, f"{self.root}/{name}")
                for part in self._files.names(inner) if month != WHOLE else [folder]:
                    own = part.removeprefix("generation=")
                    if part.startswith("generation=") and not any(own in v[name].get(month, []) for v in used):
                        self._files.delete(f"{inner}/{part}")
        self._files.delete(f"{self.root}/_staging")

    def _with_daily(self, base: Version, batch: DataFrame, path: str) -> DataFrame:
        lifetime = batch.where(F.lower("period") == "lifetime")
        if lifetime.isEmpty():
            # The batch is all there is, and is staged already.
            return batch
        before = [r[0] for r in lifetime.select(month_of(F.date_sub("metric_date", 1))).distinct().collect() if r[0] is not None]
        known = base.read("configs").select(F.col("id").alias("metric_config_id"), F.col("config_signature").alias("signature"))
        stored = base.read("facts").where(F.col("month").isin(before)).join(known, "metric_config_id")
        full = daily_from_lifetime(batch, stored.select("signature", "metric_date", "value"), M.signature_of)
        full.write.parquet(path)
        return self.spark.read.schema(full.schema).parquet(path)

    def _near(self, base: Version, name: str, months: Sequence[int]) -> DataFrame:
        return base.read(name).where(F.col("month").isin(list(months))).drop("month")

    def _watermarks(self, stored: DataFrame, full: DataFrame) -> DataFrame:
        """Largest dates by month. Merges take no fact away, so the old maximum holds on."""
        keys = [F.col(k) if k in full.columns else F.lit(None).cast(stored.schema[k].dataType).alias(k) for k in WATERMARK_KEYS]
        rows = stored.unionByName(full.select(*keys, F.col("metric_date").alias("last_day")))
        month = month_of(F.col("last_day"))
        return rows.groupBy(*WATERMARK_KEYS, month.alias("__month")).agg(F.max("last_day").alias("last_day")).drop("__month")

    def _add_configs(self, base: Version, rows: DataFrame, generation: str) -> dict[str, list[str]]:
        stored = base.read("configs")
        fresh = new_keys(rows, stored, ["config_signature"])
        fresh = fresh.select(*[(F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema])
        old = base.parts["configs"].get(WHOLE, [])
        anew = len(old) >= MOST_CONFIG_PARTS
        self._write_whole("configs", stored.unionByName(fresh) if anew else fresh, generation)
        return {WHOLE: [generation] if anew else [*old, generation]}

    def _write_whole(self, name: str, rows: DataFrame, generation: str) -> None:
        rows.write.parquet(f"{self.root}/{name}/generation={generation}")

    def _write_months(self, name: str, rows: DataFrame, day: str, months: Sequence[int], generation: str) -> dict[str, list[str]]:
        """Write the merged months as a new generation; returns those that hold rows."""
        if not months:
            return {}
        dated = rows.withColumns({"month": month_of(F.col(day)), "generation": F.lit(generation)}).hint("rebalance", "month")
        dated.sortWithinPartitions("month", day).write.mode("append").partitionBy("month", "generation").parquet(f"{self.root}/{name}")
        return {str(m): [generation] for m in months if self._files.exists(f"{self.root}/{name}/month={m}/generation={generation}")}

    def _commit(self, base: Version, load: str, parts: dict[str, dict[str, list[str]]]) -> Version:
        number = base.number + 1
        text = json.dumps({"version": number, "load": load, "tables": parts})
        self._files.create_once(f"{self.root}/commits/{number:012d}.json", text)
        return Version(self, number, parts)
