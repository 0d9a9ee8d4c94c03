"""Metric loads: configs, facts and their provenance from one batch."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import CONFIG_PARTS, config_signature, dimensions_hash, surrogate_id
from tidemark.functions.text import query_key
from tidemark.ingest.entities import lookup
from tidemark.ingest.merge import last_write_wins, merge_last_into_largest, new_keys
from tidemark.ingest.payloads import merged_payloads
from tidemark.operators.snapshot import daily_from_lifetime

FACT_KEYS = ("metric_config_id", "dimensions_hash", "metric_date")
PROVENANCE_KEYS = ("platform_id", "channel", "metric_id", "platform_created_at")


@dataclass(frozen=True)
class MetricTables:
    configs: DataFrame
    metrics: DataFrame
    provenance: DataFrame | None = None


def register_dimension_sets(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Dimension maps by hash, new ones added; keys are kept in lower case."""
    lowered = F.map_from_entries(
        F.transform(F.map_entries("dims"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    )
    found = (
        batch.select(lowered.alias("dims"))
        .withColumn("hash", dimensions_hash(F.col("dims")))
        .groupBy("hash")
        .agg(F.any_value("dims").alias("dims"))
        .select(surrogate_id(F.col("hash")).alias("dimension_set_id"), "hash", "dims")
    )
    return found if stored is None else stored.unionByName(new_keys(found, stored, ["hash"]).select(*stored.columns))


def resolve_keys(batch: DataFrame, entities: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Turn platform references into surrogate keys: part → (table, natural key).

    A reference no entity answers to gives NULL. Platform ids are looked up within
    the channel of the row where the table has channels. Search texts are cut to the
    key length first, as when the entity was stored.
    """
    for part, (frame, natural) in entities.items():
        if part in batch.columns:
            reference = query_key(F.col(part)) if part == "query" else F.col(part).cast("string")
            batch = lookup(batch.withColumn("__reference", reference), "__reference", frame, natural, f"{part}_id").drop("__reference")
    return batch


def config_rows(batch: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """One config per signature, with a stable id.

    ``parents`` (channeled_account_id, account_id) fills in a missing account.
    """
    columns = [c for c in batch.columns if c.endswith("_id") and c != "platform_id"]
    if parents is not None and "channeled_account_id" in columns:
        known = parents.select(F.col("channeled_account_id").alias("__ca"), F.col("account_id").alias("__parent"))
        batch = batch.join(known, F.col("channeled_account_id") == F.col("__ca"), "left").drop("__ca")
        own = F.col("account_id") if "account_id" in columns else F.lit(None).cast("bigint")
        batch = batch.withColumn("account_id", F.coalesce(own, "__parent")).drop("__parent")
        columns = list(dict.fromkeys([*columns, "account_id"]))
    fields = ["channel", "name", "period", *columns]
    picked = batch.groupBy("signature").agg(F.max_by(F.struct(*fields), "sequence").alias("r"))
    return picked.select(surrogate_id(F.col("signature")).alias("id"), F.col("signature").alias("config_signature"), "r.*")


def load_configs(stored: DataFrame, batch: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Stored configs and the new ones of a batch; known signatures stay."""
    fresh = new_keys(config_rows(batch, parents), stored, ["config_signature"])
    return stored.unionByName(fresh.select(*[c for c in stored.columns if c in fresh.columns]), allowMissingColumns=True)


def fact_rows(batch: DataFrame) -> DataFrame:
    """Facts of a batch: one per config, dimensions and day, the last one written."""
    return last_write_wins(_written_facts(batch), FACT_KEYS, "sequence").drop("sequence")


def merged_facts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored facts and those of a batch: of the last write and the stored value the larger."""
    return merge_last_into_largest(stored, _written_facts(batch), FACT_KEYS, "sequence")


def _written_facts(batch: DataFrame) -> DataFrame:
    return batch.select(
        surrogate_id(F.col("signature")).alias("metric_config_id"),
        "dimensions_hash",
        "value",
        "metadata",
        "metric_date",
        "sequence",
    )


def within_days_of(stored: DataFrame, batch: DataFrame, days_before: int = 0) -> Column:
    """Test for stored facts within the days of a batch.

    The bounds are scalar subqueries, so they prune partitions of the stored
    facts once the batch has been looked at.
    """
    first = batch.agg(F.date_sub(F.min("metric_date"), days_before).alias("d")).scalar()
    last = batch.agg(F.max("metric_date").alias("d")).scalar()
    return (F.col("metric_date") >= first) & (F.col("metric_date") <= last)


def load_facts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Facts with a batch merged in; days outside the batch pass through unshuffled."""
    near = F.coalesce(within_days_of(stored, batch), F.lit(False))
    return stored.filter(~near).unionByName(merged_facts(stored.filter(near), batch))


def provenance_rows(batch: DataFrame) -> DataFrame:
    """The platform row behind each fact."""
    return batch.filter(F.coalesce("platform_id", F.lit("")) != "").select(
        "platform_id",
        "channel",
        surrogate_id(F.concat_ws("|", "signature", "dimensions_hash", F.col("metric_date").cast("string"))).alias("metric_id"),
        F.col("metric_date").alias("platform_created_at"),
        "data",
        "sequence",
    )


def load_provenance(stored: DataFrame, batch: DataFrame, keep_payloads: bool = True) -> DataFrame:
    """Stored provenance and that of a batch; payloads merge, new JSON keys win."""
    rows = provenance_rows(batch)
    if not keep_payloads:
        known = stored.unionByName(new_keys(rows.drop("sequence").distinct(), stored, PROVENANCE_KEYS).withColumn("data", F.lit(None).cast("string")))
        return known.dropDuplicates(list(PROVENANCE_KEYS))
    both = stored.withColumn("sequence", F.lit(-1).cast("bigint")).unionByName(
        rows.withColumn("sequence", F.col("sequence").cast("bigint"))
    )
    return merged_payloads(both, PROVENANCE_KEYS)


def load_batch(tables: MetricTables, batch: DataFrame, parents: DataFrame | None = None, keep_payloads: bool = True) -> MetricTables:
    """Configs, facts and provenance of one batch, daily changes included."""
    recent = tables.metrics.filter(within_days_of(tables.metrics, batch, 1))
    stored = recent.join(
        tables.configs.select(F.col("id").alias("metric_config_id"), F.col("config_signature").alias("signature")), "metric_config_id"
    )
    full = daily_from_lifetime(batch, stored.select("signature", "metric_date", "value"), signature_of)
    return MetricTables(
        load_configs(tables.configs, full, parents),
        load_facts(tables.metrics, full),
        load_provenance(tables.provenance, full, keep_payloads) if tables.provenance is not None else None,
    )


def signature_of(batch: DataFrame) -> DataFrame:
    """Add the signature from the config parts present as columns."""
    parts = {p: F.col(p) for p in CONFIG_PARTS if p in batch.columns}
    if "dimensions_hash" in batch.columns:
        parts["dimension_set"] = F.col("dimensions_hash")
    return batch.withColumn("signature", config_signature(parts))
