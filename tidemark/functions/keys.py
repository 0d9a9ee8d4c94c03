"""Deterministic keys of rows, configs and dimension sets (MD5 of canonical JSON)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parts that make up what a metric measures, and of what.
CONFIG_PARTS = (
    "account",
    "ad",
    "ad_group",
    "campaign",
    "channel",
    "channeled_account",
    "channeled_campaign",
    "channeled_event",
    "city",
    "country",
    "creative",
    "customer",
    "device",
    "dimension_set",
    "event",
    "location",
    "name",
    "order",
    "page",
    "period",
    "post",
    "product",
    "query",
    "state",
)


def dimensions_hash(dims: Column) -> Column:
    """Hash of a dimension map; pair order does not matter."""
    return F.md5(F.to_json(F.array_sort(F.map_entries(dims))))


def config_signature(parts: Mapping[str, Column]) -> Column:
    """Signature of a metric config; a NULL part equals an absent one."""
    unknown = set(parts) - set(CONFIG_PARTS)
    if unknown:
        raise ValueError(f"unknown config parts {sorted(unknown)}")
    return F.md5(F.to_json(F.struct(*[parts[p].cast("string").alias(p) for p in CONFIG_PARTS if p in parts])))


def metric_key(signature: Column, dims_hash: Column, day: Column) -> Column:
    return F.md5(F.concat_ws("|", signature, F.coalesce(dims_hash, F.lit("")), day.cast("string")))


def surrogate_id(natural_key: Column) -> Column:
    """Stable 64-bit id of a natural key; repeated loads give the same id."""
    return F.xxhash64(natural_key)
