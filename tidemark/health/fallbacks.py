"""Summary of the query event log.

``events``: executor_path_decision, executor_fallback_reason,
planner_diagnostics struct<profile_channel, profile_checked, profile_supported>.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the reason counted apart.
MISSING_PROFILE = "missing_profile_capability"
UNKNOWN_CHANNEL = "unknown"


def _flags() -> tuple[Column, Column, Column]:
    legacy = F.lower(F.coalesce("executor_path_decision", F.lit(""))) == "legacy"
    missing = F.lower(F.trim(F.coalesce("executor_fallback_reason", F.lit("")))) == MISSING_PROFILE
    channel = F.lower(F.trim(F.col("planner_diagnostics.profile_channel")))
    return legacy, missing, F.when(channel != "", channel)


def fallback_totals(events: DataFrame, pilot_channels: Iterable[str] = ()) -> DataFrame:
    legacy, missing, channel = _flags()
    pilots = [p.strip().lower() for p in pilot_channels if p and p.strip()]
    pilot = F.coalesce(channel.isin(pilots), F.lit(False)) if pilots else F.lit(False)
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_if(legacy).alias("legacy_events"),
        F.count_if(missing).alias("missing_profile_capability_events"),
        F.count_if(missing & pilot).alias("pilot_missing_profile_capability_events"),
        F.count_if(missing & ~pilot).alias("non_pilot_missing_profile_capability_events"),
    )


def fallback_by_channel(events: DataFrame) -> DataFrame:
    legacy, missing, channel = _flags()
    return events.groupBy(F.coalesce(channel, F.lit(UNKNOWN_CHANNEL)).alias("channel")).agg(
        F.count("*").alias("events"),
        F.count_if(legacy).alias("legacy_events"),
        F.count_if(missing).alias("missing_profile_capability_events"),
        F.count_if(F.col("planner_diagnostics.profile_checked")).alias("profile_checked_true_events"),
        F.count_if(~F.col("planner_diagnostics.profile_supported")).alias("profile_supported_false_events"),
    )
