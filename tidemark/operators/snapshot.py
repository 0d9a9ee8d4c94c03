"""Snapshots: the latest state per context, and the change between two states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import as_date

# What makes up the context of a snapshot.
CONTEXT = (
    "channel",
    "period",
    "channeled_account_id",
    "page_id",
    "post_id",
    "dimension_set_id",
    "query_id",
    "country_id",
    "device_id",
)


def _context_key(frame: DataFrame) -> list[str]:
    return [c for c in CONTEXT if c in frame.columns]


def _same_context(keys: list[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def latest_snapshot(
    frame: DataFrame, start: str | None = None, end: str | None = None, mode: str = "resilient", source: DataFrame | None = None
) -> DataFrame:
    """Keep the facts of each context's latest date within the range.

    ``resilient`` falls back to the context's latest date overall where the range
    holds none; ``strict`` drops such contexts. ``source`` holds the facts the
    dates are looked up in and defaults to ``frame`` itself.

    The dates come from a partial aggregate and the date is part of the join key,
    so one context with most of the rows does not land in one task.
    """
    keys = _context_key(frame)
    day = F.col("metric_date")
    inside = F.lit(True)
    if start is not None:
        inside = inside & (day >= F.lit(as_date(start)))
    if end is not None:
        inside = inside & (day <= F.lit(as_date(end)))
    lookup = source if source is not None else frame
    if mode == "strict":
        lookup = lookup.filter(inside)
        frame = frame.filter(inside)
        target = F.max(day)
    else:
        target = F.coalesce(F.max(F.when(inside, day)), F.max(day))
    dates = lookup.groupBy(*keys).agg(target.alias("metric_date"))
    return frame.alias("f").join(
        dates.alias("s"),
        _same_context(keys, "f", "s") & (F.col("f.metric_date") == F.col("s.metric_date")),
        "left_semi",
    )


def snapshot_delta(
    frame: DataFrame, start: str, end: str, mode: str = "resilient", source: DataFrame | None = None
) -> DataFrame:
    """Turn ``value`` into its share of the change over [start, end].

    Facts on the context's last date up to ``end`` count as ``+value``, facts on
    its last date before ``start`` as ``-value`` and all others as 0.
    """
    keys = _context_key(frame)
    day = F.col("metric_date")
    first, last = F.lit(as_date(start)), F.lit(as_date(end))
    closing = F.max(F.when(day <= last, day))
    if mode == "strict":
        frame = frame.filter(day <= last)
    else:
        closing = F.coalesce(closing, F.max(day))
    lookup = source if source is not None else frame
    spans = lookup.groupBy(*keys).agg(closing.alias("__close"), F.max(F.when(day < first, day)).alias("__open"))
    # One row per context and anchor date; the closing date wins where both fall together.
    anchors = spans.select(
        *keys,
        F.explode(
            F.map_from_entries(
                F.filter(
                    F.array(
                        F.struct(F.col("__close").alias("d"), F.lit(1.0).alias("sign")),
                        F.struct(
                            F.when(~F.col("__open").eqNullSafe(F.col("__close")), F.col("__open")).alias("d"),
                            F.lit(-1.0).alias("sign"),
                        ),
                    ),
                    lambda a: a["d"].isNotNull(),
                )
            )
        ).alias("metric_date", "__sign"),
    )
    joined = frame.alias("f").join(
        anchors.alias("s"),
        _same_context(keys, "f", "s") & (F.col("f.metric_date") == F.col("s.metric_date")),
        "left",
    )
    columns = [F.col(f"f.{c}") for c in frame.columns if c != "value"]
    signed = F.col("f.value") * F.coalesce(F.col("s.__sign"), F.lit(0.0))
    return joined.select(*columns, signed.alias("value"))


def snapshot_metadata(df: DataFrame, start: str | None, end: str | None, mode: str) -> DataFrame:
    """One row on the dates a snapshot result really stands for."""
    dates = F.sort_array(F.collect_set(F.date_format("snapshot_effective_date", "yyyy-MM-dd")))
    other = F.filter(F.col("effective_end_dates"), lambda d: d != F.lit(end)) if end else F.array().cast("array<string>")
    return df.agg(dates.alias("effective_end_dates")).select(
        F.lit(mode).alias("snapshot_fallback_mode"),
        "effective_end_dates",
        other.alias("fallback_end_dates"),
        F.lit(start).cast("string").alias("requested_start_date"),
        F.lit(end).cast("string").alias("requested_end_date"),
    )


def daily_from_lifetime(
    batch: DataFrame, stored: DataFrame, sign: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Add a ``<name>_daily`` row to each lifetime row of a batch.

    Its value is today's lifetime value minus the stored value of exactly the
    day before (none counts as 0), never below 0. ``signature`` names the config;
    ``sign`` computes it anew for the renamed rows.
    """
    lifetime = batch.filter(F.lower("period") == "lifetime")
    before = stored.select(
        F.col("signature").alias("__signature"),
        F.date_add("metric_date", 1).alias("__day"),
        F.col("value").alias("__before"),
    )
    joined = lifetime.join(
        before, (F.col("signature") == F.col("__signature")) & (F.col("metric_date") == F.col("__day")), "left"
    )
    replaced = {
        "name": F.concat("name", F.lit("_daily")),
        "period": F.lit("daily"),
        "value": F.greatest(F.lit(0.0), F.col("value") - F.coalesce("__before", F.lit(0.0))),
    }
    daily = joined.select(*[replaced.get(c, F.col(c)).alias(c) for c in batch.columns])
    return batch.unionByName(daily if sign is None else sign(daily))
