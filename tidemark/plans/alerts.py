"""Threshold alerts over KPI series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import next_evaluation
from tidemark.functions.formulas import MetricDictionary
from tidemark.model import Star
from tidemark.plans.kpi import evaluate_kpis

# How a series becomes the number a threshold is held against.
REDUCTIONS = ("sum", "avg", "min", "max", "latest")


def due_alerts(alerts: DataFrame, now: str, force: bool = False) -> DataFrame:
    """Active alerts whose next evaluation is not in the future."""
    if force:
        return alerts
    due = F.col("next_evaluation_at").isNull() | (F.col("next_evaluation_at") <= F.lit(now).cast("timestamp"))
    return alerts.filter(F.coalesce("is_active", F.lit(True)) & due)


def with_next_evaluation(alerts: DataFrame, now: str) -> DataFrame:
    moment = F.lit(now).cast("timestamp")
    return alerts.withColumn(
        "next_evaluation_at", next_evaluation(moment, F.col("schedule_type"), F.col("time_of_day"), F.col("day_of_week"))
    )


def reduce_series(series: DataFrame, by: list[str]) -> DataFrame:
    """Every reduction of each series at once; ``latest`` is at the largest key."""
    return series.groupBy(*by).agg(
        F.sum("value").alias("sum"),
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max_by("value", "key").alias("latest"),
    )


def _chosen(method: Column) -> Column:
    out = F.col("latest")
    for name in REDUCTIONS[:-1]:
        out = F.when(method == name, F.col(name)).otherwise(out)
    return out


def evaluate_alerts(alerts: DataFrame, series: DataFrame) -> DataFrame:
    """Status of each alert line: ``triggered`` above the upper or below the lower limit.

    ``alerts``: alert_id, line_id, aggregation_method, upper_limit, lower_limit.
    ``series``: alert_id, line_id, key, value. A line without points counts as 0.
    """
    lines = ["alert_id", "line_id"]
    joined = alerts.join(reduce_series(series, lines), lines, "left")
    value = F.coalesce(_chosen(F.coalesce("aggregation_method", F.lit("latest"))), F.lit(0.0))
    above = F.coalesce(F.col("evaluated_value") > F.col("upper_limit"), F.lit(False))
    below = F.coalesce(F.col("evaluated_value") < F.col("lower_limit"), F.lit(False))
    valued = joined.select(*lines, "upper_limit", "lower_limit", value.alias("evaluated_value"))
    return valued.select(
        *lines,
        "evaluated_value",
        F.when(above | below, "triggered").otherwise("ok").alias("status"),
        F.when(above, "upper").when(below, "lower").alias("threshold_type"),
        F.when(above, F.col("upper_limit")).when(below, F.col("lower_limit")).alias("threshold_value"),
    )


def alert_series(
    star: Star,
    lines: Sequence[Mapping[str, Any]],
    start_date: str | None = None,
    end_date: str | None = None,
    group_by: str = "daily",
    derived: Mapping[int, Mapping[str, Any]] | None = None,
    dictionary: MetricDictionary | None = None,
) -> DataFrame:
    """The KPI series behind each alert line, as ``evaluate_alerts`` takes them.

    A line has ``alert_id``, ``line_id``, ``tree`` and, if it watches single assets,
    ``filters``. The leaves of all lines are answered together: lines that watch the
    same channel and filters share one request, so facts are read once per distinct
    filter set, however many lines there are.
    """
    if not lines:
        raise ValueError("no alert lines")
    points = evaluate_kpis(star, [(line["tree"], line.get("filters")) for line in lines], start_date, end_date, group_by, derived, dictionary)
    ids = F.array(*[F.struct(F.lit(line["alert_id"]).cast("long").alias("alert_id"), F.lit(line["line_id"]).cast("long").alias("line_id")) for line in lines])
    named = points.withColumn("__line", F.element_at(ids, F.col("at") + 1))
    return named.select("__line.alert_id", "__line.line_id", "key" if "key" in points.columns else F.lit(None).alias("key"), "value")
