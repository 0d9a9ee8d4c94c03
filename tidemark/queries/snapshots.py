"""Snapshots and day-over-day changes of lifetime counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.snapshot import daily_from_lifetime, snapshot_metadata
from tidemark.plans.request import AggregateRequest, aggregate
from tidemark.queries.registry import LIFETIME, query
from tidemark.sources import tables as T

_PICK = """R(SUM(CASE WHEN name = 'clicks' THEN value ELSE 0 END)) AS clicks, R(SUM(CASE WHEN name = 'impressions' THEN value ELSE 0 END)) AS impressions"""
MEASURES = {"clicks": "clicks", "impressions": "impressions"}


def _request(filters, group_by, start, end):
    # Library formulas follow the requested period, so counters are read as such.
    names = {"clicks": "post_clicks", "impressions": "page_impressions"}
    return AggregateRequest(names, group_by, {"period": "lifetime", **filters}, start, end)


@query(
    "f2_latest_snapshot_resilient",
    f"""WITH {LIFETIME}, s AS (SELECT acc, COALESCE(MAX(CASE WHEN d BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN d END), MAX(d)) AS d FROM lt GROUP BY acc)
    SELECT acc AS channeled_account_id, {_PICK}, MAX(lt.d) AS snapshot_effective_date FROM lt JOIN s USING (acc, d) GROUP BY acc""".replace("MAX(lt.d)", "MAX(d)"),
)
def latest_resilient(spark, folder):
    star = T.lifetime_star(spark, folder)
    star = star.__class__(facts=star.facts, relations={})
    return aggregate(star, _request({"latest_snapshot": True}, ["channeled_account_id"], "2024-01-10", "2024-01-12"))


@query(
    "f2_latest_snapshot_strict",
    f"""WITH {LIFETIME}, s AS (SELECT acc, MAX(d) AS d FROM lt WHERE d BETWEEN DATE '2024-01-10' AND DATE '2024-01-10' GROUP BY acc)
    SELECT acc AS channeled_account_id, {_PICK}, MAX(d) AS snapshot_effective_date FROM lt JOIN s USING (acc, d) GROUP BY acc""",
)
def latest_strict(spark, folder):
    star = T.lifetime_star(spark, folder)
    star = star.__class__(facts=star.facts, relations={})
    filters = {"latest_snapshot": "true", "snapshot_fallback_mode": "strict"}
    return aggregate(star, _request(filters, ["channeled_account_id"], "2024-01-10", "2024-01-10"))


@query(
    "f3_snapshot_delta",
    f"""WITH {LIFETIME}, s AS (SELECT acc, COALESCE(MAX(CASE WHEN d <= DATE '2024-01-20' THEN d END), MAX(d)) AS e, MAX(CASE WHEN d < DATE '2024-01-10' THEN d END) AS b FROM lt GROUP BY acc),
    v AS (SELECT lt.name, lt.acc, lt.d, CASE WHEN lt.d = e THEN value WHEN lt.d = b THEN -value ELSE 0 END AS value FROM lt JOIN s ON lt.acc = s.acc)
    SELECT acc AS channeled_account_id, {_PICK}, MAX(d) AS snapshot_effective_date FROM v GROUP BY acc""",
)
def delta(spark, folder):
    star = T.lifetime_star(spark, folder)
    star = star.__class__(facts=star.facts, relations={})
    return aggregate(star, _request({"snapshot_delta": True}, ["channeled_account_id"], "2024-01-10", "2024-01-20"))


@query(
    "f4_snapshot_metadata",
    f"""WITH {LIFETIME}, s AS (SELECT acc, MAX(d) AS d FROM lt WHERE d <= DATE '2024-01-15' GROUP BY acc)
    SELECT 'strict' AS snapshot_fallback_mode, string_agg(DISTINCT strftime(d, '%Y-%m-%d'), ',' ORDER BY strftime(d, '%Y-%m-%d')) AS effective,
    string_agg(DISTINCT strftime(d, '%Y-%m-%d'), ',' ORDER BY strftime(d, '%Y-%m-%d')) FILTER (d <> DATE '2024-01-15') AS fallback, '2024-01-15' AS requested_end_date FROM s""",
)
def metadata(spark, folder):
    star = T.lifetime_star(spark, folder)
    star = star.__class__(facts=star.facts, relations={})
    filters = {"latest_snapshot": True, "snapshot_fallback_mode": "strict"}
    result = aggregate(star, _request(filters, ["channeled_account_id"], None, "2024-01-15"))
    meta = snapshot_metadata(result, None, "2024-01-15", "strict")
    return meta.select(
        "snapshot_fallback_mode",
        F.array_join("effective_end_dates", ",").alias("effective"),
        F.array_join("fallback_end_dates", ",").alias("fallback"),
        "requested_end_date",
    )


@query(
    "f5_daily_from_lifetime",
    f"""WITH {LIFETIME} SELECT name, 'lifetime' AS period, d AS metric_date, acc, R(value) AS value FROM lt
    UNION ALL SELECT t.name || '_daily', 'daily', t.d, t.acc, R(GREATEST(0, t.value - COALESCE(y.value, 0)))
    FROM lt t LEFT JOIN lt y ON y.name = t.name AND y.acc = t.acc AND y.d = t.d - 1""",
)
def daily(spark, folder):
    lifetime = T.lifetime_facts(spark, folder).select(
        "name",
        "period",
        "metric_date",
        F.col("channeled_account_id").alias("acc"),
        "value",
        F.concat_ws("|", "name", F.col("channeled_account_id").cast("string")).alias("signature"),
    )
    return daily_from_lifetime(lifetime, lifetime).drop("signature")
