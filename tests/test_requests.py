"""Literal cases of aggregate requests, snapshots and weighted metrics."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import AggregateRequest, Star, aggregate
from tidemark.functions.formulas import merge_search_partials
from tidemark.operators.gapfill import fill_gaps
from tidemark.operators.snapshot import daily_from_lifetime, latest_snapshot, snapshot_delta, snapshot_metadata
from tidemark.operators.weighted import keep_requested_dimension_sets, time_weighted_average
from tidemark.plans.request import filtered_facts
from tidemark.sources import tables as T

FACTS = (
    "channel string, name string, period string, value double, metric_date date, channeled_account_id long, page_id long, query_id long, "
    "country_id long, device_id long, post_id long, dimension_set_id string, dims map<string,string>"
)


def fact(name, value, day, period="daily", channel="search", account=None, page=3, query=1, country=1, device=1, post=None, dims=None):
    dims = {"searchappearance": "standard"} if dims is None else dims
    set_id = ",".join(f"{k}={v}" for k, v in sorted(dims.items())) or None
    return (channel, name, period, float(value), date.fromisoformat(day), account, page, query, country, device, post, set_id, dims or None)


def facts(spark, *listed):
    return spark.createDataFrame(list(listed), FACTS)


def test_weighted_position(spark, rows):
    frame = facts(
        spark,
        fact("position", 99, "2026-04-01", country=117),
        fact("impressions", 1, "2026-04-01", country=117),
        fact("position", 10, "2026-04-01", country=1),
        fact("impressions", 10, "2026-04-01", country=1),
    )
    codes = spark.createDataFrame([(117, "ESP", "Spain"), (1, "USA", "States")], "id long, code string, name string")
    star = Star(facts=frame, entities={"countries": codes})
    request = AggregateRequest({"position": "position"}, [], {"country": "ESP"}, "2026-04-01", "2026-04-30")
    assert rows(aggregate(star, request)) == [(99.0,)]


def test_weighted_rows_of_one_grain_count_once(spark, rows):
    frame = facts(
        spark,
        fact("position", 5, "2026-04-01", account=1),
        fact("impressions", 10, "2026-04-01", account=1),
        fact("position", 7, "2026-04-01", account=2),
        fact("impressions", 4, "2026-04-01", account=2),
    )
    request = AggregateRequest({"position": "position"}, [], {}, "2026-04-01", "2026-04-30")
    assert rows(aggregate(Star(facts=frame), request)) == [(7.0,)]


def test_conditional_sum(spark, rows):
    frame = facts(spark, fact("Clicks", 50, "2026-04-01"), fact("spend", 9, "2026-04-01"), fact("clicks", 3, "2026-04-01", period="lifetime"))
    assert rows(aggregate(Star(facts=frame), AggregateRequest({"c": "clicks"}))) == [(50.0,)]
    assert rows(aggregate(Star(facts=frame), AggregateRequest({"r": "reach"}))) == [(0.0,)]


def test_time_weighted_average(spark, rows):
    frame = facts(
        spark,
        fact("avg_time", 5000, "2026-04-01"),
        fact("total_time", 50000, "2026-04-01"),
        fact("avg_time", 10000, "2026-04-02"),
        fact("total_time", 10000, "2026-04-02"),
        fact("avg_time", 3000, "2026-04-01", device=2),
        fact("total_time", 30000, "2026-04-01", device=2),
        fact("avg_time", 0, "2026-04-03"),
        fact("total_time", 777, "2026-04-03"),
    )
    one_device = frame.filter("device_id = 1")
    got = rows(time_weighted_average(one_device, ["avg_time"], ["total_time"], {}, "watch"))
    assert got[0][0] == pytest.approx(60000 / 11)


def test_gap_fill(spark, rows):
    series = spark.createDataFrame([("2026-05-01", 10), ("2026-05-03", 30)], "daily string, clicks long")
    filled = fill_gaps(series, "daily", "daily", "2026-05-01", "2026-05-03", ["clicks"])
    assert rows(filled) == [("2026-05-01", 10), ("2026-05-02", 0), ("2026-05-03", 30)]


def test_gap_fill_by_group(spark, rows):
    series = spark.createDataFrame(
        [("2026-05-01", "female", 1), ("2026-05-03", "female", 2), ("2026-05-01", "male", 3), ("2026-05-02", None, 4)],
        "daily string, gender string, clicks long",
    )
    filled = fill_gaps(series, "daily", "daily", "2026-05-01", "2026-05-03", ["clicks"], ["gender"])
    assert filled.count() == 9
    assert rows(filled.filter("gender = 'male'"), "daily", "clicks") == [("2026-05-01", 3), ("2026-05-02", 0), ("2026-05-03", 0)]
    assert filled.filter("gender IS NULL").agg(F.sum("clicks")).first()[0] == 4


def test_gap_fill_of_nothing(spark):
    empty = spark.createDataFrame([], "daily string, clicks long")
    assert fill_gaps(empty, "daily", "daily", "2026-05-01", "2026-05-03", ["clicks"]).count() == 3


def test_month_fill_from_the_last_day(spark, rows):
    series = spark.createDataFrame([("2026-02", 5)], "monthly string, clicks long")
    filled = fill_gaps(series, "monthly", "monthly", "2026-01-31", "2026-03-31", ["clicks"])
    assert rows(filled) == [("2026-01", 0), ("2026-02", 5), ("2026-03", 0)]


def test_excluded_sets_with_null(spark, rows):
    frame = facts(
        spark,
        fact("clicks", 1, "2026-04-01", dims={}),
        fact("clicks", 2, "2026-04-01", dims={"query": "q"}),
        fact("clicks", 3, "2026-04-01", dims={"age": "18"}),
    )
    assert rows(keep_requested_dimension_sets(frame, [], frame), "value") == [(3.0,)]
    plain = frame.filter("value <> 2")
    assert rows(keep_requested_dimension_sets(plain, [], plain), "value") == [(1.0,), (3.0,)]
    assert rows(keep_requested_dimension_sets(frame, ["query"], frame), "value") == [(2.0,)]


def test_snapshot_delta(spark, rows):
    frame = facts(spark, fact("likes", 10, "2026-04-01", period="lifetime"), fact("likes", 25, "2026-04-05", period="lifetime"))
    delta = snapshot_delta(frame, "2026-04-02", "2026-04-05")
    assert delta.agg(F.sum("value")).first()[0] == 15.0


def test_snapshot_delta_on_one_date_counts_once(spark):
    frame = facts(spark, fact("likes", 10, "2026-04-01", period="lifetime"))
    assert snapshot_delta(frame, "2026-04-02", "2026-04-03").agg(F.sum("value")).first()[0] == 10.0


def test_latest_snapshot_modes(spark, rows):
    frame = facts(
        spark,
        fact("likes", 1, "2026-03-01", period="lifetime", post=1),
        fact("likes", 2, "2026-04-02", period="lifetime", post=2),
        fact("likes", 3, "2026-04-04", period="lifetime", post=2),
        fact("views", 9, "2026-04-02", period="lifetime", post=2),
    )
    span = ("2026-04-01", "2026-04-30")
    assert rows(latest_snapshot(frame, *span, "strict"), "value") == [(3.0,)]
    assert rows(latest_snapshot(frame, *span, "resilient"), "value") == [(1.0,), (3.0,)]


def test_snapshot_metadata(spark):
    result = spark.createDataFrame([(date(2026, 4, 1),), (date(2026, 4, 3),), (None,)], "snapshot_effective_date date")
    meta = snapshot_metadata(result, "2026-04-01", "2026-04-03", "resilient").first()
    assert meta["effective_end_dates"] == ["2026-04-01", "2026-04-03"]
    assert meta["fallback_end_dates"] == ["2026-04-01"]
    assert meta["requested_start_date"] == "2026-04-01"


def test_snapshot_flags_exclude_each_other(spark):
    frame = facts(spark, fact("likes", 1, "2026-03-01"))
    with pytest.raises(ValueError):
        aggregate(Star(facts=frame), AggregateRequest({"likes": "likes"}, [], {"latest_snapshot": 1, "snapshot_delta": 1}))


def test_daily_from_lifetime(spark, rows):
    schema = "name string, period string, metric_date date, value double, signature string"
    stored = spark.createDataFrame([("s", date(2023, 1, 1), 80.0)], "signature string, metric_date date, value double")
    batch = spark.createDataFrame(
        [("clicks", "lifetime", date(2023, 1, 2), 100.0, "s"), ("likes", "lifetime", date(2023, 1, 3), 40.0, "s"), ("x", "daily", date(2023, 1, 2), 1.0, "x")],
        schema,
    )
    out = daily_from_lifetime(batch, stored)
    assert out.count() == 5
    assert rows(out.filter("name LIKE '%_daily'"), "name", "period", "value") == [("clicks_daily", "daily", 20.0), ("likes_daily", "daily", 40.0)]


def test_partial_merge(spark):
    partial = spark.createDataFrame([(1, 100.0, 10.0, 2.0, 1), (1, 300.0, 20.0, 6.0, 1)], "k int, impressions double, clicks double, position double, count long")
    row = merge_search_partials(partial, ["k"]).first()
    assert (row["impressions"], row["clicks"], row["ctr"], row["position"], row["count"]) == (400.0, 30.0, 0.075, 5.0, 2)


def test_raw_value_is_refused(spark):
    with pytest.raises(ValueError):
        aggregate(Star(facts=facts(spark, fact("clicks", 1, "2026-04-01"))), AggregateRequest({"v": "SUM(value)"}))


def test_page_level_scope(spark, rows):
    frame = facts(
        spark,
        fact("likes", 1, "2026-04-01", channel="facebook_organic", dims={}),
        fact("likes", 2, "2026-04-01", channel="facebook_organic", post=4, dims={}),
        fact("likes", 4, "2026-04-01", channel="facebook_organic", dims={"age": "18"}),
    )
    ask = lambda groups, **filters: aggregate(
        Star(facts=frame), AggregateRequest({"likes": "likes"}, groups, {"channel": "facebook_organic", "period": "daily", **filters})
    )
    assert rows(ask([])) == [(1.0,)]
    assert rows(ask(["age"])) == [("18", 4.0), ("unknown", 1.0)]
    assert rows(ask(["post_id"]), "likes") == [(2.0,), (5.0,)]
    assert rows(ask([], **{"dimensions.age": "18"})) == [(4.0,)]


def test_time_weighted_average_from_a_request(spark, rows):
    frame = facts(
        spark,
        fact("ig_reels_avg_watch_time_daily", 5000, "2026-04-01"), fact("ig_reels_video_view_total_time_daily", 50000, "2026-04-01"),
        fact("ig_reels_avg_watch_time_daily", 10000, "2026-04-02"), fact("ig_reels_video_view_total_time_daily", 10000, "2026-04-02"),
        fact("ig_reels_avg_watch_time_daily", 3000, "2026-04-02", device=2), fact("ig_reels_video_view_total_time_daily", 30000, "2026-04-02", device=2),
    )
    ask = AggregateRequest({"t": "ig_reels_avg_watch_time_daily", "total": "ig_reels_video_view_total_time_daily"}, [], {"device_id": 1}, "2026-04-01", "2026-04-30")
    ((t, total),) = rows(aggregate(Star(facts=frame), ask))
    assert abs(t - 60000 / 11) < 1e-3 and total == 60000.0
    daily = AggregateRequest({"t": "ig_reels_avg_watch_time"}, ["daily"], {"device_id": 1})
    assert rows(aggregate(Star(facts=frame), daily)) == [(date(2026, 4, 1), 5000.0), (date(2026, 4, 2), 10000.0)]


def test_campaign_status_from_a_request(spark, rows):
    frame = facts(spark, fact("clicks", 1, "2026-04-01"), fact("clicks", 2, "2026-04-01", country=2)).withColumn("channeled_campaign_id", F.col("country_id") + 10)
    campaigns = spark.createDataFrame([(11, "PAUSED"), (12, "ACTIVE")], "id long, status string")
    star = Star(facts=frame, entities={"channeled_campaigns": campaigns})
    measures = {"status": "campaign_status", "clicks": "clicks"}
    assert rows(aggregate(star, AggregateRequest(measures))) == [("ACTIVE", 3.0)]
    assert rows(aggregate(star, AggregateRequest(measures, ["country_id"]))) == [(1, "PAUSED", 1.0), (2, "ACTIVE", 2.0)]


def test_months_prune_inside_requests(spark, folder, tmp_path):
    from tidemark.sources import files

    facts_by_month = T.search_facts(spark, folder).withColumn("metric_config_id", F.xxhash64("name", "page_id", "query_id"))
    files.write_facts(facts_by_month, str(tmp_path / "facts"))
    stored = Star(facts=spark.read.parquet(str(tmp_path / "facts")), entities=T.entities(spark, folder))
    for measures in ({"clicks": "clicks"}, {"position": "position"}):
        request = AggregateRequest(measures, ["monthly"], {}, "1998-03-31", "1998-04-28")
        plan = aggregate(stored, request)._jdf.queryExecution().executedPlan().toString()
        assert any("month#" in x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]), plan
        assert sorted(map(str, aggregate(stored, request).collect())) == sorted(map(str, aggregate(Star(facts=facts_by_month), request).collect()))


@pytest.mark.parametrize("limit", ["10MB", "-1"])
@pytest.mark.parametrize("groups", [[], ["yearly"], ["channel"], ["daily"], ["account", "monthly"]])
def test_size_changes_no_result(spark, folder, rows, groups, limit):
    """Totals over nothing, expressions over facts and groups: alike whatever is broadcast."""
    normal = T.normal_event_star(spark, folder)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        nothing = aggregate(normal, AggregateRequest({"clicks": "clicks"}, groups, {}, "1990-01-01", "1990-01-31"))
        assert rows(nothing) == ([] if groups else [(0.0,)])
        mixed = rows(aggregate(normal, AggregateRequest({"n": "COUNT(metric_config_id)", "last": "MAX(metric_date)", "clicks": "clicks"}, groups, {}, "2024-01-03", "2024-01-25")))
        joined = Star(facts=normal.frame(), entities=normal.entities)
        assert mixed == rows(aggregate(joined, AggregateRequest({"n": "COUNT(metric_config_id)", "last": "MAX(metric_date)", "clicks": "clicks"}, groups, {}, "2024-01-03", "2024-01-25")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("groups", [[], ["yearly"], ["weekly", "k"], ["account", "monthly"], ["dayofweek"]])
def test_summing_before_the_config_join_changes_nothing(spark, folder, rows, no_broadcast, groups):
    normal, joined = T.normal_event_star(spark, folder), T.event_star(spark, folder)
    measures = {"clicks": "clicks", "ctr": "ctr", "cpc": "cpc", "roas": "purchase_roas"}
    request = AggregateRequest(measures, groups, {"channeled_account_id": {"operator": "neq", "value": 3}}, "2024-01-03", "2024-01-25")
    relations = {k: v for k, v in joined.relations.items() if k != "channeled_account_id"}
    from dataclasses import replace

    left = aggregate(replace(normal, relations=relations), request)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "value_sum" in plan
    right = aggregate(replace(joined, relations=relations), request)
    rounded = lambda df: rows(df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]))
    assert rounded(left) == rounded(right)


def test_groups_by_day_join_configs_at_once(spark, folder, no_broadcast):
    request = AggregateRequest({"clicks": "clicks"}, ["daily"], {}, "2024-01-03", "2024-01-25")
    plan = aggregate(T.normal_event_star(spark, folder), request)._jdf.queryExecution().optimizedPlan().toString()
    assert "value_sum" not in plan


def test_dates_reach_the_scan(spark, folder):
    frame = filtered_facts(T.event_star(spark, folder), AggregateRequest({}, [], {}, "2024-01-10", "2024-01-12"))
    plan = frame.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-10" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_ordering_ignores_unknown_names(spark):
    frame = facts(spark, fact("clicks", 1, "2026-04-01"), fact("clicks", 5, "2026-04-02"))
    ask = lambda by, way="ASC": [
        r["c"] for r in aggregate(Star(facts=frame), AggregateRequest({"c": "clicks"}, ["daily"], {}, order_by=by, order_dir=way)).collect()
    ]
    assert ask("C", "desc") == [5.0, 1.0]
    assert ask("DAILY") == [1.0, 5.0]
    assert sorted(ask("nothing")) == [1.0, 5.0]


def test_snapshot_dates_ignore_filters_beyond_the_context(spark, rows):
    """A metric absent on the context's last date adds nothing, though it has older facts."""
    frame = facts(
        spark,
        fact("likes", 3, "2026-04-01", period="lifetime", post=1),
        fact("views", 9, "2026-04-02", period="lifetime", post=1),
        fact("likes", 5, "2026-04-03", period="lifetime", post=2),
    )
    filters = {"latest_snapshot": True, "name": "likes", "period": "lifetime"}
    ask = AggregateRequest({"likes": "likes"}, ["post_id"], filters, "2026-04-01", "2026-04-30")
    assert rows(aggregate(Star(facts=frame), ask), "post_id", "likes") == [(2, 5.0)]
    one_post = AggregateRequest({"likes": "likes"}, ["post_id"], {**filters, "post_id": 2}, "2026-04-01", "2026-04-30")
    assert rows(aggregate(Star(facts=frame), one_post), "post_id", "likes") == [(2, 5.0)]


@pytest.mark.parametrize("groups", [["account_type"], ["account_type", "weekly", "k"], ["account_type", "daily", "month"], ["account.data.platform_id", "account_id"]])
def test_attribute_groups_sum_by_key_first(spark, folder, rows, groups, monkeypatch):
    from tidemark.plans import request as R

    star = T.event_star(spark, folder)
    request = AggregateRequest({m: m for m in ("clicks", "ctr", "spend", "purchase_roas")}, groups, {}, "2024-01-03", "2024-01-25")
    rounded = lambda df: rows(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]))
    reduced = aggregate(star, request)
    assert "value_sum" in reduced._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(R, "_joins_first", lambda name, star: False)
    assert rounded(reduced) == rounded(aggregate(star, request))


def test_weighted_groups_with_one_label_merge(spark, rows):
    frame = facts(
        spark,
        *[f for q, p, w in ((1, 2, 10), (2, 4, 30), (3, 9, 5)) for f in (fact("position", p, "2026-04-01", query=q), fact("impressions", w, "2026-04-01", query=q))],
    )
    queries = spark.createDataFrame([(1, "shoes"), (2, "shoes")], "id long, query string")
    star = Star(facts=frame, entities={"queries": queries})
    measures = {"position": "position", "impressions": "impressions"}
    assert rows(aggregate(star, AggregateRequest(measures, ["query"]))) == [("N/A", 9.0, 5.0), ("shoes", 3.5, 40.0)]
    by_key = aggregate(star, AggregateRequest(measures, ["query", "query_id"]))
    assert rows(by_key, "query", "query_id", "position") == [("N/A", 3, 9.0), ("shoes", 1, 2.0), ("shoes", 2, 4.0)]
