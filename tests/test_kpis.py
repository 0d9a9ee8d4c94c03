"""KPI trees, alerts, series preparation and statistics."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import AggregateRequest, Star, aggregate
from tidemark.operators import series as S
from tidemark.operators import stats
from tidemark.operators.rank import best_per_group, oldest_and_newest
from tidemark.plans import alerts as A
from tidemark.plans import kpi as P
from test_requests import FACTS, fact


def metric(name, **filters):
    return {"type": "metric", "metric": name, "filters": filters}


def op(operator, left, right):
    return {"type": "operator", "operator": operator, "left": left, "right": right}


def value(number):
    return {"type": "value", "value": number}


def star(spark, *listed):
    return Star(facts=spark.createDataFrame(list(listed), FACTS))


def test_scalars(spark, rows):
    assert rows(P.evaluate_kpi(star(spark), op("+", value(10), value(5)))) == [(15.0,)]


@pytest.mark.parametrize(
    ("operator", "left", "right", "expected"),
    [
        ("/", 4, 0, 0.0),
        ("ratio", 3, 1, 0.75),
        ("ratio", 1, -1, 0.0),
        ("avg", 3, 4, 3.5),
        ("min", 3, 4, 3.0),
        ("max", 3, 4, 4.0),
        ("abs_diff", 3, 4, 1.0),
        ("pct_change", 3, -2, 250.0),
        ("pct_change", 3, 0, 0.0),
        ("*", 3, 4, 12.0),
        ("-", 3, 4, -1.0),
    ],
)
def test_operators(spark, rows, operator, left, right, expected):
    assert rows(P.evaluate_kpi(star(spark), op(operator, value(left), value(right)))) == [(expected,)]


def test_unknown_nodes_are_refused(spark):
    with pytest.raises(ValueError):
        P.parse_tree({"type": "operator", "operator": "^", "left": value(1), "right": value(2)})
    with pytest.raises(ValueError):
        P.parse_tree('{"type": "mystery"}')
    with pytest.raises(ValueError):
        P.inline_derived({"type": "derived_metric", "derived_metric_id": 9}, {})


def test_series_add(spark, rows):
    facts = star(
        spark,
        fact("clicks", 100, "2026-01-01", channel="a"),
        fact("clicks", 150, "2026-01-02", channel="a"),
        fact("clicks", 200, "2026-01-01", channel="b"),
        fact("clicks", 250, "2026-01-02", channel="b"),
        fact("clicks", 50, "2026-01-03", channel="b"),
    )
    got = P.evaluate_kpi(facts, op("+", metric("a.clicks"), metric("b.clicks")), group_by="daily")
    assert rows(got) == [(date(2026, 1, 1), 300.0), (date(2026, 1, 2), 400.0), (date(2026, 1, 3), 50.0)]
    # A number joins the keys of its own series only.
    shifted = op("+", op("+", metric("a.clicks"), value(1000)), metric("b.clicks"))
    assert rows(P.evaluate_kpi(facts, shifted, group_by="daily"))[2] == (date(2026, 1, 3), 50.0)


def test_return_on_spend(spark, rows):
    facts = star(
        spark,
        fact("total_revenue", 1000, "2026-01-01", channel="shop"),
        fact("total_revenue", 1500, "2026-01-02", channel="shop"),
        fact("spend", 100, "2026-01-01", channel="x"),
        fact("spend", 200, "2026-01-02", channel="x"),
        fact("spend", 150, "2026-01-01", channel="y"),
        fact("spend", 300, "2026-01-02", channel="y"),
    )
    tree = op("/", metric("shop.total_revenue"), op("+", metric("x.spend"), metric("y.spend")))
    assert [r[1] for r in rows(P.evaluate_kpi(facts, tree, group_by="daily"))] == [4.0, 3.0]
    scaled = op("*", metric("shop.total_revenue"), value(1.2))
    assert rows(P.evaluate_kpi(facts, scaled, "2026-01-01", "2026-01-01", "daily")) == [(date(2026, 1, 1), 1200.0)]


def test_one_read_for_many_leaves(spark):
    facts = star(spark, fact("clicks", 1, "2026-01-01", channel="a"))
    tree = op("+", op("-", metric("a.clicks"), metric("b.clicks")), op("*", metric("a.clicks", page=4), metric("a.spend")))
    plan = P.evaluate_kpi(facts, tree, group_by="daily")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 4  # three batches of leaves, and their alignment
    assert "Join" not in plan


@pytest.mark.parametrize("group", [None, "country", "page", "daily", "weekly"])
@pytest.mark.parametrize("filters", [{}, {"country": "ESP"}, {"country": ["USA", "N/A"]}, {"page": 3}, {"dimensions.searchAppearance": "standard"}])
@pytest.mark.parametrize("name", ["clicks", "position", "ctr"])
def test_one_leaf_equals_its_request(spark, rows, group, filters, name):
    listed = [
        fact(n, v, d, country=c, page=p)
        for n, v, d, c, p in (
            ("clicks", 5, "2026-01-01", 117, 3), ("impressions", 10, "2026-01-01", 117, 3), ("position", 9, "2026-01-01", 117, 3),
            ("clicks", 7, "2026-01-02", 1, 4), ("impressions", 30, "2026-01-02", 1, 4), ("position", 3, "2026-01-02", 1, 4), ("clicks", 2, "2026-01-09", None, 4),
        )
    ]
    codes = spark.createDataFrame([(117, "ESP", "Spain"), (1, "USA", "States")], "id long, code string, name string")
    pages = spark.createDataFrame([(3, "a"), (4, "b")], "id long, url string")
    base = star(spark, *listed)
    known = Star(facts=base.facts, entities={"countries": codes, "pages": pages})
    asked = aggregate(known, AggregateRequest({"m": name}, [group] if group else [], {**filters, "channel": "search"}, "2026-01-01", "2026-01-31"))
    want = sorted((tuple([r[group]] if group else []) + (r.m or 0.0,) for r in asked.collect()), key=repr)
    got = P.evaluate_kpi(known, metric(f"search.{name}", **filters), "2026-01-01", "2026-01-31", group)
    assert rows(got) == want


def test_alert_lines_evaluate_their_trees(spark, rows):
    known = star(spark, fact("spend", 1000, "2026-01-01", channel="x", account=1), fact("spend", 500, "2026-01-02", channel="x", account=1), fact("spend", 9, "2026-01-02", channel="x", account=2))
    tree = metric("x.spend")
    lines = [{"alert_id": 1, "line_id": 1, "tree": tree, "filters": {"channeled_account_id": 1}}, {"alert_id": 1, "line_id": 2, "tree": tree, "filters": {"channeled_account_id": 2}}]
    alerts = spark.createDataFrame([(1, 1, "sum", 1000.0, None), (1, 2, "sum", 1000.0, None)], "alert_id long, line_id long, aggregation_method string, upper_limit double, lower_limit double")
    got = A.evaluate_alerts(alerts, A.alert_series(known, lines))
    assert rows(got, "line_id", "evaluated_value", "status") == [(1, 1500.0, "triggered"), (2, 9.0, "ok")]


FILTER_SETS = [{}, {"channeled_account_id": 1}, {"channeled_account_id": 2}, {"page": 4}, {"period": "daily", "page": 3}]


def _watched():
    """50 lines over five filter sets, with several trees and metrics that are answered apart."""
    trees = [
        metric("x.spend"), metric("x.clicks"), op("/", metric("x.spend"), metric("x.clicks")), op("-", metric("x.clicks"), value(3)),
        op("+", metric("x.spend"), metric("x.results")), metric("x.impressions"), op("max", metric("x.results"), metric("x.clicks")),
        op("abs_diff", metric("x.results"), metric("x.spend")), metric("x.results"), value(7),
    ]
    return [{"alert_id": k, "line_id": n, "tree": tree, "filters": FILTER_SETS[k % 5]} for n, tree in enumerate(trees) for k in range(5)]


@pytest.mark.parametrize("group", ["daily", "page"])
def test_shared_leaves_change_no_line(spark, rows, group):
    listed = [
        fact(n, v, d, channel="x", account=a, page=p, country=c)
        for n, v, d, a, p, c in (
            ("spend", 10, "2026-01-01", 1, 4, 117), ("clicks", 4, "2026-01-01", 1, 4, 117), ("clicks", 6, "2026-01-02", 2, 3, 1),
            ("spend", 5, "2026-01-03", 2, 4, None), ("results", 2, "2026-01-03", 1, 3, 117), ("impressions", 50, "2026-01-04", 2, 3, 117), ("position", 3, "2026-01-04", 2, 3, 117),
        )
    ]
    pages = spark.createDataFrame([(3, "a"), (4, "a")], "id long, url string")
    known = Star(facts=star(spark, *listed).facts, entities={"pages": pages})
    lines = [*_watched(), {"alert_id": 9, "line_id": 0, "tree": op("+", metric("x.position"), metric("x.clicks"))}]
    got = A.alert_series(known, lines, "2026-01-01", "2026-01-31", group)
    want = []
    checked = lines[::4]  # of all filter sets and shapes
    for line in checked:
        alone = P.evaluate_kpi(known, line["tree"], "2026-01-01", "2026-01-31", group, line.get("filters"))
        want += [(line["alert_id"], line["line_id"], *((r.key, r.value) if "key" in alone.columns else (None, r.value))) for r in alone.collect()]
    asked = {(line["alert_id"], line["line_id"]) for line in checked}
    assert [r for r in rows(got) if r[:2] in asked] == sorted(want, key=repr) and want


def test_fifty_lines_over_five_filter_sets_read_the_facts_five_times(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.createDataFrame([fact("spend", 10, "2026-01-01", channel="x")], FACTS).write.parquet(path)
    series = A.alert_series(Star(facts=spark.read.parquet(path)), _watched(), group_by="daily")
    plan = series._jdf.queryExecution().optimizedPlan().toString()
    assert len(_watched()) == 50 and plan.count("Relation [") <= 5


def _alert(spark, rows, method, points, upper=None, lower=None):
    alerts = spark.createDataFrame([(1, 1, method, upper, lower)], "alert_id long, line_id long, aggregation_method string, upper_limit double, lower_limit double")
    series = spark.createDataFrame([(1, 1, k, v) for k, v in points], "alert_id long, line_id long, key string, value double")
    return rows(A.evaluate_alerts(alerts, series), "evaluated_value", "status", "threshold_type", "threshold_value")[0]


def test_alerts(spark, rows):
    points = [("2026-01-02", 1500.0), ("2026-01-01", 10.0)]
    assert _alert(spark, rows, None, points, upper=1000.0) == (1500.0, "triggered", "upper", 1000.0)
    assert _alert(spark, rows, "min", points, 1000.0, 20.0) == (10.0, "triggered", "lower", 20.0)
    assert _alert(spark, rows, "sum", points) == (1510.0, "ok", None, None)
    assert _alert(spark, rows, "latest", [], lower=1.0) == (0.0, "triggered", "lower", 1.0)


def pairs(spark, y, x, series="s"):
    return spark.createDataFrame([(series, i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "series string, key long, y double, x double")


def test_zero_handling(spark):
    points = pairs(spark, [0, 1, 0, 2, 0], [0, 1, 0, 0, 0])
    assert [S.handle_zeros(points, m).count() for m in ("keep", "trim", "remove")] == [5, 3, 1]
    assert S.handle_zeros(pairs(spark, [0, 0], [0, 0]), "trim").count() == 0


def test_tail_grouping(spark, rows):
    points = pairs(spark, [10, 20, 30, 40, 50, 60, 70, 80], [2, 1, 3, 4, 5, 6, 7, 8])
    grouped = S.group_tail(points, 25)
    assert grouped.count() == 7
    assert rows(grouped.filter("key = 'others'"), "y", "x") == [(15.0, 1.5)]
    assert S.group_tail(pairs(spark, [1, 2], [1, 2]), 50).filter("key = 'others'").count() == 0
    # A point that is itself called "others" stays its own point.
    named = points.withColumn("key", F.when(F.col("key") == 7, "others").otherwise(F.col("key").cast("string")))
    assert S.group_tail(named, 25).filter("key = 'others'").count() == 2


def test_guards(spark, rows):
    reason = lambda y, x: rows(S.guard(pairs(spark, y, x)), "reason")[0][0]
    assert reason([1, 2, 3], [5, 5, 5]) == "constant_x"
    assert reason([5, 5, 5], [1, 2, 3]) == "constant_y"
    assert reason([1], [1]) == "too_few_points"
    assert reason([1, 2], [1, 2]) is None


def test_tail_of_one_big_series(spark, rows, monkeypatch):
    """Cut by sketch and by order alike, with ties, and whatever the length."""
    points = [("big", f"k{i:05}", float(i), float(i * 7919 % 50)) for i in range(3000)] + [("small", f"k{i}", float(i), float(-i)) for i in range(8)]
    df = spark.createDataFrame(points, "series string, key string, y double, x double")
    exact = rows(S.group_tail(df, 25))
    assert sum(r[0] == "big" for r in exact) == 2251 and sum(r[0] == "small" for r in exact) == 7
    low = sorted((x, k, y) for s, k, y, x in points if s == "big")[:750]
    others = next(r for r in exact if r[:2] == ("big", "others"))
    assert abs(others[2] - sum(y for _, _, y in low) / 750) < 1e-9
    monkeypatch.setattr(S, "SKETCH", 1000)
    assert rows(S.group_tail(df, 25)) == exact


def test_best_and_samples(spark, rows):
    df = spark.range(20).select((F.col("id") % 2).alias("g"), "id")
    assert rows(best_per_group(df, ["g"], [F.col("id").desc()], 2)) == [(0, 16), (0, 18), (1, 17), (1, 19)]
    plan = best_per_group(df, ["g"], [F.col("id").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before the shuffle, once after
    assert oldest_and_newest(df, ["g"], "id", 2).count() == 8
    assert oldest_and_newest(df, ["g"], "id", 50).count() == 20


def days(spark, values, series="s"):
    start = date(2024, 1, 1)
    return spark.createDataFrame([(series, start + timedelta(i), float(v)) for i, v in enumerate(values)], "series string, key date, value double")


def ordered(df, column):
    return [r[column] for r in df.orderBy("key").collect()]


VALUES = [5, 7, 6, 9, 12, 8, 10, 15, 11, 13, 12, 18, 14, 16, 21, 17, 15, 22, 19, 20, 24, 18]


def test_exponential_average(spark):
    alpha, want = 2 / 8, [VALUES[0]]
    for v in VALUES[1:]:
        want.append(alpha * v + (1 - alpha) * want[-1])
    assert ordered(stats.exponential_average(days(spark, VALUES), 7), "ema") == pytest.approx(want)


def test_moving_average_and_trend(spark):
    got = ordered(stats.moving_average(days(spark, VALUES), 3), "sma")
    assert got[:3] == pytest.approx([5, 6, 6]) and got[-1] == pytest.approx(np.mean(VALUES[-3:]))
    slope, intercept = np.polyfit(range(len(VALUES)), VALUES, 1)
    row = stats.trend(days(spark, VALUES)).first()
    assert (row["slope"], row["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


def test_regression_and_elasticity(spark):
    x = np.arange(1, 11)
    row = stats.regression(pairs(spark, 3 * x + 2, x)).first()
    assert (row["slope"], row["intercept"], row["r2"]) == (pytest.approx(3), pytest.approx(2), pytest.approx(1))
    assert stats.elasticity(pairs(spark, 4 * x**1.5, x)).first()["elasticity"] == pytest.approx(1.5)


def test_granger_against_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60)
    y = np.zeros(60)
    for i in range(1, 60):
        y[i] = 0.4 * y[i - 1] + 0.8 * x[i - 1] + 0.3 * rng.normal()
    start = date(2024, 1, 1)
    df = spark.createDataFrame([("s", start + timedelta(i), float(y[i]), float(x[i])) for i in range(60)], "series string, key date, y double, x double")
    row = stats.granger(df).first()
    target, own, other = y[1:], y[:-1], x[:-1]
    one = np.ones(59)
    full = np.linalg.lstsq(np.column_stack([one, own, other]), target, rcond=None)
    short = np.linalg.lstsq(np.column_stack([one, own]), target, rcond=None)
    want = (short[1][0] - full[1][0]) / (full[1][0] / (59 - 3))
    assert row["points"] == 59
    assert row["lag_effect"] == pytest.approx(full[0][2])
    assert row["f_statistic"] == pytest.approx(want)


def test_autocorrelation_and_anomalies(spark):
    rows_ = {r["lag"]: r["correlation"] for r in stats.autocorrelation(days(spark, VALUES), 3).collect()}
    assert rows_[2] == pytest.approx(np.corrcoef(VALUES[2:], VALUES[:-2])[0, 1])
    flagged = stats.anomalies(days(spark, [1.0] * 20 + [50.0]), 3).filter("is_anomaly").collect()
    assert [r["value"] for r in flagged] == [50.0]
    assert stats.anomalies(days(spark, [2.0, 2.0])).filter("is_anomaly").count() == 0


def test_holt_winters(spark):
    m, a, b, g = 7, 0.5, 0.3, 0.2
    level, trend = np.mean(VALUES[:m]), (np.mean(VALUES[m : 2 * m]) - np.mean(VALUES[:m])) / m
    season, want = [v - level for v in VALUES[:m]], []
    for i, v in enumerate(VALUES):
        s = season[i % m]
        want.append(level + trend + s)
        new = a * (v - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[i % m] = g * (v - new) + (1 - g) * s
        level = new
    assert ordered(stats.holt_winters(days(spark, VALUES)), "fit") == pytest.approx(want)
    assert len(ordered(stats.holt_winters(days(spark, [3, 4, 5])), "fit")) == 3


def test_macd_settles_on_a_constant(spark):
    got = ordered(stats.macd(days(spark, [4.0] * 10)), "histogram")
    assert got == pytest.approx([0.0] * 10)


def test_ordered_statistics_need_dates(spark):
    with pytest.raises(TypeError):
        stats.moving_average(spark.createDataFrame([("s", "a", 1.0)], "series string, key string, value double"))


def test_assets_by_plain_and_hashed_id(spark, rows):
    import hashlib

    accounts = spark.createDataFrame([(1, "ads", "p1"), (2, "ads", hashlib.md5(b"p2").hexdigest()), (3, "web", "p3")], "id long, channel string, platform_id string")
    assets = spark.createDataFrame([("ads", "p1"), ("ads", " p2 "), ("ads", "p3")], "channel string, asset_platform_id string")
    assert rows(P.resolve_assets(assets, accounts), "channeled_account_id") == [(1,), (2,), (None,)]
