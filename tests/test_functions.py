"""Filters, dates, text and keys."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import conditions as C
from tidemark.functions import dates as D
from tidemark.functions import formulas as M
from tidemark.functions import keys as K
from tidemark.functions import text as X


@pytest.mark.parametrize(
    ("raw", "operator", "value"),
    [
        (5, "eq", 5),
        ("abc", "eq", "abc"),
        (" N/A ", "is_null", None),
        ("NULL", "is_null", None),
        ("NOT_NULL", "is_not_null", None),
        ("!= x", "neq", "x"),
        ([1, 2], "in", [1, 2]),
        ({"operator": "NE", "value": 3}, "neq", 3),
        ({"operator": "not_equal", "value": 3}, "neq", 3),
        ({"operator": "in", "value": 3}, "in", [3]),
        ({"operator": "not_in", "value": [3]}, "not_in", [3]),
        ({"operator": "like", "value": "a%"}, "like", "a%"),
        ({"operator": "null"}, "is_null", None),
        ({"operator": "weird", "value": 1}, "eq", 1),
    ],
)
def test_condition_spellings(raw, operator, value):
    assert C.parse_condition(raw) == C.Condition(operator, value)


def test_predicates_follow_sql_nulls(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    keep = lambda raw: [r[0] for r in rows(df.filter(C.predicate(F.col("v"), raw)))]
    assert keep("a") == ["a"]
    assert keep("!=a") == ["b"]
    assert keep([]) == []
    assert keep({"operator": "not_in", "value": ["a"]}) == ["b"]
    assert keep("N/A") == [None]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("12_34", True), ("2147483648", True), ("2147483647", False), (["1", "x"], True), ("N/A", False), ("007", False)],
)
def test_platform_post_ids(raw, expected):
    assert C.is_platform_post_id(raw) is expected


def test_sentinel_lists():
    assert C.has_no_numeric_member(["__none__"])
    assert not C.has_no_numeric_member(["x", "3"])
    assert not C.has_no_numeric_member("x")


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("grain", "label"),
    [("daily", "2024-12-30"), ("weekly", "2025-W01"), ("monthly", "2024-12"), ("quarterly", "2024-Q4"), ("yearly", "2024")],
)
def test_grain_labels(spark, grain, label):
    assert _one(spark, D.grain_label(F.lit(date(2024, 12, 30)), grain)) == label
    assert _one(spark, D.grain_label(D.grain_start(F.lit(date(2024, 12, 30)), grain), grain)) == label


def test_date_parts(spark):
    sunday = F.lit(date(2024, 3, 3))
    assert _one(spark, D.date_part(sunday, "dayofweek")) == 0
    assert _one(spark, D.date_part(sunday, "dayname")) == "Sunday"
    assert _one(spark, D.date_part(sunday, "monthname")) == "March"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-05-01", "2024-05-01"),
        ("today", "2024-03-31"),
        ("yesterday", "2024-03-30"),
        ("-3 days", "2024-03-28"),
        ("+1 week", "2024-04-07"),
        ("2 days ago", "2024-03-29"),
        ("-1 month", "2024-03-02"),
        ("rubbish", "rubbish"),
    ],
)
def test_relative_dates(text, expected):
    assert D.resolve_relative(text, date(2024, 3, 31)) == expected


@pytest.mark.parametrize(("human", "iso"), [("3 years", "P3Y"), ("1 month", "P1M"), ("5 Minutes", "PT5M"), ("P3Y", "p3y")])
def test_intervals(human, iso):
    assert D.iso_interval(human) == iso


def test_chunks_cover_the_range(spark):
    chunks = _one(spark, D.chunk_starts(F.lit(date(2024, 1, 1)), F.lit(date(2024, 1, 10)), "1 week"))
    assert [(c["start"].day, c["end"].day) for c in chunks] == [(1, 7), (8, 10)]
    assert _one(spark, D.chunk_starts(F.lit(date(2024, 1, 2)), F.lit(date(2024, 1, 1)), "1 week")) == []


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("12.5", 12.5), ('[{"value": "7"}]', 7.0), ('[{"amount": 3}]', 3.0), ('{"value": 4}', 4.0), ("x", 0.0), ("[]", 0.0), (None, 0.0)],
)
def test_value_coercion(spark, raw, expected):
    assert _one(spark, X.coerce_value(F.lit(raw).cast("string"))) == expected


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://a.example/es/?g=1", "/es/"),
        ("https://a.example", "/"),
        ("a-b.com/x?y", "/x"),
        ("/es/?q=1", "/es/"),
        ("plain", "plain"),
    ],
)
def test_url_keys(spark, url, key):
    assert _one(spark, X.url_key(F.lit(url))) == key


@pytest.mark.parametrize(("url", "domain"), [("https://www.A-b.com/x", "A-b.com"), ("http://x", None), ("shop.example.org?x", "shop.example.org")])
def test_domains(spark, url, domain):
    assert _one(spark, X.domain_of(F.lit(url))) == domain


def test_country_codes(spark, rows):
    df = spark.createDataFrame([("es",), ("US",), ("??",)], "c string")
    assert rows(X.with_alpha3(df, "c", "a3")) == [("??", None), ("US", "USA"), ("es", "ESP")]
    assert X.country_codes(spark).count() >= 249


def test_keys_are_stable(spark):
    dims = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert _one(spark, K.dimensions_hash(dims(a="1", b="2"))) == _one(spark, K.dimensions_hash(dims(b="2", a="1")))
    assert _one(spark, K.dimensions_hash(dims(a="1"))) != _one(spark, K.dimensions_hash(dims(a="2")))
    sign = lambda **kw: _one(spark, K.config_signature({k: F.lit(v) for k, v in kw.items()}))
    assert sign(channel="x", name="clicks") == sign(name="clicks", channel="x", page=None)
    assert sign(channel="x", name="clicks") != sign(channel="x", name="spend")
    assert sign(channel="x", page=5) == sign(channel="x", page="5")
    assert len(sign(channel="x")) == 32
    with pytest.raises(ValueError):
        sign(colour="red")


def test_dictionaries():
    built_in = M.MetricDictionary()
    assert built_in.raw_names("conversions") == (["results", "results_daily"], "default")
    assert built_in.resolve("results")["canonical_metric"] == "conversions"
    assert built_in.resolve("cost_per_result")["canonical_metric"] == "cost_per_conversion"
    assert built_in.resolve("actions")["deprecation"] == "ambiguous_metric_alias"
    assert built_in.raw_names("sessions") == ([], "none")
    assert built_in.raw_names("position", None, "search") == (["position"], "default")
    custom = M.MetricDictionary(
        overrides={"shop": {"conversions": "orders"}, "__default__": {"reach": ["people"]}},
        drivers={"shop": {"conversions": ["sales"], "sessions": ["visits"]}},
    )
    assert custom.raw_names("conversions", "Shop") == (["orders"], "override")
    assert custom.raw_names("sessions", "shop") == (["visits"], "driver")
    assert custom.raw_names("reach", "shop") == (["people"], "override")
    assert custom.raw_names("reach") == (["people"], "override")


def test_raw_values_are_refused():
    for text in ("value", "SUM(m.value)", "sum( value )"):
        with pytest.raises(ValueError):
            M.refuse_raw_value(text)
    M.refuse_raw_value("clicks")


def test_expressions_are_checked(spark):
    assert M.aggregate_expression("SUM(total_price) / COUNT(id)", ["total_price", "id"]) is not None
    assert M.aggregate_expression("SUM(data.total) / COUNT(id)", ["data", "id"]) is not None
    for text in ("SUM(secret)", "SUM(data.total)", "reflect('a')", "SUM(total_price); DROP"):
        with pytest.raises(ValueError):
            M.aggregate_expression(text, ["total_price"])


def test_next_evaluation(spark):
    def plan(schedule, time_of_day="08:00", weekday=1, now="2024-01-31 09:30:00"):
        moment = F.lit(now).cast("timestamp")
        return str(_one(spark, D.next_evaluation(moment, F.lit(schedule), F.lit(time_of_day), F.lit(weekday)).cast("string")))

    assert plan("daily") == "2024-02-01 08:00:00"
    assert plan("daily", "10:15") == "2024-01-31 10:15:00"
    assert plan("weekly", weekday=3) == "2024-02-07 08:00:00"
    assert plan("weekly", weekday=4) == "2024-02-01 08:00:00"
    assert plan("biweekly", weekday=7) == "2024-02-11 08:00:00"
    assert plan("monthly") == "2024-03-02 08:00:00"
    assert plan("once") == "None"


def test_patterns(spark, rows):
    df = spark.createDataFrame([("Alpha",), ("beta",), ("alphabet",)], "v string")
    keep = lambda *a: [r[0] for r in rows(df.filter(C.matches_patterns(F.col("v"), *a)))]
    assert keep("ALPHA") == ["Alpha", "alphabet"]
    assert keep("/^a/") == ["alphabet"]
    assert keep(None, ["bet"]) == ["Alpha"]
    assert keep(["alpha", "beta"], "/t$/") == ["Alpha", "beta"]
