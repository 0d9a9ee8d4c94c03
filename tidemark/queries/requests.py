"""Aggregate requests: filters, groups, measures, order."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import formulas as M
from tidemark.functions.conditions import matches_patterns
from tidemark.functions.dates import resolve_relative
from tidemark.model import RelationSpec
from tidemark.operators.positions import RangeIndex
from tidemark.operators.reads import matching_all_dimensions
from tidemark.operators.weighted import time_weighted_average
from tidemark.plans.request import AggregateRequest, aggregate, aggregate_entity, hide_columns, page_of
from tidemark.queries.registry import ACCOUNTS, ADS, EVENTS, ORGANIC, SEARCH, query, ratio, sums
from tidemark.session import shared_folder
from tidemark.sources import tables as T
from tidemark.sources.buckets import bucketed_star

JANUARY = ("2024-01-01", "2024-01-31")
CLICKS, IMPRESSIONS, SPEND, RESULTS = sums("clicks"), sums("impressions"), sums("spend"), sums("results")


def _events(spark, folder, aggregations, group_by=(), filters=None, dates=JANUARY, **more):
    request = AggregateRequest(aggregations, group_by, filters or {}, *dates, **more)
    return aggregate(T.event_star(spark, folder), request)


@query(
    "daily_click_report",
    f"""WITH {EVENTS}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS daily),
    t AS (SELECT d, {CLICKS} AS clicks, {IMPRESSIONS} AS impressions, {ratio(CLICKS, IMPRESSIONS)} AS ctr, {SPEND} AS spend FROM ev GROUP BY d)
    SELECT daily, R(CASE WHEN d IS NULL THEN 0 ELSE clicks END) AS clicks, R(CASE WHEN d IS NULL THEN 0 ELSE impressions END) AS impressions,
           R(CASE WHEN d IS NULL THEN 0 ELSE ctr END) AS ctr, R(CASE WHEN d IS NULL THEN 0 ELSE spend END) AS spend
    FROM days LEFT JOIN t ON d = daily""",
)
def daily_click_report(spark, folder):
    measures = {m: m for m in ("clicks", "impressions", "ctr", "spend")}
    return _events(spark, folder, measures, ["daily"], fill_gaps=True, order_by="daily")


@query("a1_fact_config_join", f"WITH {EVENTS} SELECT name, R(SUM(value)) AS total, COUNT(*) AS facts FROM ev GROUP BY name")
def fact_config_join(spark, folder):
    frame = T.normal_event_star(spark, folder).frame()
    return frame.groupBy("name").agg(F.sum("value").alias("total"), F.count("*").alias("facts"))


@query(
    "c1_normal_star_request",
    f"WITH {EVENTS} SELECT d AS daily, k, R({CLICKS}) AS clicks, R({ratio(CLICKS, IMPRESSIONS)}) AS ctr FROM ev GROUP BY d, k",
)
def normal_star_request(spark, folder):
    star = T.normal_event_star(spark, folder)
    return aggregate(star, AggregateRequest({"clicks": "clicks", "ctr": "ctr"}, ["daily", "k"], {}, *JANUARY))


@query(
    "c1_bucketed_star_request",
    f"WITH {EVENTS} SELECT d AS daily, k, R({CLICKS}) AS clicks, R({ratio(CLICKS, IMPRESSIONS)}) AS ctr FROM ev GROUP BY d, k",
)
def bucketed_star_request(spark, folder):
    """The same over tables in buckets, with large configs in pieces: facts meet configs without a shuffle."""
    star = bucketed_star(T.normal_event_star(spark, folder), f"events_{uuid.uuid4().hex}")
    return aggregate(star, AggregateRequest({"clicks": "clicks", "ctr": "ctr"}, ["daily", "k"], {}, *JANUARY))


# --- filters ---------------------------------------------------------------


# Every way to write a filter, and the SQL test it stands for.
_FORMS = {
    "scalar": ("7", "k = '7'"),
    "negated": ("!=7", "k <> '7'"),
    "list": (["1", "7", "12"], "k IN ('1', '7', '12')"),
    "operator": ({"operator": "not_in", "value": ["1", "7"]}, "k NOT IN ('1', '7')"),
    "pattern": ({"operator": "like", "value": "1%"}, "k LIKE '1%'"),
    "present": ("NOT_NULL", "k IS NOT NULL"),
    "missing": ("N/A", "k IS NULL"),
}


@query(
    "b1_filter_forms",
    f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{form}' AS form, R(COALESCE({CLICKS}, 0)) AS clicks, R(COALESCE({SPEND}, 0)) AS spend FROM ev WHERE {test}" for form, (_, test) in _FORMS.items()),
)
def filter_forms(spark, folder):
    answers = None
    for form, (raw, _) in _FORMS.items():
        answer = _events(spark, folder, {"clicks": "clicks", "spend": "spend"}, [], {"k": raw}).select(F.lit(form).alias("form"), "clicks", "spend")
        answers = answer if answers is None else answers.unionByName(answer)
    return answers


@query("i8_relative_dates", f"WITH {EVENTS} SELECT d AS daily, R({CLICKS}) AS clicks FROM ev WHERE d BETWEEN DATE '2024-01-13' AND DATE '2024-01-19' GROUP BY d")
def relative_dates(spark, folder):
    """Relative dates are spelled out against a given day."""
    today = date(2024, 1, 20)
    return _events(spark, folder, {"clicks": "clicks"}, ["daily"], {}, (resolve_relative("-7 days", today), resolve_relative("yesterday", today)))


@query(
    "b2_equal_and_not_equal",
    f"WITH {EVENTS} SELECT k, R({CLICKS}) AS clicks FROM ev WHERE acc <> 3 AND k <> '7' AND channel = 'events' GROUP BY k",
)
def equal_and_not_equal(spark, folder):
    filters = {"account": {"operator": "neq", "value": 3}, "k": "!=7", "channel": "events"}
    return _events(spark, folder, {"clicks": "clicks"}, ["k"], filters)


@query(
    "b3_in_list",
    f"WITH {EVENTS} SELECT d AS daily, R({CLICKS}) AS clicks FROM ev WHERE acc IN (1, 2, 3, 5, 8) AND k IN ('1','2','3','4','5','6','7','8') GROUP BY d",
)
def in_list(spark, folder):
    filters = {"channeledAccount": [1, 2, 3, 5, 8], "k": [str(i) for i in range(1, 9)]}
    return _events(spark, folder, {"clicks": "clicks"}, ["daily"], filters)


@query("b3_empty_in_list", f"WITH {EVENTS} SELECT d AS daily, R({CLICKS}) AS clicks FROM ev WHERE 1 = 0 GROUP BY d")
def empty_in_list(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["daily"], {"account": []})


@query("b4_not_in_list", f"WITH {EVENTS} SELECT k, R({SPEND}) AS spend FROM ev WHERE acc NOT IN (1, 2, 3) GROUP BY k")
def not_in_list(spark, folder):
    return _events(spark, folder, {"spend": "spend"}, ["k"], {"account": {"operator": "not_in", "value": [1, 2, 3]}})


@query("b5_like", f"WITH {EVENTS} SELECT k, R({CLICKS}) AS clicks FROM ev WHERE k LIKE '1%' GROUP BY k")
def like(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["k"], {"k": {"operator": "like", "value": "1%"}})


@query(
    "b6_null_tests",
    f"""WITH {ORGANIC} SELECT page_id, R(SUM(CASE WHEN name = 'views' AND period = 'lifetime' THEN value ELSE 0 END)) AS views
    FROM og WHERE post_id IS NOT NULL AND page_id IS NOT NULL GROUP BY page_id""",
)
def null_tests(spark, folder):
    filters = {"post": "NOT_NULL", "page": {"operator": "not_null"}, "period": "lifetime"}
    request = AggregateRequest({"views": "views"}, ["page_id"], filters, *JANUARY)
    return aggregate(T.organic_star(spark, folder), request)


@query("b6_is_null", f"WITH {ORGANIC} SELECT page_id, R(SUM(CASE WHEN name = 'follows' AND period = 'daily' THEN value ELSE 0 END)) AS follows FROM og WHERE post_id IS NULL GROUP BY page_id")
def is_null(spark, folder):
    request = AggregateRequest({"follows": "follows"}, ["page_id"], {"post": "N/A"}, *JANUARY)
    return aggregate(T.organic_star(spark, folder), request)


@query(
    "b7_date_range",
    f"WITH {EVENTS} SELECT d AS metric_date, R({CLICKS}) AS clicks FROM ev WHERE d >= DATE '2024-01-10' AND d <= DATE '2024-01-12' GROUP BY d",
)
def date_range(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["metric_date"], dates=("2024-01-10", "2024-01-12"))


def _order_entity(spark, folder):
    return T.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("total_price"),
        F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))).alias("data"),
    )


@query(
    "b8_entity_base_date",
    """SELECT o_orderstatus AS status, COUNT(*) AS orders, R(SUM(o_totalprice)) AS revenue FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' GROUP BY 1""",
    digits=2,
)
def entity_base_date(spark, folder):
    measures = {"orders": "COUNT(id)", "revenue": "SUM(total_price)"}
    return aggregate_entity(_order_entity(spark, folder), AggregateRequest(measures, ["status"], {}, "1996-01-01", "1996-12-31"))


@query(
    "b9_period",
    f"WITH {ORGANIC} SELECT d AS daily, R(SUM(CASE WHEN name = 'likes' AND period = 'lifetime' THEN value ELSE 0 END)) AS likes FROM og GROUP BY d",
)
def period(spark, folder):
    request = AggregateRequest({"likes": "likes"}, ["daily"], {"period": "Lifetime"}, *JANUARY)
    return aggregate(T.organic_star(spark, folder), request)


@query(
    "b10_relation_filter",
    f"WITH {ADS} SELECT year(d) || '' AS yearly, R({CLICKS}) AS clicks FROM ad WHERE campaign IN (5, 6, 7, 8, 9) AND ad_group <> 3 AND acc IS NOT NULL GROUP BY 1",
)
def relation_filter(spark, folder):
    filters = {
        "channeledCampaign": {"operator": "in", "value": ["5", 6, "7", 8, 9, "x"]},
        "adGroup_id": "!=3",
        "account": "NOT_NULL",
    }
    return aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["yearly"], filters))


@query("b10_relation_filter_without_numbers", f"WITH {EVENTS} SELECT k, R({CLICKS}) AS clicks FROM ev WHERE 1 = 0 GROUP BY k")
def relation_filter_without_numbers(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["k"], {"account": "nobody"})


@query(
    "b11_text_filter",
    f"""WITH {SEARCH} SELECT R({CLICKS}) AS clicks FROM se WHERE device IN ('A', 'R')
    AND query IN (SELECT s_suppkey FROM supplier WHERE s_name <> 'Supplier#000000001')""",
)
def text_filter(spark, folder):
    filters = {"device": ["A", "R"], "query": "!=Supplier#000000001"}
    return aggregate(T.search_star(spark, folder), AggregateRequest({"clicks": "clicks"}, [], filters))


@query(
    "b12_dimension_filter",
    f"WITH {ADS} SELECT d AS yearly_day, R({CLICKS}) AS clicks FROM ad WHERE gender = 'A' AND age IN ('F', 'O') GROUP BY d",
)
def dimension_filter(spark, folder):
    filters = {"dimensions.Gender": "A", "dimensions.age": ["F", "O"]}
    result = aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["daily"], filters))
    return result.withColumnRenamed("daily", "yearly_day")


@query(
    "b13_account_type",
    f"WITH {EVENTS}, {ACCOUNTS} SELECT d AS daily, R({CLICKS}) AS clicks FROM ev JOIN accounts a ON acc = a.id AND a.type = 'machinery' GROUP BY d".replace("name IN", "ev.name IN"),
)
def account_type(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["daily"], {"account_type": "MACHINERY"})


@query(
    "b14_post_platform_id",
    f"WITH {ORGANIC} SELECT post_id, R(SUM(CASE WHEN name = 'likes' AND period = 'lifetime' THEN value ELSE 0 END)) AS likes FROM og WHERE 'pg_' || post_id IN ('pg_1', 'pg_2', 'pg_44') GROUP BY post_id",
)
def post_platform_id(spark, folder):
    request = AggregateRequest({"likes": "likes"}, ["post_id"], {"post": ["pg_1", "pg_2", "pg_44"]}, *JANUARY)
    return aggregate(T.organic_star(spark, folder), request)


@query("b15_sentinel_filter", f"WITH {EVENTS} SELECT d AS daily, R({CLICKS}) AS clicks FROM ev WHERE 1 = 0 GROUP BY d")
def sentinel_filter(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["daily"], {"account": ["__none__"]})


@query(
    "b16_page_level_scope",
    f"WITH {ORGANIC} SELECT d AS daily, R(SUM(CASE WHEN name = 'follows' AND period = 'daily' THEN value ELSE 0 END)) AS follows FROM og WHERE post_id IS NULL GROUP BY d",
)
def page_level_scope(spark, folder):
    request = AggregateRequest({"follows": "follows"}, ["daily"], {"channel": "facebook_organic"}, *JANUARY)
    return aggregate(T.organic_star(spark, folder), request)


@query(
    "b17_totals_only_scope",
    f"""WITH {ORGANIC} SELECT d AS daily, R(SUM(CASE WHEN name = 'follows' AND period = 'daily' THEN value ELSE 0 END)) AS follows FROM og
    WHERE post_id IS NULL AND page_id % 2 = 0 GROUP BY d""",
)
def totals_only_scope(spark, folder):
    """Pages with an odd key carry a breakdown and stay out of the totals."""
    facts = T.organic_facts(spark, folder)
    odd = F.col("page_id") % 2 == 1
    facts = facts.withColumns(
        {
            "dims": F.when(odd, F.create_map(F.lit("age"), F.lit("18-24"))),
            "dimension_set_id": F.when(odd, F.lit("age=18-24")),
        }
    )
    request = AggregateRequest({"follows": "follows"}, ["daily"], {"channel": "facebook_organic"}, *JANUARY)
    return aggregate(T.Star(facts=facts), request)


@query(
    "b19_pattern_filter",
    "SELECT page_id, url FROM pages WHERE (regexp_matches(url, 'example\\.(com|org)') OR contains(lower(url), 'blog.')) AND NOT contains(lower(url), 'page=2')",
)
def pattern_filter(spark, folder):
    pages = T.table(spark, folder, "pages").select("page_id", "url")
    return pages.filter(matches_patterns(F.col("url"), [r"/example\.(com|org)/", "Blog."], "Page=2"))


@query("b20_hidden_columns", f"WITH {EVENTS} SELECT d AS daily, R({CLICKS}) AS clicks FROM ev GROUP BY d")
def hidden_columns(spark, folder):
    return hide_columns(_events(spark, folder, {"clicks": "clicks", "spend": "spend"}, ["daily"]), ["spend"])


@query(
    "b23_all_dimensions_match",
    f"WITH {ADS} SELECT COUNT(*) AS facts, R(SUM(value)) AS total FROM ad WHERE gender = 'N' AND age = 'O' AND name = 'clicks'",
)
def all_dimensions_match(spark, folder):
    facts = T.ads_facts(spark, folder).filter(F.col("name") == "clicks")
    hits = matching_all_dimensions(facts, {"gender": "N", "age": "O"})
    return hits.agg(F.count("*").alias("facts"), F.sum("value").alias("total"))


@query(
    "b24_attribute_filter",
    f"WITH {SEARCH} SELECT p.p_brand AS page_title, R({CLICKS}) AS clicks FROM se JOIN part p ON page = p_partkey WHERE p.p_brand LIKE 'Brand#1%' AND p.p_type NOT IN ('ECONOMY') GROUP BY 1".replace("name IN", "se.name IN"),
)
def attribute_filter(spark, folder):
    filters = {
        "page_title": {"operator": "like", "value": "Brand#1%"},
        "page_platform_id": {"operator": "not_in", "value": ["ECONOMY"]},
    }
    return aggregate(T.search_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["page_title"], filters))


# --- measures --------------------------------------------------------------


@query(
    "d1_conditional_sums",
    f"WITH {EVENTS} SELECT R({CLICKS}) AS clicks, R({IMPRESSIONS}) AS impressions, R({sums('reach')}) AS reach, R({RESULTS}) AS conversions FROM ev",
)
def conditional_sums(spark, folder):
    return _events(spark, folder, {m: m for m in ("clicks", "impressions", "reach", "conversions")})


@query(
    "d2_conditional_average",
    f"WITH {EVENTS} SELECT acc AS channeled_account_id, R(AVG(CASE WHEN name IN ('spend') THEN value END)) AS frequency FROM ev GROUP BY acc",
)
def conditional_average(spark, folder):
    dictionary = M.MetricDictionary(overrides={"events": {"frequency": "spend"}})
    star = T.event_star(spark, folder)
    star = star.__class__(facts=star.facts)
    request = AggregateRequest({"frequency": "frequency"}, ["channeled_account_id"], {"channel": "events"}, *JANUARY)
    relations = {k: v for k, v in star.relations.items() if k != "channeled_account_id"}
    return aggregate(star.__class__(facts=star.facts, relations=relations), request, dictionary)


@query(
    "d3_ratio_metrics",
    f"""WITH {EVENTS} SELECT d AS daily, R({ratio(CLICKS, IMPRESSIONS)}) AS ctr, R({ratio(SPEND, CLICKS)}) AS cpc,
    R({ratio(SPEND, IMPRESSIONS)} * 1000) AS cpm, R({ratio(SPEND, RESULTS)}) AS cost_per_conversion,
    R({ratio(RESULTS, IMPRESSIONS)}) AS conversion_rate FROM ev GROUP BY d""",
    ties=True,
)
def ratio_metrics(spark, folder):
    names = ("ctr", "cpc", "cpm", "cost_per_conversion", "conversion_rate")
    return _events(spark, folder, {m: m for m in names}, ["daily"])


def _library_names(part):
    """Raw names behind a part of a formula."""
    return [part] if part in M.AMBIGUOUS or part.startswith("ig_reels_") else M.associated_names(part)


def _library_sql(text):
    if text.startswith("avg:"):
        return f"AVG(CASE WHEN name IN ({', '.join(repr(n) for n in _library_names(text[4:]))}) THEN value END)"
    upper, _, rest = text.partition("/")
    lower, _, factor = rest.partition("*")
    top = sums(*_library_names(upper))
    return f"{top} / NULLIF({sums(*_library_names(lower))}, 0) * {factor or 1}" if lower else top


_PARTS = sorted({p for t in M.FORMULA_LIBRARY.values() for p in t.removeprefix("avg:").partition("*")[0].split("/")})
_RAW = sorted({n for p in _PARTS for n in _library_names(p)})


@query(
    "d4_formula_library",
    f"""WITH f AS (SELECT event_type, [{', '.join(repr(n) for n in _RAW)}][event_id % {len(_RAW)} + 1] AS name, value FROM events)
    SELECT event_type AS channel, {', '.join(f"R({_library_sql(t)}) AS {n}" for n, t in M.FORMULA_LIBRARY.items())} FROM f GROUP BY event_type""",
)
def formula_library(spark, folder):
    """Every named formula, over facts that take its raw names in turn."""
    names = F.array(*[F.lit(n) for n in _RAW])
    events = T.table(spark, folder, "events")
    frame = events.select(
        F.col("event_type").alias("channel"),
        F.element_at(names, (F.col("event_id") % len(_RAW) + 1).cast("int")).alias("name"),
        F.lit("daily").alias("period"),
        "value",
    )
    facts = M.FactColumns()
    return frame.groupBy("channel").agg(*[M.library_formula(n, facts).alias(n) for n in M.FORMULA_LIBRARY])


@query(
    "d4_campaign_status",
    f"WITH {ADS} SELECT gender, MIN(CASE WHEN c_acctbal >= 0 THEN 'ACTIVE' ELSE 'PAUSED' END) AS campaign_status, R({CLICKS}) AS clicks FROM ad LEFT JOIN customer ON campaign = c_custkey GROUP BY gender",
)
def campaign_status(spark, folder):
    request = AggregateRequest({"campaign_status": "campaign_status", "clicks": "clicks"}, ["gender"])
    return aggregate(T.ads_star(spark, folder), request)


@query(
    "d5_metric_dictionary",
    f"WITH {EVENTS} SELECT d AS daily, R({sums('sessions')}) AS conversions, R({ratio(SPEND, sums('sessions'))}) AS cost_per_conversion FROM ev GROUP BY d",
)
def metric_dictionary(spark, folder):
    dictionary = M.MetricDictionary(overrides={"events": {"conversions": ["sessions", " sessions "]}})
    names = {"conversions": "results", "cost_per_conversion": "cost_per_result"}
    request = AggregateRequest(names, ["daily"], {"channel": "events"}, *JANUARY)
    return aggregate(T.event_star(spark, folder), request, dictionary)


_WEIGHTED_BASE = """base AS (SELECT d, dimset, page, query, device, {keys}
    MAX(CASE WHEN name = 'position' THEN value END) AS m, MAX(CASE WHEN name = 'impressions' THEN value END) AS w,
    SUM(CASE WHEN name = 'clicks' THEN value ELSE 0 END) AS clicks, SUM(CASE WHEN name = 'impressions' THEN value ELSE 0 END) AS impressions
    FROM se {where} GROUP BY ALL)"""
_WEIGHTED = "R(SUM(COALESCE(m, 0) * COALESCE(w, 0)) / NULLIF(SUM(COALESCE(w, 0)), 0)) AS position"
SEARCH_METRICS = {"clicks": "clicks", "impressions": "impressions", "ctr": "ctr", "position": "position"}
_SEARCH_SQL = f"R(SUM(clicks)) AS clicks, R(SUM(impressions)) AS impressions, R(SUM(clicks) / NULLIF(SUM(impressions), 0)) AS ctr, {_WEIGHTED}"


@query(
    "d6_weighted_total",
    f"WITH {SEARCH}, {_WEIGHTED_BASE.format(keys='', where='WHERE page = 3')} SELECT {_SEARCH_SQL} FROM base",
)
def weighted_total(spark, folder):
    return aggregate(T.search_star(spark, folder), AggregateRequest(SEARCH_METRICS, [], {"page": 3}))


@query(
    "d6_weighted_daily",
    f"WITH {SEARCH}, {_WEIGHTED_BASE.format(keys='', where='')} SELECT d AS daily, {_SEARCH_SQL} FROM base GROUP BY d",
)
def weighted_daily(spark, folder):
    return aggregate(T.search_star(spark, folder), AggregateRequest(SEARCH_METRICS, ["daily"]))


@query(
    "d6_weighted_by_query",
    f"""WITH {SEARCH}, {_WEIGHTED_BASE.format(keys='', where="WHERE dimset = 'O'")}
    SELECT COALESCE(s_name, 'N/A') AS query, {_SEARCH_SQL} FROM base LEFT JOIN supplier ON query = s_suppkey GROUP BY 1""",
)
def weighted_by_query(spark, folder):
    filters = {"dimensions.searchAppearance": "O"}
    return aggregate(T.search_star(spark, folder), AggregateRequest(SEARCH_METRICS, ["query"], filters))


@query(
    "d6_weighted_by_dimension",
    f"WITH {SEARCH}, {_WEIGHTED_BASE.format(keys='', where='')} SELECT dimset AS searchappearance, {_SEARCH_SQL} FROM base GROUP BY 1",
)
def weighted_by_dimension(spark, folder):
    result = aggregate(T.search_star(spark, folder), AggregateRequest(SEARCH_METRICS, ["dimensions.searchAppearance"]))
    return result.withColumnRenamed("dimensions.searchAppearance", "searchappearance")


@query(
    "d7_time_weighted_average",
    f"""WITH {SEARCH}, grain AS (SELECT d, dimset, query, page, device, COUNT(CASE WHEN name = 'position' AND value <> 0 THEN 1 END) AS n,
      SUM(CASE WHEN name = 'position' AND value <> 0 THEN 1.0 / value END) AS inv, MAX(CASE WHEN name = 'impressions' THEN value END) AS total
      FROM se GROUP BY ALL)
    SELECT device, R(SUM(COALESCE(total, 0) * n) / NULLIF(SUM(COALESCE(total, 0) * COALESCE(inv, 0)), 0)) AS watch_time FROM grain GROUP BY device""",
)
def time_weighted(spark, folder):
    frame = T.search_facts(spark, folder)
    groups = {"device": F.char(F.col("device_id"))}
    return time_weighted_average(frame, ["position"], ["impressions"], groups, "watch_time")


@query(
    "d7_request",
    f"""WITH {SEARCH}, grain AS (SELECT d, dimset, query, page, device, COUNT(CASE WHEN name = 'position' AND value <> 0 THEN 1 END) AS n,
      SUM(CASE WHEN name = 'position' AND value <> 0 THEN 1.0 / value END) AS inv, MAX(CASE WHEN name = 'impressions' THEN value END) AS total FROM se GROUP BY ALL),
    s AS (SELECT device, SUM(CASE WHEN name = 'clicks' THEN value ELSE 0 END) AS clicks FROM se GROUP BY device)
    SELECT device, R(SUM(COALESCE(total, 0) * n) / NULLIF(SUM(COALESCE(total, 0) * COALESCE(inv, 0)), 0)) AS watch_time, R(MAX(clicks)) AS clicks FROM grain JOIN s USING (device) GROUP BY device""",
)
def time_weighted_request(spark, folder):
    """Watch times asked for by name, beside a sum."""
    renamed = {"position": "ig_reels_avg_watch_time", "impressions": "ig_reels_video_view_total_time"}
    star = T.search_star(spark, folder)
    name = F.coalesce(*[F.when(F.col("name") == old, F.lit(new)) for old, new in renamed.items()], F.col("name"))
    request = AggregateRequest({"watch_time": "ig_reels_avg_watch_time", "clicks": "clicks"}, ["device_id"])
    answer = aggregate(replace(star, facts=star.facts.withColumn("name", name)), request)
    return answer.select(F.char("device_id").alias("device"), "watch_time", "clicks")


@query("d1_empty_total", "SELECT CAST(0 AS DOUBLE) AS clicks, CAST(0 AS DOUBLE) AS results FROM (SELECT COUNT(*) FROM events)")
def empty_total(spark, folder):
    """A total over days without facts is 0, also from the normal tables."""
    star = T.normal_event_star(spark, folder)
    return aggregate(star, AggregateRequest({"clicks": "clicks", "results": "results"}, [], {}, "1990-01-01", "1990-12-31"))


@query("d8_fact_expression", f"WITH {EVENTS} SELECT channel, COUNT(*) AS facts, MAX(d) AS last_day FROM ev GROUP BY channel")
def fact_expression(spark, folder):
    """Expressions over columns of the facts, from the normal tables."""
    measures = {"facts": "COUNT(metric_config_id)", "last_day": "MAX(metric_date)"}
    return aggregate(T.normal_event_star(spark, folder), AggregateRequest(measures, ["channel"], {}, *JANUARY))


@query(
    "c1_presummed_groups",
    f"WITH {EVENTS} SELECT strftime(d, '%G-W%V') AS weekly, k, R({CLICKS}) AS clicks, R({SPEND}) AS spend FROM ev WHERE acc <> 3 GROUP BY 1, 2",
)
def presummed_groups(spark, folder):
    request = AggregateRequest({"clicks": "clicks", "spend": "spend"}, ["weekly", "k"], {"channeled_account_id": {"operator": "neq", "value": 3}}, *JANUARY)
    star = T.normal_event_star(spark, folder)
    return aggregate(replace(star, relations={k: v for k, v in star.relations.items() if k != "channeled_account_id"}), request)


@query(
    "d8_entity_expression",
    """WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, * FROM orders WHERE o_orderpriority <> '5-LOW' AND CAST(o_orderdate AS DATE) BETWEEN DATE '2001-01-10' AND DATE '2001-12-20'),
    months AS (SELECT strftime(unnest(generate_series(DATE '2001-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)), '%Y-%m') AS monthly),
    t AS (SELECT m, o_orderstatus AS status, SUM(o_totalprice) / COUNT(o_orderkey) AS average_order, SUM(o_custkey) AS customers FROM o GROUP BY 1, 2),
    s AS (SELECT DISTINCT status FROM t)
    SELECT monthly, s.status, R(COALESCE(average_order, 0)) AS average_order, R(COALESCE(customers, 0)) AS customers FROM s CROSS JOIN months LEFT JOIN t ON m = monthly AND t.status = s.status""",
    digits=2,
)
def entity_expression(spark, folder):
    """Months without orders are filled in, as for metrics."""
    measures = {"average_order": "SUM(total_price) / COUNT(id)", "customers": "SUM(data.customer)"}
    filters = {"data.priority": "!=5-LOW"}
    request = AggregateRequest(measures, ["monthly", "status"], filters, "2001-01-10", "2001-12-20", fill_gaps=True)
    return aggregate_entity(_order_entity(spark, folder), request)


@query("d9_any_metric_name", f"WITH {EVENTS} SELECT d AS daily, R({sums('event_count')}) AS errors, R(SUM(CASE WHEN name = 'clicks_daily' THEN value ELSE 0 END)) AS exact FROM ev GROUP BY d")
def any_metric_name(spark, folder):
    facts, frame = M.FactColumns(), T.event_facts(spark, folder)
    return frame.groupBy(F.col("metric_date").alias("daily")).agg(
        M.named_sum("event_count", facts).alias("errors"), M.named_sum("clicks_daily", facts).alias("exact")
    )


@query(
    "d12_merge_search_partials",
    """WITH p AS (SELECT l_partkey AS page, CAST(l_quantity AS DOUBLE) AS impressions, ROUND(l_tax * 100) AS clicks, ROUND(l_discount * 100) + 1 AS position FROM lineitem)
    SELECT page, R(SUM(impressions)) AS impressions, R(SUM(clicks)) AS clicks, R(SUM(clicks) / NULLIF(SUM(impressions), 0)) AS ctr,
    R(SUM(position * impressions) / NULLIF(SUM(impressions), 0)) AS position, COUNT(*) AS count FROM p GROUP BY page""",
)
def merge_search_partials(spark, folder):
    partials = T.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("page"),
        F.col("l_quantity").alias("impressions"),
        F.round(F.col("l_tax") * 100).alias("clicks"),
        (F.round(F.col("l_discount") * 100) + 1).alias("position"),
        F.lit(1).cast("long").alias("count"),
    )
    return M.merge_search_partials(partials, ["page"])


# --- groups and order ------------------------------------------------------


def _grain(name, label):
    @query(f"e1_{name}", f"WITH {ADS} SELECT {label} AS {name}, R({CLICKS}) AS clicks, R({ratio(SPEND, CLICKS)}) AS cpc FROM ad GROUP BY 1", ties=True)
    def grain(spark, folder):
        return aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks", "cpc": "cpc"}, [name]))


for _name, _label in {
    "daily": "d",
    "weekly": "strftime(d, '%G-W%V')",
    "monthly": "strftime(d, '%Y-%m')",
    "quarterly": "year(d) || '-Q' || quarter(d)",
    "yearly": "CAST(year(d) AS VARCHAR)",
}.items():
    _grain(_name, _label)


@query(
    "e2_date_parts",
    f"""WITH {EVENTS} SELECT CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month, CAST(day(d) AS INT) AS day, CAST(weekofyear(d) AS INT) AS week,
    CAST(quarter(d) AS INT) AS quarter, CAST(dayofweek(d) AS INT) AS dayofweek, dayname(d) AS dayname, monthname(d) AS monthname, R({CLICKS}) AS clicks FROM ev GROUP BY ALL""",
)
def date_parts(spark, folder):
    parts = ["year", "month", "day", "week", "quarter", "dayofweek", "dayname", "monthname"]
    return _events(spark, folder, {"clicks": "clicks"}, parts)


@query(
    "e3_relation_label",
    f"""WITH {ADS}, t AS (SELECT ad_group, R({CLICKS}) AS clicks FROM ad GROUP BY ad_group)
    SELECT COALESCE(s_name, CAST(ad_group AS VARCHAR), 'Unknown') AS adGroup, ad_group AS adGroup_id, clicks FROM t LEFT JOIN supplier ON ad_group = s_suppkey""",
)
def relation_label(spark, folder):
    return aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["adGroup"]))


@query(
    "e4_attribute_group",
    f"WITH {SEARCH} SELECT COALESCE(p_brand, 'N/A') AS page_title, R({CLICKS}) AS clicks FROM se LEFT JOIN part ON page = p_partkey GROUP BY 1",
)
def attribute_group(spark, folder):
    return aggregate(T.search_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["page_title"]))


@query(
    "e5_json_label",
    f"""WITH {ADS}, t AS (SELECT campaign, R({CLICKS}) AS clicks FROM ad GROUP BY campaign)
    SELECT COALESCE(c_name, 'N/A') AS campaign, campaign AS campaign_id, clicks FROM t LEFT JOIN customer ON campaign = c_custkey""",
)
def json_label(spark, folder):
    return aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["campaign"]))


@query(
    "e6_dimensions",
    f"WITH {ADS} SELECT COALESCE(gender, 'unknown') AS gender, COALESCE(age, 'unknown') AS age, 'unknown' AS other, R({CLICKS}) AS clicks FROM ad GROUP BY ALL",
)
def dimensions(spark, folder):
    return aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["gender", "age", "other"]))


@query(
    "c3_dimension_fallback",
    f"WITH {EVENTS} SELECT COALESCE(CASE WHEN acc <= 10 THEN 'p' || k END, 'lp' || k) AS page, R({CLICKS}) AS clicks FROM ev GROUP BY 1",
)
def dimension_fallback(spark, folder):
    facts = T.event_facts(spark, folder)
    k = F.col("dimension_set_id")
    landing = F.create_map(F.lit("landing_page"), F.concat(F.lit("lp"), k))
    both = F.map_concat(landing, F.create_map(F.lit("page"), F.concat(F.lit("p"), k)))
    facts = facts.withColumn("dims", F.when(F.col("channeled_account_id") <= 10, both).otherwise(landing))
    star = T.Star(facts=facts)
    result = aggregate(star, AggregateRequest({"clicks": "clicks"}, ["dimensions.page"], {}, *JANUARY))
    return result.withColumnRenamed("dimensions.page", "page")


@query(
    "e7_account_label",
    f"""WITH {EVENTS}, t AS (SELECT acc, R({CLICKS}) AS clicks FROM ev GROUP BY acc)
    SELECT COALESCE(c_name, CAST(acc AS VARCHAR), 'Unknown') AS account, acc AS account_id, 'events' AS channel, clicks FROM t LEFT JOIN customer ON acc = c_custkey""",
)
def account_label(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["account", "channel"])


@query(
    "c2_required_relation",
    f"WITH {ADS} SELECT p_name AS ad, ad AS ad_id, R({CLICKS}) AS clicks FROM ad JOIN part ON ad = p_partkey WHERE p_size > 25 GROUP BY 1, 2".replace("name IN", "ad.name IN"),
)
def required_relation(spark, folder):
    """An inner relation: facts of entities that do not exist drop out."""
    star = T.ads_star(spark, folder)
    large = T.table(spark, folder, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    star = star.register_relation("ad", RelationSpec("large_parts", "channeled_ad_id", "name", required=True), large)
    return aggregate(star, AggregateRequest({"clicks": "clicks"}, ["ad"]))


@query(
    "e12_gap_fill_by_group",
    f"""WITH {EVENTS}, combos AS (SELECT DISTINCT k FROM ev WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-02-04'),
    days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-04', INTERVAL 1 DAY)) AS DATE) AS d),
    t AS (SELECT d, k, {CLICKS} AS clicks FROM ev WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-02-04' GROUP BY d, k)
    SELECT days.d AS daily, combos.k AS k, R(COALESCE(clicks, 0)) AS clicks FROM combos CROSS JOIN days LEFT JOIN t ON t.d = days.d AND t.k = combos.k""",
)
def gap_fill_by_group(spark, folder):
    return _events(spark, folder, {"clicks": "clicks"}, ["daily", "k"], dates=("2024-01-05", "2024-02-04"), fill_gaps=True)


@query(
    "e12_gap_fill_monthly",
    f"""WITH {ADS}, months AS (SELECT strftime(unnest(generate_series(DATE '1994-11-01', DATE '1996-02-01', INTERVAL 1 MONTH)), '%Y-%m') AS monthly),
    t AS (SELECT strftime(d, '%Y-%m') AS m, {CLICKS} AS clicks FROM ad WHERE d BETWEEN DATE '1994-11-30' AND DATE '1996-02-15' GROUP BY 1)
    SELECT monthly, R(COALESCE(clicks, 0)) AS clicks FROM months LEFT JOIN t ON m = monthly""",
)
def gap_fill_monthly(spark, folder):
    request = AggregateRequest({"clicks": "clicks"}, ["monthly"], {}, "1994-11-30", "1996-02-15", fill_gaps=True)
    return aggregate(T.ads_star(spark, folder), request)


@query("g1_order_by_measure", f"WITH {EVENTS} SELECT k, R({SPEND}) AS spend FROM ev GROUP BY k ORDER BY 2 DESC")
def order_by_measure(spark, folder):
    return _events(spark, folder, {"spend": "spend"}, ["k"], order_by="Spend", order_dir="desc")


@query("g2_order_by_group", f"WITH {EVENTS} SELECT k, R({SPEND}) AS spend FROM ev GROUP BY k ORDER BY 1")
def order_by_group(spark, folder):
    return _events(spark, folder, {"spend": "spend"}, ["k"], order_by="k")


@query(
    "g3_page_of_rows",
    "SELECT o_orderkey AS id, o_custkey AS customer FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200",
)
def page_of_rows(spark, folder):
    orders = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"))
    return page_of(orders, ["id"], limit=100, page=2)


@query(
    "g3_page_from_index",
    """SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS price FROM orders ORDER BY o_orderdate DESC, o_orderkey
    LIMIT 50 OFFSET (SELECT COUNT(*) // 50 // 2 * 50 FROM orders)""",
)
def page_from_index(spark, folder):
    """A page from the middle of the listing: ids from an index of sort keys, then the rows of these ids."""
    orders = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"))
    path = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    index = RangeIndex.build(orders.select("id", "o_orderdate"), [F.col("o_orderdate").desc(), "id"], path)
    rows = index.counts.agg(F.sum("__rows")).first()[0] or 0
    return index.page_with(orders.drop("o_orderdate"), "id", 50, rows // 50 // 2)


# --- registries ------------------------------------------------------------


@query(
    "m2_registered_formula",
    f"WITH {EVENTS} SELECT d AS daily, R(MAX(CASE WHEN name = 'spend' THEN value END)) AS top_click, R(SUM(value) / COUNT(*)) AS mean_fact FROM ev GROUP BY d",
)
def registered_formula(spark, folder):
    star = T.event_star(spark, folder)
    star = star.register_formula("top_click", lambda value: F.max(F.when(F.col("name") == "spend", value)))
    star = star.register_formula("mean_fact", "SUM({value}) / COUNT(*)")
    request = AggregateRequest({"top_click": "top_click", "mean_fact": "mean_fact"}, ["daily"], {}, *JANUARY)
    return aggregate(star, request)


@query(
    "m3_registered_relation",
    f"""WITH {ADS}, t AS (SELECT acc, R({CLICKS}) AS clicks FROM ad GROUP BY acc)
    SELECT COALESCE(r_name, CAST(acc AS VARCHAR), 'Unknown') AS region, acc AS region_id, clicks FROM t
    LEFT JOIN nation ON acc = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def registered_relation(spark, folder):
    nations = T.table(spark, folder, "nation").join(
        T.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    regions = nations.select(F.col("n_nationkey").cast("long").alias("id"), F.col("r_name").alias("name"))
    star = T.ads_star(spark, folder).register_relation("region", RelationSpec("regions", "channeled_account_id", "name"), regions)
    return aggregate(star, AggregateRequest({"clicks": "clicks"}, ["region"]))


@query(
    "i1_json_group",
    f"""WITH {ADS} SELECT c_mktsegment AS objective, R({CLICKS}) AS clicks FROM ad LEFT JOIN customer ON campaign = c_custkey GROUP BY 1""",
)
def json_group(spark, folder):
    result = aggregate(T.ads_star(spark, folder), AggregateRequest({"clicks": "clicks"}, ["campaign.data.objective"]))
    return result.withColumnRenamed("campaign.data.objective", "objective")
