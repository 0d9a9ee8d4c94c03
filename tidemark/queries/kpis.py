"""KPI trees, alerts, and statistics per series."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators import stats
from tidemark.plans import alerts as A
from tidemark.plans import kpi as P
from tidemark.queries import registry
from tidemark.queries.registry import ADS, EVENTS, SEARCH, sums
from tidemark.sources import tables as T

JANUARY = ("2024-01-01", "2024-01-31")
query = partial(registry.query, ties=True)


def metric(name, **filters):
    return {"type": "metric", "metric": name, "filters": filters}


def op(operator, left, right):
    return {"type": "operator", "operator": operator, "left": left, "right": right}


def value(number):
    return {"type": "value", "value": number}


CLICKS, SPEND, VIEWS, RESULTS = sums("clicks"), sums("spend"), sums("impressions"), sums("results")


@query(
    "k1_kpi_daily_cost",
    f"WITH {EVENTS} SELECT d AS key, R(CASE WHEN {CLICKS} = 0 THEN 0 ELSE {SPEND} * 1.2 / {CLICKS} END + 10) AS value FROM ev GROUP BY d",
)
def kpi_daily_cost(spark, folder):
    tree = op("+", op("/", op("*", metric("events.spend"), value(1.2)), metric("events.clicks")), value(10))
    return P.evaluate_kpi(T.event_star(spark, folder), tree, *JANUARY, group_by="daily")


@query("k1_kpi_total", f"WITH {EVENTS} SELECT R(COALESCE({RESULTS} / NULLIF({RESULTS} + {CLICKS}, 0), 0)) AS value FROM ev")
def kpi_total(spark, folder):
    tree = op("ratio", metric("events.results"), metric("events.clicks"))
    return P.evaluate_kpi(T.event_star(spark, folder), tree, *JANUARY)


@query("k1_text_filter", f"WITH {SEARCH} SELECT R(SUM(CASE WHEN name = 'clicks' THEN value ELSE 0 END) / SUM(CASE WHEN name = 'impressions' THEN value ELSE 0 END)) AS value FROM se WHERE device IN ('A', 'R')")
def kpi_text_filter(spark, folder):
    """Leaves filter by the text of a related entity, as requests do."""
    tree = op("/", metric("search.clicks", device=["A", "R"]), metric("search.impressions", device=["A", "R"]))
    return P.evaluate_kpi(T.search_star(spark, folder), tree)


@query(
    "k1_weighted_metric",
    f"""WITH {SEARCH}, base AS (SELECT d, dimset, page, query, device, MAX(CASE WHEN name = 'position' THEN value END) AS m, MAX(CASE WHEN name = 'impressions' THEN value END) AS w FROM se GROUP BY ALL)
    SELECT strftime(d, '%Y-%m') AS key, R(SUM(COALESCE(m, 0) * COALESCE(w, 0)) / NULLIF(SUM(COALESCE(w, 0)), 0)) AS value FROM base GROUP BY 1""",
)
def kpi_weighted_metric(spark, folder):
    return P.evaluate_kpi(T.search_star(spark, folder), metric("search.position"), group_by="monthly")


@query("k1_by_relation", f"WITH {SEARCH} SELECT p_name AS key, R(SUM(CASE WHEN name = 'clicks' THEN value ELSE 0 END) * 2) AS value FROM se JOIN part ON page = p_partkey GROUP BY p_partkey, p_name")
def kpi_by_relation(spark, folder):
    return P.evaluate_kpi(T.search_star(spark, folder), op("*", metric("search.clicks"), value(2)), group_by="page")


_OPERATORS = ("+", "-", "*", "/", "ratio", "avg", "min", "max", "abs_diff", "pct_change")


@query(
    "i5_kpi_arithmetic",
    """WITH p AS (SELECT o_orderkey, o_totalprice AS l, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_custkey END AS r FROM orders)
    SELECT o_orderkey, R(l + r) AS plus, R(l - r) AS minus, R(l * r) AS times, R(COALESCE(l / NULLIF(r, 0), 0)) AS divided, R(COALESCE(l / NULLIF(l + r, 0), 0)) AS ratio,
    R((l + r) / 2) AS avg, R(LEAST(l, r)) AS min, R(GREATEST(l, r)) AS max, R(ABS(l - r)) AS abs_diff, R(COALESCE((l - r) / ABS(NULLIF(r, 0)) * 100, 0)) AS pct_change FROM p""",
    digits=2,
)
def kpi_arithmetic(spark, folder):
    right = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(0.0)).otherwise(F.col("o_custkey").cast("double"))
    names = {"+": "plus", "-": "minus", "*": "times", "/": "divided"}
    columns = [P.combine(o, F.col("o_totalprice"), right).alias(names.get(o, o)) for o in _OPERATORS]
    return T.table(spark, folder, "orders").select("o_orderkey", *columns)


_BATCHES = f"""a AS (SELECT k AS key, {SPEND} AS v FROM ev WHERE acc = 3 GROUP BY k), b AS (SELECT k AS key, {SPEND} AS v FROM ev WHERE acc IN (4, 5) GROUP BY k)"""


@query(
    "k2_kpi_batches",
    f"WITH {EVENTS}, {_BATCHES} SELECT key, R(COALESCE(a.v, 0) - COALESCE(b.v, 0)) AS value FROM a FULL JOIN b USING (key)",
)
def kpi_batches(spark, folder):
    tree = op("-", metric("events.spend", account=3), metric("events.spend", account=[4, 5]))
    return P.evaluate_kpi(T.event_star(spark, folder), tree, *JANUARY, group_by="k")


@query(
    "k3_series_and_scalar",
    f"""WITH {EVENTS}, {_BATCHES}, p AS (SELECT key, v + 100 AS v FROM a)
    SELECT key, R(CASE WHEN COALESCE(b.v, 0) = 0 THEN 0 ELSE (COALESCE(p.v, 0) - b.v) / ABS(b.v) * 100 END) AS value FROM p FULL JOIN b USING (key)""",
)
def series_and_scalar(spark, folder):
    tree = op("pct_change", op("+", metric("events.spend", account=3), value(100)), metric("events.spend", account=[4, 5]))
    return P.evaluate_kpi(T.event_star(spark, folder), tree, *JANUARY, group_by="k")


@query(
    "k1_derived_metric",
    f"WITH {EVENTS} SELECT strftime(d, '%G-W%V') AS key, R(ABS({CLICKS} - {VIEWS}) / 2) AS value FROM ev GROUP BY 1",
)
def derived_metric(spark, folder):
    derived = {7: op("abs_diff", metric("events.clicks"), metric("events.impressions"))}
    tree = op("/", {"type": "derived_metric", "derived_metric_id": 7}, value(2))
    return P.evaluate_kpi(T.event_star(spark, folder), tree, *JANUARY, group_by="weekly", derived=derived)


_PAIR = """y AS (SELECT user_id AS s, CAST(ts AS DATE) AS key, SUM(value) AS y FROM events WHERE event_type = 'click' GROUP BY 1, 2),
    x AS (SELECT user_id AS s, CAST(ts AS DATE) AS key, SUM(value) AS x FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""


def _series(spark, folder, kind):
    events = T.table(spark, folder, "events").filter(F.col("event_type") == kind)
    return events.groupBy(F.col("user_id").alias("series"), F.to_date("ts").alias("key")).agg(F.sum("value").alias("value"))


def _pairs(spark, folder):
    return S.align(_series(spark, folder, "click"), _series(spark, folder, "view"))


@query(
    "c8_outer_alignment",
    f"WITH {_PAIR} SELECT s AS series, key, R(COALESCE(y, 0)) AS l, R(COALESCE(x, 0)) AS r FROM y FULL JOIN x USING (s, key)",
)
def outer_alignment(spark, folder):
    return S.align_outer(_series(spark, folder, "click"), _series(spark, folder, "view"))


@query("c9_inner_alignment", f"WITH {_PAIR} SELECT s AS series, key, R(y) AS y, R(x) AS x FROM y JOIN x USING (s, key)")
def inner_alignment(spark, folder):
    return _pairs(spark, folder)


@query(
    "k3_combined_series",
    f"""WITH y AS (SELECT CAST(ts AS DATE) AS key, SUM(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
    x AS (SELECT CAST(ts AS DATE) AS key, SUM(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT key, R(GREATEST(COALESCE(y.v, 0), COALESCE(x.v, 0))) AS value FROM y FULL JOIN x USING (key)""",
)
def combined_series(spark, folder):
    def total(kind):
        return _series(spark, folder, kind).groupBy("key").agg(F.sum("value").alias("value"))

    return P.combine_series(total("click"), total("view"), "max")


@query(
    "k4_resolved_assets",
    """WITH a AS (SELECT DISTINCT user_id FROM events), acc AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN md5('acc-' || c_custkey) ELSE 'acc-' || c_custkey END AS pid FROM customer WHERE c_acctbal < 5000)
    SELECT 'acc-' || user_id AS asset_platform_id, COALESCE(p.id, h.id) AS channeled_account_id FROM a LEFT JOIN acc p ON p.pid = 'acc-' || user_id LEFT JOIN acc h ON h.pid = md5('acc-' || user_id)""",
)
def resolved_assets(spark, folder):
    assets = T.table(spark, folder, "events").select(
        F.lit("events").alias("channel"), F.concat(F.lit("acc-"), F.col("user_id").cast("string")).alias("asset_platform_id")
    ).distinct()
    plain = F.concat(F.lit("acc-"), F.col("c_custkey").cast("string"))
    accounts = T.table(spark, folder, "customer").filter("c_acctbal < 5000").select(
        F.col("c_custkey").alias("id"), F.lit("events").alias("channel"), F.when(F.col("c_acctbal") < 0, F.md5(plain)).otherwise(plain).alias("platform_id")
    )
    return P.resolve_assets(assets, accounts).drop("channel")


_KEY = "regexp_replace(CASE WHEN regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) END, '\\?.*$', '')"


@query("k5_normalised_keys", f"SELECT 1 AS series, {_KEY} AS key, R(AVG(length(html))) AS value FROM pages GROUP BY 2")
def normalised_keys(spark, folder):
    pages = T.table(spark, folder, "pages")
    series = pages.select(F.lit(1).alias("series"), F.col("url").alias("key"), F.length("html").cast("double").alias("value"))
    return S.normalise_keys(series)


_FLOOR = f"""{_PAIR}, f AS (SELECT s, key, CASE WHEN y < 40 THEN 0 ELSE y END AS y, CASE WHEN x < 40 THEN 0 ELSE x END AS x FROM y JOIN x USING (s, key))"""


def _with_zeros(spark, folder):
    pairs = _pairs(spark, folder)
    return pairs.select("series", "key", *[F.when(F.col(c) < 40, 0.0).otherwise(F.col(c)).alias(c) for c in ("y", "x")])


@query("k6_zeros_removed", f"WITH {_FLOOR} SELECT s AS series, key, R(y) AS y, R(x) AS x FROM f WHERE y <> 0 AND x <> 0")
def zeros_removed(spark, folder):
    return S.handle_zeros(_with_zeros(spark, folder), "remove")


@query(
    "k6_zeros_trimmed",
    f"""WITH {_FLOOR}, e AS (SELECT s, MIN(key) AS a, MAX(key) AS b FROM f WHERE y <> 0 OR x <> 0 GROUP BY s)
    SELECT f.s AS series, key, R(y) AS y, R(x) AS x FROM f JOIN e ON f.s = e.s WHERE key BETWEEN a AND b""",
)
def zeros_trimmed(spark, folder):
    return S.handle_zeros(_with_zeros(spark, folder), "trim")


@query(
    "k7_grouped_tail",
    f"""WITH {_PAIR}, p AS (SELECT s, key, y, x, row_number() OVER (PARTITION BY s ORDER BY x, key) AS rn, COUNT(*) OVER (PARTITION BY s) AS n FROM y JOIN x USING (s, key)),
    m AS (SELECT *, n >= 3 AND rn <= GREATEST(1, LEAST(CEIL(n * 25.0 / 100), n - 1)) AS low FROM p)
    SELECT s AS series, CASE WHEN low THEN 'others' ELSE CAST(key AS VARCHAR) END AS key, R(AVG(y)) AS y, R(AVG(x)) AS x FROM m GROUP BY s, low, 2""",
)
def grouped_tail(spark, folder):
    return S.group_tail(_pairs(spark, folder), 25)


@query(
    "k8_guards",
    f"""WITH {_PAIR}, p AS (SELECT s, COUNT(*) AS points, MAX(x) - MIN(x) AS x_range, MAX(y) - MIN(y) AS y_range FROM y JOIN x USING (s, key) GROUP BY s)
    SELECT s AS series, points, R(x_range) AS x_range, R(y_range) AS y_range, CASE WHEN points < 2 THEN 'too_few_points' WHEN x_range < 1e-9 THEN 'constant_x' WHEN y_range < 1e-9 THEN 'constant_y' END AS reason FROM p""",
)
def guards(spark, folder):
    return S.guard(_pairs(spark, folder))


@query(
    "k9_regression",
    f"""WITH {_PAIR}, p AS (SELECT s, y, x FROM y JOIN x USING (s, key)), g AS (SELECT s FROM p GROUP BY s HAVING COUNT(*) >= 2 AND MAX(x) - MIN(x) >= 1e-9 AND MAX(y) - MIN(y) >= 1e-9)
    SELECT s AS series, R(regr_slope(y, x)) AS slope, R(regr_intercept(y, x)) AS intercept, R(regr_r2(y, x)) AS r2, COUNT(*) AS points FROM p SEMI JOIN g USING (s) GROUP BY s""",
)
def regression(spark, folder):
    return stats.regression(S.usable(_pairs(spark, folder)))


@query(
    "k10_elasticity",
    f"""WITH {_PAIR}, p AS (SELECT s, CASE WHEN y > 0 AND x > 0 THEN ln(y) END AS ly, CASE WHEN y > 0 AND x > 0 THEN ln(x) END AS lx FROM y JOIN x USING (s, key))
    SELECT s AS series, R(CASE WHEN COUNT(ly) > 1 THEN regr_slope(ly, lx) END) AS elasticity, COUNT(ly) AS points FROM p GROUP BY s""",
)
def elasticity(spark, folder):
    return stats.elasticity(_pairs(spark, folder))


@query(
    "k11_granger",
    f"""WITH {_PAIR}, l AS (SELECT s, y AS t, LAG(y) OVER w AS a, LAG(x) OVER w AS b FROM y JOIN x USING (s, key) WINDOW w AS (PARTITION BY s ORDER BY key)),
    m AS (SELECT s, COUNT(a) AS n, var_pop(a) * COUNT(a) AS saa, var_pop(b) * COUNT(a) AS sbb, covar_pop(a, b) * COUNT(a) AS sab, covar_pop(a, t) * COUNT(a) AS sat,
      covar_pop(b, t) * COUNT(a) AS sbt, var_pop(t) FILTER (a IS NOT NULL) * COUNT(a) AS stt FROM l GROUP BY s),
    c AS (SELECT *, CASE WHEN n > 3 THEN saa * sbb - sab * sab END AS det FROM m),
    e AS (SELECT *, CASE WHEN det > 1e-9 * saa * sbb THEN (sat * sbb - sbt * sab) / det END AS ba, CASE WHEN det > 1e-9 * saa * sbb THEN (sbt * saa - sat * sab) / det END AS bb FROM c),
    f AS (SELECT *, stt - sat / saa * sat AS own, stt - ba * sat - bb * sbt AS full_ FROM e)
    SELECT s AS series, n AS points, R(bb) AS lag_effect, R(CASE WHEN full_ > 1e-9 * stt THEN (own - full_) / (full_ / (n - 3)) END) AS f_statistic FROM f""",
    digits=3,
)
def granger(spark, folder):
    return stats.granger(_pairs(spark, folder))


_ONE = "v AS (SELECT user_id AS s, CAST(ts AS DATE) AS key, SUM(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)"


@query(
    "k12_autocorrelation",
    f"""WITH {_ONE}, l AS (SELECT s, value, LAG(value, 1) OVER w AS l1, LAG(value, 2) OVER w AS l2 FROM v WINDOW w AS (PARTITION BY s ORDER BY key))
    SELECT s AS series, CAST(1 AS INT) AS lag, R(CASE WHEN COUNT(l1) > 1 THEN corr(value, l1) END) AS correlation FROM l GROUP BY s
    UNION ALL SELECT s, 2, R(CASE WHEN COUNT(l2) > 1 THEN corr(value, l2) END) FROM l GROUP BY s""",
)
def autocorrelation(spark, folder):
    return stats.autocorrelation(_series(spark, folder, "click"), 2)


def _ema(name, source, span, table="r", by="rn"):
    """Recursive SQL of an exponential average with the given span."""
    return f"""{name} AS (SELECT s, rn, {source} AS e FROM {table} WHERE rn = 1 UNION ALL
      SELECT n.s, n.rn, n.{source} * (2.0::DOUBLE / {span + 1}) + p.e * (1 - 2.0::DOUBLE / {span + 1}) FROM {name} p JOIN {table} n ON n.s = p.s AND n.rn = p.rn + 1)"""


_RANKED = f"{_ONE}, r AS (SELECT s, key, value, row_number() OVER (PARTITION BY s ORDER BY key) AS rn FROM v)"


@query(
    "k13_macd",
    f"""WITH RECURSIVE {_RANKED}, {_ema('f', 'value', 12)}, {_ema('w', 'value', 26)}, d AS (SELECT r.s, r.rn, r.key, f.e - w.e AS value FROM r JOIN f USING (s, rn) JOIN w USING (s, rn)),
    {_ema('g', 'value', 9, 'd')}
    SELECT d.s AS series, d.key, R(d.value) AS macd, R(g.e) AS signal, R(d.value - g.e) AS histogram FROM d JOIN g USING (s, rn)""",
)
def macd(spark, folder):
    return stats.macd(_series(spark, folder, "click"))


@query(
    "k14_anomalies",
    f"""WITH {_ONE}, m AS (SELECT s, AVG(value) AS a, CASE WHEN COUNT(*) > 1 THEN stddev_samp(value) END AS d FROM v GROUP BY s)
    SELECT v.s AS series, key, R(value) AS value, R((value - a) / NULLIF(d, 0)) AS z_score, COALESCE(ABS((value - a) / NULLIF(d, 0)) > 1.5, FALSE) AS is_anomaly FROM v JOIN m ON v.s = m.s""",
)
def anomalies(spark, folder):
    return stats.anomalies(_series(spark, folder, "click"), 1.5)


def _trend(name, x, logarithmic):
    line = ", ".join(f"R(CASE WHEN COUNT(*) > 1 THEN regr_{f}(value, {x}) END) AS {n}" for f, n in (("slope", "slope"), ("intercept", "intercept"), ("r2", "r2")))

    @query(name, f"WITH {_RANKED} SELECT s AS series, {line} FROM r GROUP BY s")
    def trend(spark, folder):
        return stats.trend(_series(spark, folder, "click"), logarithmic)


_trend("k15_linear_trend", "rn - 1", False)
_trend("k15_logarithmic_trend", "ln(rn)", True)


@query(
    "k16_moving_average",
    f"WITH {_ONE} SELECT s AS series, key, R(value) AS value, R(AVG(value) OVER (PARTITION BY s ORDER BY key ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS sma FROM v",
)
def moving_average(spark, folder):
    return stats.moving_average(_series(spark, folder, "click"), 7)


@query(
    "k17_exponential_average",
    f"WITH RECURSIVE {_RANKED}, {_ema('f', 'value', 7)} SELECT r.s AS series, r.key, R(r.value) AS value, R(f.e) AS ema FROM r JOIN f USING (s, rn)",
)
def exponential_average(spark, folder):
    return stats.exponential_average(_series(spark, folder, "click"), 7)


@query(
    "k17_holt_winters",
    """WITH RECURSIVE v AS (SELECT event_type AS s, CAST(ts AS DATE) AS key, SUM(value) AS value FROM events GROUP BY 1, 2),
    r AS (SELECT s, key, value, row_number() OVER (PARTITION BY s ORDER BY key) AS rn FROM v),
    i AS (SELECT s, AVG(value) FILTER (rn <= 7) AS l0, (AVG(value) FILTER (rn BETWEEN 8 AND 14) - AVG(value) FILTER (rn <= 7)) / 7 AS t0 FROM r GROUP BY s),
    h AS (SELECT i.s, CAST(0 AS BIGINT) AS rn, l0 AS level, t0 AS trend, [x - l0 for x in list(r.value ORDER BY r.rn)] AS offs, CAST(NULL AS DOUBLE) AS fit
          FROM i JOIN r ON r.s = i.s AND r.rn <= 7 GROUP BY i.s, l0, t0
          UNION ALL
          SELECT s, rn, nl, 0.3::DOUBLE * (nl - level) + 0.7::DOUBLE * trend, list_append(offs[2:], 0.2::DOUBLE * (value - nl) + 0.8::DOUBLE * offs[1]), level + trend + offs[1]
          FROM (SELECT h.s, r.rn, r.value, h.level, h.trend, h.offs, 0.5::DOUBLE * (r.value - h.offs[1]) + 0.5::DOUBLE * (h.level + h.trend) AS nl FROM h JOIN r ON r.s = h.s AND r.rn = h.rn + 1))
    SELECT r.s AS series, r.key, R(r.value) AS value, R(h.fit) AS fit FROM r JOIN h USING (s, rn)""",
)
def holt_winters(spark, folder):
    events = T.table(spark, folder, "events")
    series = events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("key")).agg(F.sum("value").alias("value"))
    return stats.holt_winters(series)


def _alerts(spark, folder):
    """One alert per customer, thresholds and method from the customer row."""
    balance = F.col("c_acctbal")
    return T.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("alert_id"),
        F.lit(1).alias("line_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "sum")
        .when(F.col("c_mktsegment") == "MACHINERY", "avg")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "min")
        .when(F.col("c_mktsegment") == "FURNITURE", "max")
        .alias("aggregation_method"),
        F.when(balance > 0, balance / 50).alias("upper_limit"),
        F.when(balance < 3000, F.lit(20.0)).alias("lower_limit"),
        (balance > -500).alias("is_active"),
        F.when(balance > 1000, F.to_timestamp(F.lit("2024-01-10"))).otherwise(F.to_timestamp(F.lit("2024-02-10"))).alias("next_evaluation_at"),
    )


@query(
    "k18_alert_status",
    f"""WITH {_ONE}, r AS (SELECT s, SUM(value) AS su, AVG(value) AS av, MIN(value) AS mi, MAX(value) AS ma, arg_max(value, key) AS la FROM v GROUP BY s),
    e AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal / 50 END AS up, CASE WHEN c_acctbal < 3000 THEN 20.0::DOUBLE END AS lo,
      COALESCE(CASE c_mktsegment WHEN 'BUILDING' THEN su WHEN 'MACHINERY' THEN av WHEN 'HOUSEHOLD' THEN mi WHEN 'FURNITURE' THEN ma ELSE la END, 0) AS ev FROM customer LEFT JOIN r ON s = c_custkey)
    SELECT c_custkey AS alert_id, CAST(1 AS INT) AS line_id, R(ev) AS evaluated_value, CASE WHEN ev > up OR ev < lo THEN 'triggered' ELSE 'ok' END AS status,
    CASE WHEN ev > up THEN 'upper' WHEN ev < lo THEN 'lower' END AS threshold_type, R(CASE WHEN ev > up THEN up WHEN ev < lo THEN lo END) AS threshold_value FROM e""",
)
def alert_status(spark, folder):
    series = _series(spark, folder, "click").select(F.col("series").alias("alert_id"), F.lit(1).alias("line_id"), "key", "value")
    return A.evaluate_alerts(_alerts(spark, folder), series)


_WATCHED = (
    (1, metric("events.clicks"), "sum", 100.0, None),
    (2, op("/", metric("events.spend"), metric("events.clicks")), "avg", None, 45.0),
    (3, metric("events.impressions"), "max", 1e9, 1.0),
    (4, op("-", metric("events.results"), metric("events.clicks")), "latest", None, None),
)


@query(
    "k18_alerts_from_trees",
    f"""WITH {EVENTS}, p AS (SELECT d, {CLICKS} AS c, {SPEND} AS s, {VIEWS} AS i, {RESULTS} AS r FROM ev GROUP BY d),
    e AS (SELECT 1 AS alert_id, SUM(c) AS ev, 100.0::DOUBLE AS up, CAST(NULL AS DOUBLE) AS lo FROM p UNION ALL SELECT 2, AVG(COALESCE(s / NULLIF(c, 0), 0)), NULL, 45.0 FROM p
      UNION ALL SELECT 3, MAX(i), 1e9, 1.0 FROM p UNION ALL SELECT 4, arg_max(r - c, d), NULL, NULL FROM p)
    SELECT CAST(alert_id AS BIGINT) AS alert_id, CAST(1 AS BIGINT) AS line_id, R(ev) AS evaluated_value, CASE WHEN ev > up OR ev < lo THEN 'triggered' ELSE 'ok' END AS status,
    CASE WHEN ev > up THEN 'upper' WHEN ev < lo THEN 'lower' END AS threshold_type, R(CASE WHEN ev > up THEN up WHEN ev < lo THEN lo END) AS threshold_value FROM e""",
)
def alerts_from_trees(spark, folder):
    lines = [{"alert_id": i, "line_id": 1, "tree": tree} for i, tree, *_ in _WATCHED]
    alerts = spark.createDataFrame([(i, 1, *rest) for i, _, *rest in _WATCHED], "alert_id long, line_id long, aggregation_method string, upper_limit double, lower_limit double")
    return A.evaluate_alerts(alerts, A.alert_series(T.event_star(spark, folder), lines, *JANUARY))


# Alert lines over ads facts: ten shapes of tree, each watched for five shares of the audience.
_AUDIENCES = [{"dimensions.gender": "A"}, {"dimensions.gender": "N"}, {"dimensions.gender": "R"}, {"dimensions.age": "O"}, {"dimensions.age": "F"}]
_SHAPES = (
    (metric("clicks"), "c"),
    (metric("spend"), "s"),
    (op("/", metric("spend"), metric("clicks")), "COALESCE(s / NULLIF(c, 0), 0)"),
    (op("+", metric("clicks"), metric("impressions")), "c + i"),
    (op("-", metric("impressions"), metric("results")), "i - r"),
    (op("max", metric("results"), metric("clicks")), "GREATEST(r, c)"),
    (op("min", metric("results"), metric("clicks")), "LEAST(r, c)"),
    (op("avg", metric("impressions"), metric("clicks")), "(i + c) / 2"),
    (op("abs_diff", metric("impressions"), metric("clicks")), "ABS(i - c)"),
    (op("*", metric("clicks"), metric("results")), "c * r"),
)
_LINES = [(5 * n + k + 1, k, n) for n in range(len(_SHAPES)) for k in range(5)]
_PARTS = " UNION ALL ".join(
    f"SELECT {k} AS k, d, {CLICKS} AS c, {SPEND} AS s, {VIEWS} AS i, {RESULTS} AS r FROM ad WHERE {name.partition('.')[2]} = '{value}' GROUP BY d"
    for k, audience in enumerate(_AUDIENCES)
    for name, value in audience.items()
)


@query(
    "k18_alerts_over_shared_leaves",
    f"""WITH {ADS}, p AS ({_PARTS}), e AS ({" UNION ALL ".join(f"SELECT 5 * {n} + k + 1 AS alert_id, AVG({sql}) AS ev FROM p GROUP BY k" for n, (_, sql) in enumerate(_SHAPES))})
    SELECT CAST(alert_id AS BIGINT) AS alert_id, CAST(1 AS BIGINT) AS line_id, R(ev) AS evaluated_value, CASE WHEN ev > 100 THEN 'triggered' ELSE 'ok' END AS status,
    CASE WHEN ev > 100 THEN 'upper' END AS threshold_type, R(CASE WHEN ev > 100 THEN 100 END) AS threshold_value FROM e""",
)
def alerts_over_shared_leaves(spark, folder):
    """50 alert lines over five filter sets read the facts five times."""
    lines = [{"alert_id": i, "line_id": 1, "tree": _SHAPES[n][0], "filters": _AUDIENCES[k]} for i, k, n in _LINES]
    alerts = spark.createDataFrame([(i, 1, "avg", 100.0, None) for i, *_ in _LINES], "alert_id long, line_id long, aggregation_method string, upper_limit double, lower_limit double")
    return A.evaluate_alerts(alerts, A.alert_series(T.ads_star(spark, folder), lines))


@query("k19_due_alerts", "SELECT c_custkey AS alert_id FROM customer WHERE c_acctbal > -500 AND c_acctbal > 1000")
def due(spark, folder):
    return A.due_alerts(_alerts(spark, folder), "2024-01-20 09:00:00").select("alert_id")


_NOW = "TIMESTAMP '2024-01-31 09:30:00'"


@query(
    "k19_next_evaluation",
    """WITH a AS (SELECT c_custkey, c_mktsegment, 1 + CAST(c_custkey % 7 AS INT) AS dow, CASE WHEN c_acctbal > 0 THEN 10 ELSE 8 END AS h FROM customer),
    n AS (SELECT *, DATE '2024-01-31' + CAST(((dow - 1 - 2 + 13) % 7) + 1 AS INT) AS nd FROM a)
    SELECT c_custkey AS alert_id, CASE c_mktsegment WHEN 'BUILDING' THEN (CASE WHEN h = 10 THEN DATE '2024-01-31' ELSE DATE '2024-02-01' END) + to_hours(h)
      WHEN 'MACHINERY' THEN nd + to_hours(h) WHEN 'HOUSEHOLD' THEN nd + 7 + to_hours(h) WHEN 'FURNITURE' THEN DATE '2024-03-02' + to_hours(h) END AS next_evaluation_at FROM n""",
)
def next_evaluation(spark, folder):
    segment = F.col("c_mktsegment")
    alerts = T.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("alert_id"),
        F.when(segment == "BUILDING", "daily")
        .when(segment == "MACHINERY", "weekly")
        .when(segment == "HOUSEHOLD", "biweekly")
        .when(segment == "FURNITURE", "monthly")
        .otherwise("once")
        .alias("schedule_type"),
        F.when(F.col("c_acctbal") > 0, "10:00").otherwise("08:00").alias("time_of_day"),
        (F.col("c_custkey") % 7 + 1).cast("int").alias("day_of_week"),
    )
    planned = A.with_next_evaluation(alerts, "2024-01-31 09:30:00")
    return planned.select("alert_id", F.col("next_evaluation_at").cast("timestamp_ntz").alias("next_evaluation_at"))
