"""The list of queries and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


# Engines break exact ties of a rounding differently; this factor moves ties off.
TIE_BREAK = 1 + 1e-13


def query(name: str, sql: str | None = None, digits: int = 4, ties: bool = False):
    """Register a query; doubles are rounded so that sums compare across engines.

    ``ties`` is for quotients that often fall halfway between two roundings.
    """
    factor = TIE_BREAK if ties else 1.0

    def wrap(build: Build) -> Build:
        def rounded(spark: SparkSession, folder: str) -> DataFrame:
            df = build(spark, folder)
            return df.select(
                *[
                    F.round(F.col(f"`{n}`") * F.lit(factor) if ties else F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`")
                    for n, t in df.dtypes
                ]
            )

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, rounded, _expand(sql, digits, factor) if sql else None)
        return build

    return wrap


def _expand(sql: str, digits: int, factor: float) -> str:
    """Write out ``R(x)``, which stands for rounding as the Spark side does."""
    out, i = [], 0
    times = "" if factor == 1.0 else f" * CAST({factor!r} AS DOUBLE)"
    while True:
        j = sql.find("R(", i)
        while j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            j = sql.find("R(", j + 1)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 1, j + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(sql[i:j] + "ROUND(CAST(" + _expand(sql[j + 2 : k - 1], digits, factor) + f" AS DOUBLE){times}, {digits})")
        i = k


def sums(*names: str, period: str | None = None, alias: str = "") -> str:
    """Conditional sum in SQL over the facts of the named metrics."""
    listed = ", ".join(f"'{n}'" for n in names)
    more = f" AND period = '{period}'" if period else ""
    return f"SUM(CASE WHEN {alias}name IN ({listed}){more} THEN {alias}value ELSE 0 END)"


def ratio(top: str, bottom: str) -> str:
    return f"{top} / NULLIF({bottom}, 0)"


# Facts as SQL, the same selects as in sources/tables.py.
EVENTS = """ev AS (
  SELECT 'events' AS channel,
         CASE event_type WHEN 'view' THEN 'impressions' WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'results'
                         WHEN 'signup' THEN 'sessions' WHEN 'error' THEN 'event_count' END AS name,
         CAST(1 AS DOUBLE) AS value, CAST(ts AS DATE) AS d, user_id AS acc, json_extract_string(props, '$.k') AS k
  FROM events
  UNION ALL
  SELECT 'events', 'spend', value, CAST(ts AS DATE), user_id, json_extract_string(props, '$.k')
  FROM events WHERE event_type = 'click')"""

ORGANIC = """og AS (
  SELECT CASE event_type WHEN 'view' THEN 'views' WHEN 'click' THEN 'likes' WHEN 'purchase' THEN 'shares'
                         WHEN 'signup' THEN 'follows' WHEN 'error' THEN 'comments' END AS name,
         CASE WHEN event_type = 'signup' THEN 'daily' ELSE 'lifetime' END AS period, value, CAST(ts AS DATE) AS d,
         user_id AS acc, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_id,
         CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS post_id
  FROM events)"""

ADS = """ad AS (
  SELECT m.name, m.value, CAST(l.l_shipdate AS DATE) AS d, CAST(c.c_nationkey AS BIGINT) AS acc, o.o_custkey AS campaign,
         l.l_suppkey AS ad_group, l.l_partkey AS ad, l.l_returnflag AS gender, l.l_linestatus AS age
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey,
       LATERAL (VALUES ('spend', l.l_extendedprice), ('impressions', l.l_quantity * 100),
                       ('clicks', ROUND(l.l_tax * 100)), ('results', ROUND(l.l_discount * 100))) AS m(name, value))"""

SEARCH = """se AS (
  SELECT m.name, m.value, CAST(l.l_shipdate AS DATE) AS d, l.l_partkey AS page, l.l_suppkey AS query,
         l.l_returnflag AS device, l.l_linestatus AS dimset
  FROM lineitem l,
       LATERAL (VALUES ('position', ROUND(l.l_discount * 100) + 1), ('impressions', l.l_quantity),
                       ('clicks', ROUND(l.l_tax * 100))) AS m(name, value))"""

LIFETIME = """lt AS (
  SELECT CASE event_type WHEN 'view' THEN 'impressions' WHEN 'click' THEN 'clicks' WHEN 'purchase' THEN 'results'
                         WHEN 'signup' THEN 'sessions' WHEN 'error' THEN 'event_count' END AS name,
         CAST(SUM(n) OVER (PARTITION BY user_id, event_type ORDER BY d) AS DOUBLE) AS value, d, user_id AS acc
  FROM (SELECT user_id, event_type, CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1, 2, 3))"""

JOBS = """jobs AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'P' THEN 2 WHEN o_orderstatus = 'F' AND o_totalprice < 400000 THEN 3
              WHEN o_orderstatus = 'F' THEN 4 WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) <= 3 THEN 1
              WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) = 4 THEN 5 ELSE 6 END AS status,
         'ch' || substr(o_orderpriority, 1, 1) AS channel,
         6 - CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority,
         CASE WHEN o_totalprice < 480000 THEN 'acc-' || o_custkey END AS account_id,
         'ch' || substr(o_orderpriority, 1, 1) || CASE WHEN o_totalprice < 100000 THEN '-recent' ELSE '-history' END AS instance_name,
         o_totalprice < 100000 AS recent,
         CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + 2 AS last_day,
         o_orderdate AS created_at, o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) AS updated_at
  FROM orders)"""

ACCOUNTS = """accounts AS (
  SELECT c_custkey AS id, c_name AS name, 'acc-' || c_custkey AS platform_id, lower(c_mktsegment) AS type,
         c_acctbal >= 0 AS enabled, 'ent-' || c_nationkey AS entity FROM customer)"""

PAGES = """pg AS (
  SELECT page_id AS id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, 'pg-' || page_id AS platform_id
  FROM pages)"""
