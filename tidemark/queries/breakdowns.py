"""Ads hierarchy breakdowns, page summaries, linked pages, post tables."""

from __future__ import annotations

from tidemark.plans.hierarchy import hierarchy_breakdown
from tidemark.plans.social import linked_pages, page_summary, post_table
from tidemark.queries.registry import ACCOUNTS, ADS, ORGANIC, PAGES, query, ratio, sums
from tidemark.sources import tables as T

DATES = ("1996-01-01", "1998-12-31")
MEASURES = {"clicks": "clicks", "spend": "spend", "ctr": "ctr"}
_MEASURES = f"R({sums('clicks')}) AS clicks, R({sums('spend')}) AS spend, R({ratio(sums('clicks'), sums('impressions'))}) AS ctr"
_RANGE = "d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"


def _breakdown(name, keys, scope, where, daily=False, join=""):
    days = "d AS daily, " if daily else ""
    sql = f"WITH {ADS} SELECT {days}{keys}, {_MEASURES} FROM ad {join} WHERE {_RANGE} {where} GROUP BY ALL"
    if join:
        sql = sql.replace("CASE WHEN name", "CASE WHEN ad.name")

    @query(f"e8_{name.replace('+', '_')}{'_daily' if daily else ''}", sql, digits=3)
    def build(spark, folder):
        return hierarchy_breakdown(T.ads_star(spark, folder), name, MEASURES, *DATES, scope=scope, daily=daily)


_breakdown("age", "age", {"channeledCampaign": 12}, "AND campaign = 12")
_breakdown("gender", "gender", {"adGroup": 5}, "AND ad_group = 5", daily=True)
_breakdown("age+gender", "age, gender", None, "")
_breakdown("ad", "COALESCE(p_name, CAST(ad AS VARCHAR), 'Unknown') AS ad, ad.ad AS ad_id", {"adGroup": 5}, "AND ad_group = 5", join="LEFT JOIN part ON ad.ad = p_partkey")
_breakdown(
    "adgroup",
    "COALESCE(s_name, CAST(ad_group AS VARCHAR), 'Unknown') AS adGroup, ad_group AS adGroup_id",
    {"ad": 7},
    "AND ad = 7",
    daily=True,
    join="LEFT JOIN supplier ON ad_group = s_suppkey",
)

_JANUARY = ("2024-01-01", "2024-01-31")
_FOLLOWS = "R(SUM(CASE WHEN og.name = 'follows' AND period = 'daily' THEN value ELSE 0 END)) AS follows"


@query(
    "e9_page_summary",
    f"""WITH {ORGANIC}, {ACCOUNTS}, {PAGES} SELECT COALESCE(url, 'N/A') AS page, page_id, COALESCE(title, 'N/A') AS page_title, {_FOLLOWS}
    FROM og JOIN accounts a ON acc = a.id LEFT JOIN pg ON page_id = pg.id
    WHERE post_id IS NULL AND a.type = 'machinery' AND COALESCE(pg.platform_id, a.entity) = 'pg-7' GROUP BY ALL""",
)
def page_summary_query(spark, folder):
    return page_summary(T.organic_star(spark, folder), {"follows": "follows"}, *_JANUARY, "Machinery", "pg-7", channel="facebook_organic")


@query(
    "e10_linked_pages",
    f"""WITH {ORGANIC}, {ACCOUNTS}, {PAGES} SELECT acc AS channeled_account_id, COALESCE(a.name, 'N/A') AS channeledaccount,
    a.entity AS linked_platform_entity_id, COALESCE(pg.platform_id, 'N/A') AS page_platform_id, {_FOLLOWS}
    FROM og JOIN accounts a ON acc = a.id LEFT JOIN pg ON page_id = pg.id
    WHERE post_id IS NULL AND a.type = 'building' AND acc IN (1, 2, 3, 4, 5, 6, 7, 8, 9) GROUP BY ALL""",
)
def linked_pages_query(spark, folder):
    return linked_pages(
        T.organic_star(spark, folder), {"follows": "follows"}, *_JANUARY, "building", accounts=list(range(1, 10))
    )


_POST = """CASE WHEN p.page_id IS NOT NULL THEN title END AS caption, CASE WHEN p.page_id IS NOT NULL THEN '2024-01-01' END AS created_time,
    split_part(url, ':', 1) AS media_type, CASE WHEN p.page_id IS NOT NULL THEN title END AS message, url AS permalink, url AS permalink_url, p.page_id AS post,
    CASE WHEN p.page_id IS NOT NULL THEN 'pg_' || p.page_id END AS post_id, CASE WHEN p.page_id IS NOT NULL THEN '2024-01-01' END AS timestamp"""


def _posts(name, latest):
    agg = "MAX" if latest else "SUM"
    picks = ", ".join(
        f"R({agg}(CASE WHEN name = '{m}' AND period = 'lifetime' THEN value ELSE 0 END)) AS {m}" for m in ("likes", "shares", "comments")
    )
    sql = f"""WITH {ORGANIC}, p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
    SELECT {_POST}, {picks} FROM og LEFT JOIN p ON og.post_id = p.page_id WHERE og.page_id BETWEEN 10 AND 60 GROUP BY ALL"""

    @query(name, sql)
    def build(spark, folder):
        measures = {m: m for m in ("likes", "shares", "comments")}
        return post_table(T.organic_star(spark, folder), measures, *_JANUARY, pages=list(range(10, 61)), latest_snapshot=latest)


_posts("e11_post_table", False)
_posts("d11_post_table_latest", True)
