"""Page and post reports of organic channels."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import conditions as C
from tidemark.functions.dates import in_range
from tidemark.functions.formulas import FactColumns, MetricDictionary
from tidemark.model import Star

# JSON attributes of a post and the output columns they fill.
POST_ATTRIBUTES = {
    "caption": "caption",
    "created_time": "timestamp",
    "media_type": "media_type",
    "message": "caption",
    "permalink": "permalink",
    "permalink_url": "permalink",
    "timestamp": "timestamp",
}
MISSING = "N/A"


def _measures(
    aggregations: Mapping[str, str], channel: str | None, period: str, dictionary: MetricDictionary | None, latest: bool = False
) -> list[Column]:
    dictionary, facts, out = dictionary or MetricDictionary(), FactColumns(), []
    for alias, metric in aggregations.items():
        column = dictionary.expression(metric, channel, facts, "organic", period, latest)
        if column is None:
            raise ValueError(f"no organic metric {metric!r}")
        out.append(column.alias(alias))
    return out


def _totals(star: Star, start: str, end: str, channel: str | None) -> DataFrame:
    """Page-level totals: no post rows and no breakdown rows."""
    frame = star.frame().filter(in_range(F.col("metric_date"), start, end))
    frame = frame.filter(F.col("post_id").isNull() & F.col("dimension_set_id").isNull())
    return frame if channel is None else frame.filter(F.lower("channel") == channel.lower())


def _accounts(star: Star, account_type: str, entity_field: str) -> DataFrame:
    accounts = star.entity("channeled_accounts").filter(F.lower("type") == account_type.lower())
    return accounts.select(
        F.col("id").alias("__account"),
        F.col("name").alias("__account_name"),
        F.get_json_object("data", "$." + entity_field).alias("__entity"),
    )


def page_summary(
    star: Star,
    aggregations: Mapping[str, str],
    start: str,
    end: str,
    account_type: str,
    page_platform_id: str,
    channel: str | None = None,
    entity_field: str = "platform_id",
    dictionary: MetricDictionary | None = None,
) -> DataFrame:
    """Totals of the page with a platform id (its own, else its account's)."""
    pages = star.entity("pages").select(
        F.col("id").alias("__page"), F.col("url"), F.col("title"), F.col("platform_id").cast("string").alias("__platform")
    )
    joined = (
        _totals(star, start, end, channel)
        .join(_accounts(star, account_type, entity_field), F.col("channeled_account_id") == F.col("__account"))
        .join(pages, F.col("page_id") == F.col("__page"), "left")
        .filter(F.coalesce("__platform", "__entity") == page_platform_id)
    )
    keys = [
        F.coalesce("url", F.lit(MISSING)).alias("page"),
        F.col("page_id"),
        F.coalesce("title", F.lit(MISSING)).alias("page_title"),
    ]
    return joined.groupBy(*keys).agg(*_measures(aggregations, channel, "daily", dictionary))


def linked_pages(
    star: Star,
    aggregations: Mapping[str, str],
    start: str,
    end: str,
    account_type: str,
    channel: str | None = None,
    accounts: Any = None,
    pages: Any = None,
    entity_field: str = "platform_id",
    dictionary: MetricDictionary | None = None,
) -> DataFrame:
    """Totals per account with the platform ids of its linked entity and page."""
    frame = _totals(star, start, end, channel)
    for column, raw in (("channeled_account_id", accounts), ("page_id", pages if not accounts else None)):
        if raw:
            frame = frame.filter(F.lit(False)) if C.has_no_numeric_member(raw) else frame.filter(C.id_predicate(F.col(column), raw))
    page_ids = star.entity("pages").select(F.col("id").alias("__page"), F.col("platform_id").cast("string").alias("__platform"))
    joined = frame.join(
        _accounts(star, account_type, entity_field), F.col("channeled_account_id") == F.col("__account")
    ).join(page_ids, F.col("page_id") == F.col("__page"), "left")
    keys = [
        F.col("channeled_account_id"),
        F.coalesce("__account_name", F.lit(MISSING)).alias("channeledaccount"),
        F.col("__entity").alias("linked_platform_entity_id"),
        F.coalesce("__platform", F.lit(MISSING)).alias("page_platform_id"),
    ]
    return joined.groupBy(*keys).agg(*_measures(aggregations, channel, "daily", dictionary))


def post_table(
    star: Star,
    aggregations: Mapping[str, str],
    start: str | None,
    end: str | None,
    accounts: Any = None,
    pages: Any = None,
    posts: Any = None,
    channel: str | None = None,
    latest_snapshot: bool = False,
    dictionary: MetricDictionary | None = None,
) -> DataFrame:
    """Lifetime counters per post with nine post attributes.

    Sums over the range, or the largest value when ``latest_snapshot`` is set.
    Counters are summed by post key before the attributes are looked up.
    """
    frame = star.frame().filter(in_range(F.col("metric_date"), start, end))
    scope, raw = ("channeled_account_id", accounts) if accounts else ("page_id", pages)
    if not raw:
        raise ValueError("a post table needs accounts or pages")
    frame = frame.filter(F.lit(False)) if C.has_no_numeric_member(raw) else frame.filter(C.id_predicate(F.col(scope), raw))
    if channel is not None:
        frame = frame.filter(F.lower("channel") == channel.lower())
    by_platform = posts is not None and C.is_platform_post_id(posts)
    if posts is not None and not by_platform:
        frame = frame.filter(C.id_predicate(F.col("post_id"), posts))
    counted = frame.groupBy(F.col("post_id").alias("__post")).agg(
        *_measures(aggregations, channel, "lifetime", dictionary, latest_snapshot)
    )
    attributes = star.entity("posts").select(
        F.col("id").alias("post"),
        F.col("post_id"),
        *[F.get_json_object("data", "$." + path).alias(name) for name, path in POST_ATTRIBUTES.items()],
    )
    joined = counted.join(attributes, F.col("__post") == F.col("post"), "left")
    if by_platform:
        joined = joined.filter(C.predicate(F.col("post_id"), posts, text=True))
    # Facts without a known post share one row; their counters merge here.
    merge = F.max if latest_snapshot else F.sum
    keys = ["post", "post_id", *POST_ATTRIBUTES]
    return joined.groupBy(*keys).agg(*[merge(a).alias(a) for a in aggregations])
