"""Breakdowns of the ads hierarchy under a campaign, ad group or ad."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tidemark.functions.formulas import MetricDictionary
from tidemark.model import Star
from tidemark.plans.request import AggregateRequest, aggregate

# Breakdowns offered, each with or without "daily".
BREAKDOWNS = {
    "age": ("age",),
    "gender": ("gender",),
    "age+gender": ("age", "gender"),
    "ad": ("ad",),
    "adgroup": ("adGroup",),
}
SCOPES = ("channeledCampaign", "adGroup", "ad", "channel")


def hierarchy_breakdown(
    star: Star,
    breakdown: str,
    aggregations: Mapping[str, str],
    start_date: str,
    end_date: str,
    scope: Mapping[str, Any] | None = None,
    daily: bool = False,
    order_by: str | None = None,
    order_dir: str = "ASC",
    dictionary: MetricDictionary | None = None,
) -> DataFrame:
    """Metrics by audience or by level, within the given part of the hierarchy."""
    if breakdown not in BREAKDOWNS:
        raise ValueError(f"unknown breakdown {breakdown!r}; choose from {sorted(BREAKDOWNS)}")
    filters = {k: v for k, v in (scope or {}).items() if v is not None}
    unknown = set(filters) - set(SCOPES)
    if unknown:
        raise ValueError(f"cannot scope a breakdown by {sorted(unknown)}")
    fields: Sequence[str] = BREAKDOWNS[breakdown]
    request = AggregateRequest(
        aggregations=aggregations,
        group_by=(["daily"] if daily else []) + list(fields),
        filters=filters,
        start_date=start_date,
        end_date=end_date,
        order_by=order_by,
        order_dir=order_dir,
    )
    return aggregate(star, request, dictionary)
