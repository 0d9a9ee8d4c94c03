"""Metric names, their dictionaries, and the aggregate each one stands for."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of canonical metrics.
ALIASES = {
    "results": "conversions",
    "cost_per_result": "cost_per_conversion",
    "result_rate": "conversion_rate",
    "roas": "roas_purchase",
    "website_roas": "roas_purchase",
    "purchase_roas": "roas_purchase",
    "website_purchase_roas": "roas_purchase",
}
# Names that were dropped and now mean several things at once.
AMBIGUOUS = ("actions",)

# Raw names per canonical metric where no override applies.
DEFAULT_MARKETING_NAMES = {
    "spend": ["spend", "spend_daily"],
    "clicks": ["clicks", "clicks_daily"],
    "impressions": ["impressions", "impressions_daily"],
    "reach": ["reach", "reach_daily"],
    "frequency": ["frequency", "frequency_daily"],
    "conversions": ["results", "results_daily"],
    "roas_purchase": ["purchase_roas", "purchase_roas_daily"],
}
DEFAULT_ORGANIC_NAMES = {
    **{
        name: [name, f"{name}_daily"]
        for name in (
            "likes",
            "comments",
            "content_views",
            "shares",
            "reach",
            "views",
            "follows",
            "follows_and_unfollows",
            "ig_reels_avg_watch_time",
            "ig_reels_video_view_total_time",
            "profile_activity",
            "profile_visits",
            "reposts",
            "saved",
            "total_interactions",
        )
    },
    "conversions": ["results", "results_daily"],
}
DEFAULT_SEARCH_NAMES = {
    "clicks": ["clicks"],
    "impressions": ["impressions"],
    "ctr": ["ctr"],
    "position": ["position"],
}
DEFAULT_NAMES = {
    "marketing": DEFAULT_MARKETING_NAMES,
    "organic": DEFAULT_ORGANIC_NAMES,
    "search": DEFAULT_SEARCH_NAMES,
}

# Which canonical metrics sum, average, or divide two sums.
MARKETING_SUMS = (
    "spend",
    "clicks",
    "impressions",
    "reach",
    "conversions",
    "actions",
    "sessions",
    "new_users",
    "event_count",
    "total_users",
    "total_revenue",
)
MARKETING_AVERAGES = ("frequency", "roas_purchase", "bounce_rate", "average_session_duration")
MARKETING_RATIOS = {
    "ctr": ("clicks", "impressions", 1.0),
    "cpc": ("spend", "clicks", 1.0),
    "cpm": ("spend", "impressions", 1000.0),
    "cost_per_conversion": ("spend", "conversions", 1.0),
    "conversion_rate": ("conversions", "impressions", 1.0),
}
ORGANIC_SUMS = (
    "likes",
    "comments",
    "content_views",
    "views",
    "page_views_total",
    "video_views",
    "profile_views",
    "website_clicks",
    "profile_links_taps",
    "follows_and_unfollows",
    "saves",
    "shares",
    "total_interactions",
    "replies",
    "accounts_engaged",
    "post_clicks",
    "ig_reels_avg_watch_time",
    "ig_reels_video_view_total_time",
    "profile_activity",
    "profile_visits",
    "reposts",
    "follows",
    "reach",
    "post_video_avg_time_watched",
)
# Metrics averaged with a weight, and the weight metric's names.
WEIGHTED_METRICS = {"position": ("impressions",)}
# Averages over time, and the total each is an average of.
TIME_WEIGHTED_METRICS = {"ig_reels_avg_watch_time": "ig_reels_video_view_total_time"}

# The named formula library, as the metric each name sums,
# averages ("avg:") or divides ("a/b" or "a/b*factor").
FORMULA_LIBRARY = {
    "spend": "spend",
    "clicks": "clicks",
    "impressions": "impressions",
    "reach": "reach",
    "frequency_ratio": "impressions/reach",
    "ctr": "clicks/impressions",
    "cpc": "spend/clicks",
    "cpm": "spend/impressions*1000",
    "results": "conversions",
    "cost_per_result": "spend/conversions",
    "result_rate": "conversions/impressions",
    "roas": "avg:roas_purchase",
    "website_roas": "avg:roas_purchase",
    "actions": "actions",
    "purchase_roas": "avg:roas_purchase",
    "website_purchase_roas": "avg:roas_purchase",
    "total_interactions": "total_interactions",
    "profile_views": "profile_views",
    "follower_count": "follower_count",
    "page_impressions": "impressions",
    "page_post_engagements": "total_interactions",
    "page_views_total": "page_views_total",
    "page_fans": "follower_count",
    "post_impressions": "impressions",
    "post_engagement": "total_interactions",
    "likes": "likes",
    "comments": "comments",
    "content_views": "content_views",
    "shares": "shares",
    "saves": "saves",
    "saved": "saves",
    "plays": "views",
    "views": "views",
    "engagement": "total_interactions",
    "video_views": "views",
    "website_clicks": "website_clicks",
    "profile_links_taps": "profile_links_taps",
    "follows_and_unfollows": "follows_and_unfollows",
    "replies": "comments",
    "accounts_engaged": "engagement",
    "follows": "follower_count",
    "ig_reels_avg_watch_time": "ig_reels_avg_watch_time",
    "ig_reels_video_view_total_time": "ig_reels_video_view_total_time",
    "profile_activity": "total_interactions",
    "reposts": "shares",
    "post_clicks": "clicks",
    "post_engagements": "total_interactions",
    "average_session_duration": "avg:average_session_duration",
}
PERIOD_PATTERN = re.compile(r"[a-z0-9_]+")
NOT_METRIC_NAMES = (
    "id",
    "value",
    "period",
    "name",
    "metric_config_id",
    "metric_date",
    "platform_created_at",
    "created_at",
    "date",
)


@dataclass(frozen=True)
class FactColumns:
    """The columns a metric aggregates over, and the names asked for so far.

    ``empty_as_zero`` makes a sum over no facts 0 as well.
    Raw facts carry ``value`` alone. Facts already summed per config carry the
    partial sum, count and maximum, and every metric here merges partials.
    """

    name: Column = field(default_factory=lambda: F.lower(F.col("name")))
    period: Column = field(default_factory=lambda: F.lower(F.col("period")))
    total: Column = field(default_factory=lambda: F.col("value"))
    count: Column | None = None
    largest: Column | None = None
    asked: set[str] = field(default_factory=set)
    empty_as_zero: bool = False

    def matches(self, names: Iterable[str], period: str) -> Column:
        self.asked.update(n.lower() for n in names)
        return self.name.isin([n.lower() for n in names]) & (self.period == period)

    def sum_of(self, names: Iterable[str], period: str = "daily") -> Column:
        total = F.sum(F.when(self.matches(names, period), self.total).otherwise(F.lit(0.0)))
        return F.coalesce(total, F.lit(0.0)) if self.empty_as_zero else total

    def max_of(self, names: Iterable[str], period: str = "daily") -> Column:
        value = self.largest if self.largest is not None else self.total
        return F.max(F.when(self.matches(names, period), value).otherwise(F.lit(0.0)))

    def avg_of(self, names: Iterable[str], period: str = "daily") -> Column:
        if self.count is None:
            return F.avg(F.when(self.matches(names, period), self.total))
        hit = self.matches(names, period)
        return F.sum(F.when(hit, self.total)) / F.nullif(
            F.sum(F.when(hit, self.count)).cast("double"), F.lit(0.0)
        )



def partial_columns(empty_as_zero: bool = False) -> FactColumns:
    return FactColumns(empty_as_zero=empty_as_zero, total=F.col("value_sum"), count=F.col("value_count"), largest=F.col("value_max"))


def safe_period(period: str | None, default: str = "daily") -> str:
    text = str(period or "").strip().lower()
    return text if PERIOD_PATTERN.fullmatch(text) else default.lower()


def canonical_name(metric: str) -> str | None:
    name = metric.strip().lower()
    if name in AMBIGUOUS or not name:
        return None
    return ALIASES.get(name, name)


def associated_names(canonical: str) -> list[str]:
    """A canonical metric's own name and its other names, each with ``_daily``."""
    names = [canonical] + [alias for alias, target in ALIASES.items() if target == canonical]
    return names + [f"{n}_daily" for n in names if not n.endswith("_daily")]


@dataclass(frozen=True)
class MetricDictionary:
    """Raw metric names per channel: project overrides, then the channel's own
    dictionary, then the built-in default; the channel before ``__default__``."""

    overrides: Mapping[str, Mapping[str, Iterable[str] | str]] = field(default_factory=dict)
    drivers: Mapping[str, Mapping[str, Iterable[str] | str]] = field(default_factory=dict)

    def raw_names(self, canonical: str, channel: str | None = None, family: str = "marketing") -> tuple[list[str], str]:
        channel_key = str(channel or "").strip().lower()
        metric = canonical.strip().lower()
        scopes = ([channel_key] if channel_key else []) + ["__default__"]
        for scope in scopes:
            driver = self.drivers.get(scope) if channel_key else None
            built_in = DEFAULT_NAMES[family] if scope == "__default__" else None
            for source, names in (("override", self.overrides.get(scope)), ("driver", driver), ("default", built_in)):
                found = (names or {}).get(metric)
                listed = [found] if isinstance(found, str) else list(found or [])
                cleaned = list(dict.fromkeys(str(n).strip() for n in listed if str(n).strip()))
                if cleaned:
                    return cleaned, source
        return [], "none"

    def resolve(self, metric: str, channel: str | None = None, family: str = "marketing") -> dict:
        """What a requested metric name stands for, in one family."""
        requested = metric.strip().lower()
        canonical = canonical_name(requested)
        name = canonical or (requested if requested in AMBIGUOUS else None)
        known = {
            "marketing": (*MARKETING_SUMS, *MARKETING_AVERAGES, *MARKETING_RATIOS),
            "organic": (*ORGANIC_SUMS, *AMBIGUOUS),
            "search": (*DEFAULT_SEARCH_NAMES, *AMBIGUOUS),
        }[family]
        names, source = self.raw_names(name, channel, family) if name in known else ([], "none")
        return {
            "requested_metric": requested,
            "canonical_metric": canonical,
            "alias_of": ALIASES.get(requested),
            "deprecation": "ambiguous_metric_alias" if requested in AMBIGUOUS else None,
            "raw_names": names,
            "source": source,
        }

    def expression(
        self, metric: str, channel: str | None, facts: FactColumns, family: str, period: str = "daily", latest: bool = False
    ) -> Column | None:
        """Aggregate column of a canonical metric, or None where the family lacks it.

        ``latest`` takes the maximum instead of the sum, for one-snapshot reads.
        """
        requested = metric.strip().lower()
        name = canonical_name(requested) or (requested if requested in AMBIGUOUS else None)
        if name is None:
            return None

        def sum_of(part: str) -> Column | None:
            names, _ = self.raw_names(part, channel, family)
            return facts.sum_of(names, period) if names else None

        if family == "organic":
            if name not in ORGANIC_SUMS:
                return None
            names, _ = self.raw_names(name, channel, family)
            if not names:
                return None
            return facts.max_of(names, period) if latest else facts.sum_of(names, period)
        if name in MARKETING_SUMS:
            return sum_of(name)
        if name in MARKETING_AVERAGES:
            names, _ = self.raw_names(name, channel, family)
            return facts.avg_of(names, period) if names else None
        if name in MARKETING_RATIOS:
            upper, lower, factor = MARKETING_RATIOS[name]
            top, bottom = sum_of(upper), sum_of(lower)
            if top is None or bottom is None:
                return None
            ratio = top / F.nullif(bottom, F.lit(0.0))
            return ratio if factor == 1.0 else ratio * F.lit(factor)
        return None


def library_formula(name: str, facts: FactColumns, period: str = "daily") -> Column | None:
    """A formula of the named library, or None."""
    text = FORMULA_LIBRARY.get(name)
    if text is None:
        return None

    def names_of(part: str) -> list[str]:
        return [part] if part in AMBIGUOUS or part.startswith("ig_reels_") else associated_names(part)

    if text.startswith("avg:"):
        return facts.avg_of(names_of(text[4:]), period)
    if "/" not in text:
        return facts.sum_of(names_of(text), period)
    upper, rest = text.split("/")
    lower, _, factor = rest.partition("*")
    bottom = F.nullif(facts.sum_of(names_of(lower), period), F.lit(0.0))
    return facts.sum_of(names_of(upper), period) / (bottom / F.lit(float(factor)) if factor else bottom)


def named_sum(name: str, facts: FactColumns, period: str = "daily") -> Column | None:
    """Any other simple name sums the metric of that name (and its daily twin)."""
    text = name.strip().lower()
    if not PERIOD_PATTERN.fullmatch(text) or text in NOT_METRIC_NAMES:
        return None
    if text.endswith("_daily"):
        return facts.sum_of([text], "daily")
    return facts.sum_of([text, f"{text}_daily"], period)


def refuse_raw_value(expression: str) -> None:
    """Values of different metrics must not be added up together."""
    text = expression.strip().lower()
    if text == "value" or re.search(r"\bm\.value\b|\(\s*value\s*\)", text):
        raise ValueError(
            "aggregating 'value' over mixed metrics adds different units; "
            "ask for a metric by name or filter by 'name' first"
        )


# Functions an aggregate expression may call.
AGGREGATE_FUNCTIONS = ("sum", "avg", "min", "max", "count", "coalesce", "nullif", "round", "abs")


def aggregate_expression(text: str, columns: Iterable[str]) -> Column:
    """An aggregate over an entity's columns, such as ``SUM(total_price) / COUNT(id)``.

    Only the listed functions and existing columns may appear; ``data.x`` and
    ``metadata.x`` read a number from the JSON column of that name.
    """
    allowed = {c.lower() for c in columns} | set(AGGREGATE_FUNCTIONS) | {"distinct", "as", "double", "cast"}
    if not re.fullmatch(r"[\w\s().,*/+\-]+", text):
        raise ValueError(f"unsupported character in aggregate expression {text!r}")
    json_field = re.compile(r"\b(data|metadata)\.([A-Za-z_][\w.]*)")
    for source, _ in json_field.findall(text):
        if source not in allowed:
            raise ValueError(f"no column {source!r} for aggregate expression {text!r}")
    for word in re.findall(r"[A-Za-z_]\w*", json_field.sub(" ", text)):
        if word.lower() not in allowed:
            raise ValueError(f"unknown name {word!r} in aggregate expression {text!r}")
    return F.expr(json_field.sub(r"try_cast(get_json_object(\1, '$.\2') AS DOUBLE)", text))


def merge_search_partials(df, keys: list[str]):
    """Merge partial search rows: sums, click rate anew, position by impressions."""
    return df.groupBy(*keys).agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        (F.sum("clicks") / F.nullif(F.sum("impressions"), F.lit(0.0))).alias("ctr"),
        (F.sum(F.col("position") * F.col("impressions")) / F.nullif(F.sum("impressions"), F.lit(0.0))).alias("position"),
        F.sum("count").alias("count"),
    )
