"""Averages that need a weight: by impressions, or by a companion total."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.formulas import WEIGHTED_METRICS, FactColumns, MetricDictionary

# One weighted observation per date and these config keys.
WEIGHT_GRAIN = ("metric_date", "dimension_set_id", "page_id", "query_id", "country_id", "device_id")
# A companion total is looked up at the same date and these keys.
COMPANION_GRAIN = (
    "metric_date",
    "channel",
    "dimension_set_id",
    "query_id",
    "page_id",
    "country_id",
    "device_id",
    "channeled_account_id",
    "post_id",
)
# Dimension keys that double as config columns.
PARALLEL_KEYS = ("query", "country", "device")


def keep_requested_dimension_sets(frame: DataFrame, requested: Sequence[str], sets: DataFrame | None = None) -> DataFrame:
    """Facts whose set holds every requested key and no unrequested parallel key.

    The exclusion has the meaning of ``NOT IN`` over ``sets``: as soon as any set
    holds an excluded key, facts without a set drop out too. Testing that with a
    scalar subquery keeps the list of sets off every executor.
    """
    wanted = [k.lower() for k in requested]
    for key in wanted:
        frame = frame.filter(F.coalesce(F.map_contains_key("dims", F.lit(key)), F.lit(False)))
    excluded = [k for k in PARALLEL_KEYS if k not in wanted]
    if not excluded:
        return frame
    holds = F.lit(False)
    for key in excluded:
        holds = holds | F.coalesce(F.map_contains_key("dims", F.lit(key)), F.lit(False))
    frame = frame.filter(~holds)
    if sets is not None:
        any_excluded = sets.select("dims").filter(holds).limit(1).agg(F.count("*").alias("n")).scalar()
        frame = frame.filter(F.col("dimension_set_id").isNotNull() | (any_excluded == 0))
    return frame


def weighted_aggregate(
    frame: DataFrame,
    aggregations: Mapping[str, str],
    groups: Mapping[str, Column],
    dictionary: MetricDictionary | None = None,
    channel: str | None = None,
    relabel: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Weighted averages beside plain sums and the click rate.

    Per date and config keys the metric and its weight collapse to their maximum;
    the result is the weighted mean over those. Rows that meet at one grain thus
    count once, whichever account they came from. ``relabel`` may turn the key
    columns of the summed groups into labels; groups that then agree are merged.
    """
    dictionary = dictionary or MetricDictionary()
    facts = FactColumns()

    def names_of(metric: str) -> list[str]:
        names, _ = dictionary.raw_names(metric, channel, "search")
        return names or [metric, f"{metric}_daily"]

    def largest(names: Iterable[str]) -> Column:
        return F.max(F.when(facts.matches(names, "daily"), facts.total))

    sums: dict[str, Column] = {}
    parts: dict[str, Column] = {}
    results: dict[str, Column] = {}
    wanted_names: set[str] = set()
    for alias, text in aggregations.items():
        metric = text.strip().lower()
        if metric in WEIGHTED_METRICS:
            weights = [n for w in WEIGHTED_METRICS[metric] for n in names_of(w)]
            sums[f"__m_{alias}"], sums[f"__w_{alias}"] = largest(names_of(metric)), largest(weights)
            wanted_names |= {*names_of(metric), *weights}
        elif metric == "ctr":
            sums["__clicks"], sums["__impressions"] = facts.sum_of(names_of("clicks")), facts.sum_of(names_of("impressions"))
            wanted_names |= {*names_of("clicks"), *names_of("impressions")}
        else:
            sums[f"__s_{alias}"] = facts.sum_of(names_of(metric))
            wanted_names |= set(names_of(metric))
    for alias, text in aggregations.items():
        metric = text.strip().lower()
        if metric in WEIGHTED_METRICS:
            metric_col, weight_col = F.coalesce(f"__m_{alias}", F.lit(0.0)), F.coalesce(f"__w_{alias}", F.lit(0.0))
            parts[f"__t_{alias}"], parts[f"__b_{alias}"] = F.sum(metric_col * weight_col), F.sum(weight_col)
            results[alias] = F.col(f"__t_{alias}") / F.nullif(F.col(f"__b_{alias}"), F.lit(0.0))
        elif metric == "ctr":
            parts["__c"], parts["__i"] = F.sum("__clicks"), F.sum("__impressions")
            results[alias] = F.col("__c") / F.nullif(F.col("__i"), F.lit(0.0))
        else:
            parts[f"__p_{alias}"] = F.sum(f"__s_{alias}")
            results[alias] = F.col(f"__p_{alias}")

    # The core metrics always take part in the read, as group rows hang on them.
    for core in ("clicks", "impressions", "spend"):
        wanted_names |= set(dictionary.raw_names(core, channel, "search")[0])
    daily = frame.filter(facts.name.isin([n.lower() for n in wanted_names]) & (facts.period == "daily"))
    grain = [c for c in WEIGHT_GRAIN if c in frame.columns]
    keyed = daily.select(*grain, "name", "period", "value", *[c.alias(f"__g_{k}") for k, c in groups.items()])
    base = keyed.groupBy(*grain, *[f"`__g_{k}`" for k in groups]).agg(*[c.alias(k) for k, c in sums.items()])
    summed = base.groupBy(*[F.col(f"`__g_{k}`").alias(k) for k in groups]).agg(*[c.alias(k) for k, c in parts.items()])
    if relabel is not None:
        named = relabel(summed)
        names = [c for c in named.columns if c not in parts]
        summed = named.groupBy(*[F.col(f"`{n}`") for n in names]).agg(*[F.sum(p).alias(p) for p in parts])
    keys = [F.col(f"`{c}`") for c in summed.columns if c not in parts]
    return summed.select(*keys, *[c.alias(k) for k, c in results.items()])


def time_weighted_average(
    frame: DataFrame,
    average_names: Sequence[str],
    total_names: Sequence[str],
    groups: Mapping[str, Column],
    output: str,
    period: str = "daily",
) -> DataFrame:
    """Average watch-time style metric, weighted by what it averaged over.

    A fact of an average stands for ``total / average`` observations, the total
    being the companion metric at the same date and config keys. The result is
    the sum of totals over the sum of observations; zero averages are skipped.
    """
    facts = FactColumns()
    is_average = facts.matches(average_names, period) & (facts.total != 0)
    is_total = facts.matches(total_names, period)
    grain = [c for c in COMPANION_GRAIN if c in frame.columns]
    keyed = frame.filter(facts.matches([*average_names, *total_names], period)).select(
        *grain, "name", "period", "value", *[c.alias(f"__g_{k}") for k, c in groups.items()]
    )
    paired = keyed.groupBy(*grain, *[f"`__g_{k}`" for k in groups]).agg(
        F.count(F.when(is_average, F.lit(1))).alias("__n"),
        F.sum(F.when(is_average, 1.0 / F.nullif(facts.total, F.lit(0.0)))).alias("__inverse"),
        F.max(F.when(is_total, facts.total)).alias("__total"),
    )
    total = F.coalesce("__total", F.lit(0.0))
    return paired.groupBy(*[F.col(f"`__g_{k}`").alias(k) for k in groups]).agg(
        (F.sum(total * F.col("__n")) / F.nullif(F.sum(total * F.coalesce("__inverse", F.lit(0.0))), F.lit(0.0))).alias(output)
    )
