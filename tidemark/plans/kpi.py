"""KPI trees over metrics, each batch of leaves answered by one aggregate request, also across trees.

A tree is a nested mapping:

    {"type": "operator", "operator": "/",
     "left":  {"type": "metric", "metric": "shop.revenue"},
     "right": {"type": "metric", "metric": "ads.spend", "filters": {"country": 3}}}

Leaves are ``metric`` (``channel.name`` with own filters), ``value`` and
``derived_metric`` (another tree or series by id).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import formulas as M
from tidemark.model import Star
from tidemark.plans.request import AggregateRequest, aggregate


def combine(operator: str, left: Column, right: Column) -> Column:
    """Arithmetic of an operator node; division by zero gives 0."""
    zero = F.lit(0.0)
    match operator:
        case "+":
            return left + right
        case "-":
            return left - right
        case "*":
            return left * right
        case "/":
            return F.coalesce(left / F.nullif(right, zero), zero)
        case "ratio":
            return F.coalesce(left / F.nullif(left + right, zero), zero)
        case "avg":
            return (left + right) / 2
        case "min":
            return F.least(left, right)
        case "max":
            return F.greatest(left, right)
        case "abs_diff":
            return F.abs(left - right)
        case "pct_change":
            return F.coalesce((left - right) / F.abs(F.nullif(right, zero)) * 100, zero)
    raise ValueError(f"unsupported operator {operator!r}")


def parse_tree(tree: str | Mapping[str, Any]) -> Mapping[str, Any]:
    """Accept JSON text or a mapping, and reject unknown node types early."""
    node = json.loads(tree) if isinstance(tree, str) else tree
    if not isinstance(node, Mapping):
        raise ValueError("a KPI tree is a JSON object")
    kind = node.get("type")
    if kind == "operator":
        combine(node["operator"], F.lit(0.0), F.lit(0.0))
        return {**node, "left": parse_tree(node["left"]), "right": parse_tree(node["right"])}
    if kind not in ("value", "metric", "derived_metric"):
        raise ValueError(f"unknown KPI node type {kind!r}")
    return node


def inline_derived(tree: Mapping[str, Any], derived: Mapping[int, Mapping[str, Any]]) -> Mapping[str, Any]:
    """Put the trees of derived metrics in their place, so all leaves share one read."""
    if tree["type"] == "derived_metric":
        key = int(tree["derived_metric_id"])
        if key not in derived:
            raise ValueError(f"derived metric #{key} not found")
        return inline_derived(parse_tree(derived[key]), derived)
    if tree["type"] == "operator":
        return {**tree, "left": inline_derived(tree["left"], derived), "right": inline_derived(tree["right"], derived)}
    return tree


@dataclass(frozen=True)
class _Leaf:
    channel: str | None
    metric: str
    filters: tuple

    @classmethod
    def of(cls, node: Mapping[str, Any], shared: Mapping[str, Any]) -> _Leaf:
        channel, dot, metric = str(node["metric"]).partition(".")
        merged = {**shared, **(node.get("filters") or {})}
        for key in ("startDate", "endDate", "period", "groupBy"):
            merged.pop(key, None)
        return cls(channel if dot else None, metric if dot else channel, tuple(sorted((k, json.dumps(v)) for k, v in merged.items())))

    @property
    def batch(self) -> tuple:
        """Leaves of one batch read the same facts."""
        return self.channel, self.filters


def _leaves(tree: Mapping[str, Any], shared: Mapping[str, Any]) -> list[_Leaf]:
    if tree["type"] == "metric":
        return [_Leaf.of(tree, shared)]
    if tree["type"] == "operator":
        return _leaves(tree["left"], shared) + _leaves(tree["right"], shared)
    return []


def _shared_kind(metrics: tuple[str, ...]) -> tuple[str, ...]:
    """What leaves must have in common to be asked together without changing an answer.

    Plain sums and ratios do not depend on their neighbours. Weighted and
    time-weighted metrics change how a whole request is answered, so such a
    request is shared only with trees that ask the same metrics.
    """
    names = [m.strip().lower() for m in metrics]
    special = any(n in M.WEIGHTED_METRICS or n.removesuffix("_daily") in M.TIME_WEIGHTED_METRICS for n in names)
    return metrics if special else ()


def evaluate_kpis(
    star: Star,
    trees: Sequence[tuple[str | Mapping[str, Any], Mapping[str, Any] | None]],
    start_date: str | None = None,
    end_date: str | None = None,
    group_by: str | None = None,
    derived: Mapping[int, Mapping[str, Any]] | None = None,
    dictionary: M.MetricDictionary | None = None,
) -> DataFrame:
    """Many KPIs at once: ``at`` (place of the tree in the list), ``key`` with ``group_by``, and ``value``.

    ``trees`` are pairs of a tree and the filters of all its leaves. Leaves with the
    same channel and filters, of whatever tree, are one aggregate request, so the
    facts are read once per distinct filter set and not once per tree. The answers
    are stacked and aligned by key. For each leaf the series of keys it has is kept
    apart from its value: adding two series takes the keys of either, adding a
    number takes the series' own.
    """
    parsed = [(inline_derived(parse_tree(tree), derived or {}), filters or {}) for tree, filters in trees]
    # The request of each leaf of each tree; equal requests of several trees are one.
    asked: dict[tuple, dict[str, str]] = {}
    places: list[dict[_Leaf, tuple[tuple, str]]] = []
    for tree, filters in parsed:
        leaves = list(dict.fromkeys(_leaves(tree, filters)))
        place = {}
        for batch in dict.fromkeys(leaf.batch for leaf in leaves):
            names = tuple(dict.fromkeys(leaf.metric for leaf in leaves if leaf.batch == batch))
            measures = asked.setdefault((*batch, _shared_kind(names)), {})
            for leaf in leaves:
                if leaf.batch == batch:
                    known = next((alias for alias, metric in measures.items() if metric == leaf.metric), None)
                    if known is None:
                        known = f"__v{sum(map(len, asked.values()))}"
                        measures[known] = leaf.metric
                    place[leaf] = ((*batch, _shared_kind(names)), known)
        places.append(place)
    answers = {}
    for request, measures in asked.items():
        channel, pairs, _ = request
        wanted = {k: json.loads(v) for k, v in pairs}
        if channel not in (None, "global"):
            wanted["channel"] = channel
        groups = [group_by] if group_by is not None else []
        answers[request] = aggregate(star, AggregateRequest(measures, groups, wanted, start_date, end_date), dictionary)
    numbers = {request: i for i, request in enumerate(answers)}
    # Names may repeat among the members of a relation, so ids align a tree where all its answers have ids.
    has_ids = {request: group_by is not None and f"{group_by}_id" in answer.columns for request, answer in answers.items()}

    def fold(node: Mapping[str, Any], filters: Mapping[str, Any], place: Mapping[_Leaf, tuple[tuple, str]]) -> tuple[Column, Column | None]:
        """Value and, for a series, whether it has the key at hand."""
        if node["type"] == "value":
            return F.lit(float(node["value"])), None
        if node["type"] == "metric":
            request, alias = place[_Leaf.of(node, filters)]
            value, has = F.coalesce(F.col(alias), F.lit(0.0)), F.col(f"__p{numbers[request]}")
            return (F.when(has, value).otherwise(F.lit(0.0)), has) if group_by is not None else (value, None)
        (left, l_has), (right, r_has) = fold(node["left"], filters, place), fold(node["right"], filters, place)
        value = combine(node["operator"], left, right)
        has = l_has if r_has is None else r_has if l_has is None else (l_has | r_has)
        return (value, None) if has is None else (F.when(has, value).otherwise(F.lit(0.0)), has)

    alike: dict[str | None, list[int]] = {}
    for at, place in enumerate(places):
        requests = {request for request, _ in place.values()}
        kind = None if not requests else "ids" if all(has_ids[r] for r in requests) else "names"
        alike.setdefault(kind, []).append(at)
    found = None
    for kind, members in alike.items():
        used = [r for r in answers if any(r == request for at in members for request, _ in places[at].values())]
        row = _aligned(star, {r: answers[r] for r in used}, asked, numbers, group_by, kind == "ids")
        keyed = group_by is not None and kind is not None
        points = []
        for at in members:
            tree, filters = parsed[at]
            value, has = fold(tree, filters, places[at])
            shown = F.lit(True) if has is None or not keyed else F.coalesce(has, F.lit(False))
            points.append(F.struct(F.lit(at).alias("at"), value.cast("double").alias("value"), shown.alias("shown")))
        listed = row.select(*(["key"] if keyed else []), F.explode(F.array(*points)).alias("__point")).filter("__point.shown")
        part = listed.select(F.col("__point.at").alias("at"), *(["key"] if keyed else []), F.col("__point.value").alias("value"))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    if found is None:
        raise ValueError("no KPI trees")
    return found


def _aligned(
    star: Star, answers: Mapping[tuple, DataFrame], asked: Mapping[tuple, Mapping[str, str]], numbers: Mapping[tuple, int], group_by: str | None, by_id: bool
) -> DataFrame:
    """One row per key with the measures of all answers (``__v``) and which of them have the key (``__p``)."""
    stacked = None
    for request, answer in answers.items():
        key = {} if group_by is None else {"key": F.col(f"`{group_by}`"), "__align": F.col(f"`{group_by}_id`" if by_id else f"`{group_by}`")}
        part = answer.select(*[c.alias(n) for n, c in key.items()], *asked[request], F.lit(True).alias(f"__p{numbers[request]}"))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    if stacked is None:
        return star.frame().sparkSession.range(1)
    values = [F.max(c).alias(c) for c in stacked.columns if c.startswith(("__v", "__p"))]
    if group_by is None:
        return stacked.agg(*values)
    return stacked.groupBy("__align").agg(F.max("key").alias("key"), *values)


def evaluate_kpi(
    star: Star,
    tree: str | Mapping[str, Any],
    start_date: str | None = None,
    end_date: str | None = None,
    group_by: str | None = None,
    filters: Mapping[str, Any] | None = None,
    derived: Mapping[int, Mapping[str, Any]] | None = None,
    dictionary: M.MetricDictionary | None = None,
) -> DataFrame:
    """A KPI as a series ``(key, value)``, or as one row without ``group_by``."""
    found = evaluate_kpis(star, [(tree, filters)], start_date, end_date, group_by, derived, dictionary)
    return found.drop("at")


def combine_series(left: DataFrame, right: DataFrame, operator: str) -> DataFrame:
    """Two finished series ``(key, value)`` joined on either's keys, missing = 0."""
    zero = F.lit(0.0)
    joined = left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), "key", "full_outer")
    return joined.select("key", combine(operator, F.coalesce("l", zero), F.coalesce("r", zero)).alias("value"))


def resolve_assets(assets: DataFrame, accounts: DataFrame) -> DataFrame:
    """Account ids of platform ids, tried as given and then by their MD5.

    ``assets`` has ``channel`` and ``asset_platform_id``; unknown assets keep a
    NULL account so that the caller can report them.
    """
    known = accounts.select(
        F.col("channel").alias("__channel"), F.col("platform_id").alias("__platform"), F.col("id").alias("__id")
    )
    plain, hashed = known.alias("p"), known.alias("h")
    text = F.col("asset_platform_id")
    joined = assets.join(plain, (F.col("channel") == F.col("p.__channel")) & (text == F.col("p.__platform")), "left").join(
        hashed, (F.col("channel") == F.col("h.__channel")) & (F.md5(F.trim(text)) == F.col("h.__platform")), "left"
    )
    found = F.coalesce(F.col("p.__id"), F.col("h.__id"))
    return joined.select(*[F.col(c) for c in assets.columns], found.alias("channeled_account_id"))
