"""Reads of entities and facts: nested, by key, by what they measured."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.conditions import predicate
from tidemark.functions.text import json_path
from tidemark.model import RELATIONS, Star
from tidemark.operators.positions import in_ordered_parts, keys_over, same_keys
from tidemark.operators.rank import best_per_group


def expand_children(parents: DataFrame, key: str, children: DataFrame, parent_key: str) -> DataFrame:
    """One row per parent and child; parents without children keep one row."""
    renamed = children.withColumnRenamed(parent_key, "__parent")
    return parents.join(renamed, F.col(key) == F.col("__parent"), "left").drop("__parent")


def nest_children(
    parents: DataFrame, key: str, children: DataFrame, parent_key: str, name: str, at_most: int | None = None
) -> DataFrame:
    """Parents with their children in an array of structs, one row per parent.

    An array must fit into memory: for parents with very many children use
    ``expand_children``, or let ``at_most`` cut arrays to about that length. Such a
    parent then comes as several rows, told apart by ``<name>_part``;
    ``nest_in_parts`` also keeps their order.
    """
    columns = [c for c in children.columns if c != parent_key]
    gathered = F.sort_array(F.collect_list(F.struct(*columns))).alias(name)
    if at_most is None:
        nested = children.groupBy(F.col(parent_key).alias("__parent")).agg(gathered)
        return parents.join(nested, F.col(key) == F.col("__parent"), "left").drop("__parent")
    sizes = children.groupBy(F.col(parent_key).alias("__size_of")).agg(F.count("*").alias("__n"))
    large = sizes.filter(F.col("__n") > at_most)
    parted = children.join(large, F.col(parent_key) == F.col("__size_of"), "left")
    parts = F.ceil(F.coalesce(F.col("__n"), F.lit(1)) / at_most)
    part = F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), parts)
    nested = parted.groupBy(F.col(parent_key).alias("__parent"), part.alias(f"{name}_part")).agg(gathered)
    return parents.join(nested, F.col(key) == F.col("__parent"), "left").drop("__parent")


def nest_in_parts(
    parents: DataFrame, key: str, children: DataFrame, parent_key: str, name: str, at_most: int = 10_000
) -> DataFrame:
    """Parents with arrays of at most ``at_most`` children, in the order of the children's columns.

    One row per parent and part: ``<name>_part`` counts from 0, ``<name>_before``
    says how many children came in earlier parts. A parent without children has
    one row without array. However many children a parent has, no row and no task
    holds them all. Only children of parents with more than ``at_most`` are put in
    order beforehand; ``children`` are read two or three times.
    """
    columns = [c for c in children.columns if c != parent_key]
    children = children.filter(F.col(parent_key).isNotNull())
    gathered = F.sort_array(F.collect_list(F.struct(*columns))).alias(name)
    over, part = keys_over(children, [parent_key], at_most), f"{name}_part"

    def whole(rows: DataFrame) -> DataFrame:
        """Arrays of parents whose children are one part: dealt by parent once, for the array and its join."""
        return rows.repartition(parent_key).groupBy(F.col(parent_key).alias("__parent")).agg(gathered).withColumn(part, F.lit(0))

    if over is None:
        nested = whole(children)
    else:
        same = same_keys(children, over, [parent_key])
        numbered = in_ordered_parts(children.join(over, same, "left_semi"), [parent_key], columns, at_most, part)
        parts = numbered.groupBy(F.col(parent_key).alias("__parent"), part).agg(gathered)
        nested = whole(children.join(over, same, "left_anti")).unionByName(parts)
    nested = nested.select("__parent", part, name)
    nested = nested.withColumn(f"{name}_before", F.col(f"{name}_part").cast("bigint") * at_most)
    return parents.join(nested, F.col(key) == F.col("__parent"), "left").drop("__parent")


def facts_with_entities(star: Star, keys: Sequence[str] = tuple(RELATIONS)) -> DataFrame:
    """Facts with the row of each known entity beside them as a struct."""
    frame = star.frame()
    seen: set[str] = set()
    for key in keys:
        spec = star.relations[key]
        if spec.fk in seen or spec.table not in star.entities or spec.fk not in frame.columns:
            continue
        seen.add(spec.fk)
        entity = star.entity(spec.table)
        nested = entity.select(F.col("id").alias("__id"), F.struct(*entity.columns).alias(key))
        frame = frame.join(nested, F.col(spec.fk) == F.col("__id"), "left").drop("__id")
    return frame


def denormalised_configs(star: Star) -> DataFrame:
    """Configs with the label of every related entity."""
    frame = star.config_frame() if star.configs is not None else star.frame()
    for key, spec in star.relations.items():
        if spec.table in star.entities and spec.fk in frame.columns:
            entity = star.entity(spec.table)
            label = entity.select(F.col("id").alias("__id"), spec.label_of(entity).alias(f"{key}_label"))
            frame = frame.join(label, F.col(spec.fk) == F.col("__id"), "left").drop("__id")
    return frame


def latest_rows(df: DataFrame, key: str = "id", limit: int = 500) -> DataFrame:
    """Preview of a table: its newest rows."""
    return df.orderBy(F.col(key).desc()).limit(limit)


def by_key(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    """Rows with the given natural key; ``data.x`` reaches into the JSON column."""
    for name, value in keys.items():
        source, dot, path = name.partition(".")
        column = json_path(F.col(source), path) if dot else F.col(name)
        df = df.filter(predicate(column, value, text=bool(dot)))
    return df


def count_rows(df: DataFrame, keys: Mapping[str, Any] | None = None) -> DataFrame:
    return by_key(df, keys or {}).agg(F.count("*").alias("count"))


def exists(df: DataFrame, keys: Mapping[str, Any]) -> DataFrame:
    return by_key(df, keys).limit(1).agg((F.count("*") > 0).alias("exists"))


def date_span(df: DataFrame, keys: Mapping[str, Any] | None = None, day: str = "metric_date") -> DataFrame:
    return by_key(df, keys or {}).agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def last_loaded_day(facts: DataFrame, entity: str = "channeled_account_id") -> DataFrame:
    """How far each channel and account (or page) has been loaded."""
    known = facts.filter(F.col(entity).isNotNull())
    return known.groupBy("channel", entity).agg(F.max("metric_date").alias("last_day"))


def distinct_days(facts: DataFrame, day: str = "metric_date") -> DataFrame:
    return facts.select(day).distinct()


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count")).filter(F.col("count") > 1)


# Comparisons a metric value may be filtered by.
COMPARISONS = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
}


def pages_by_metric(pages: DataFrame, facts: DataFrame, name: str, value: float, operator: str = ">") -> DataFrame:
    """Pages with any fact of a metric beyond a value."""
    hits = facts.filter((F.col("name") == name) & COMPARISONS[operator](F.col("value"), F.lit(value)))
    return pages.join(hits.select("page_id"), F.col("id") == F.col("page_id"), "left_semi")


def pages_by_campaign(pages: DataFrame, facts: DataFrame, campaign: Any, column: str = "channeled_campaign_id") -> DataFrame:
    """Pages with any fact of a campaign."""
    hits = facts.filter(predicate(F.col(column), campaign)).select("page_id")
    return pages.join(hits, F.col("id") == F.col("page_id"), "left_semi")


def pages_of_channel(
    pages: DataFrame, accounts: DataFrame, channel: str, in_aggregate: bool = False, page_account: str = "account_id"
) -> DataFrame:
    """Pages whose account owns a channeled account of the channel.

    Without any such account the listing is empty; an aggregate then keeps all.
    """
    owners = accounts.filter(F.lower("channel") == channel.lower()).select(F.col("account_id").alias("__owner"))
    kept = pages.join(owners, F.col(page_account) == F.col("__owner"), "left_semi")
    if not in_aggregate:
        return kept
    none_found = owners.limit(1).agg(F.count("*").alias("n")).scalar() == 0
    return kept.unionByName(pages.filter(none_found))


def matching_all_dimensions(facts: DataFrame, pairs: Mapping[str, str]) -> DataFrame:
    """Facts whose dimension set holds every given pair."""
    for key, value in pairs.items():
        facts = facts.filter(F.try_element_at("dims", F.lit(key.lower())) == F.lit(str(value)))
    return facts


def dimension_rows(sets: DataFrame, key: str = "dimension_set_id") -> DataFrame:
    """Dimension maps as one row per pair."""
    return sets.select(key, F.explode("dims").alias("dimension_key", "dimension_value"))


def distinct_pairs(lines: DataFrame, left: Column, right: Column, names: tuple[str, str]) -> DataFrame:
    """A many-to-many bridge: the pairs that occur, once each."""
    pairs = lines.select(left.alias(names[0]), right.alias(names[1]))
    return pairs.filter(F.col(names[0]).isNotNull() & F.col(names[1]).isNotNull()).distinct()


def missing_days(facts: DataFrame, today: str, days: int, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Days of the last ``days`` each group has no facts on; today is left out."""
    last = date.fromisoformat(today)
    window = F.sequence(F.date_sub(F.lit(last), days - 1), F.date_sub(F.lit(last), 1), F.expr("INTERVAL 1 DAY"))
    inside = F.col("metric_date").between(F.date_sub(F.lit(last), days - 1), F.lit(last))
    seen = facts.filter(inside).select(*by, "metric_date").distinct()
    # Every group is kept, also one without a single day in the window. The days
    # gathered per group are bounded by the window.
    groups = facts.select(*by).distinct()
    gathered = seen.groupBy(*by).agg(F.collect_set("metric_date").alias("__seen"))
    joined = groups.join(gathered, list(by), "left")
    gaps = F.array_except(window, F.coalesce("__seen", F.array().cast("array<date>")))
    return joined.select(*by, F.explode(gaps).alias("missing_day"))


def coverage(facts: DataFrame, today: str, days: int, by: Sequence[str] = ("channel",)) -> DataFrame:
    """Share of the last ``days`` with facts, in percent."""
    gaps = missing_days(facts, today, days, by).groupBy(*by).agg(F.count("*").alias("missing_days"))
    joined = facts.select(*by).distinct().join(gaps, list(by), "left")
    missing = F.coalesce("missing_days", F.lit(0))
    return joined.select(
        *by, missing.alias("missing_days"), F.round((F.lit(days) - missing) / days * 100, 2).alias("coverage_percent")
    )


def _used_keys(users: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Each key that some table refers to, once.

    A table named with several columns is read once. Keys are made distinct, so
    tasks combine theirs first: what is shuffled grows with the distinct keys a
    task sees and not with its rows, and a key that a third of all rows refer to
    arrives once per task.
    """
    columns: dict[int, tuple[DataFrame, list[str]]] = {}
    for frame, column in users:
        named = columns.setdefault(id(frame), (frame, []))[1]
        if column not in named:
            named.append(column)
    used = None
    for frame, named in columns.values():
        keys = F.col(named[0]) if len(named) == 1 else F.explode(F.array(*named))
        part = frame.select(keys.alias("__used")).filter(F.col("__used").isNotNull())
        used = part if used is None else used.unionByName(part)
    return used.distinct()


def without_orphans(df: DataFrame, key: str, users: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows some other table still refers to."""
    return df.join(_used_keys(users), F.col(key) == F.col("__used"), "left_semi")


def orphans(df: DataFrame, key: str, users: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows no other table refers to; rows without a key are such rows."""
    return df.join(_used_keys(users), F.col(key) == F.col("__used"), "left_anti")


def error_lines(lines: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` lines per file that speak of an error.

    ``lines``: file, line_no, line.
    """
    hits = lines.filter(F.col("line").rlike("(?i)error|critical|fatal"))
    return best_per_group(hits, ["file"], [F.col("line_no").desc()], keep)
