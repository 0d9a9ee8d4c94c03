"""Series prepared for statistics: aligned, cleaned of zeros, tails grouped.

A series is a DataFrame ``(series, key, value)``; a pair ``(series, key, y, x)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import url_key

# Share of points the tail may cover, in percent.
TAIL_LOWEST, TAIL_HIGHEST, TAIL_DEFAULT = 5.0, 50.0, 25.0
# Fixed value: a smaller range counts as constant.
CONSTANT_RANGE = 1e-9
# Accuracy of percentile sketches: ranks are off by at most one in so many.
SKETCH = 10_000


def normalise_keys(series: DataFrame, keys_are_urls: bool = True) -> DataFrame:
    """Bring keys of different sources together; repeated keys average."""
    key = url_key(F.col("key")) if keys_are_urls else F.col("key")
    return series.groupBy("series", key.alias("key")).agg(F.avg("value").alias("value"))


def align(y: DataFrame, x: DataFrame) -> DataFrame:
    """Keys both series have."""
    return y.withColumnRenamed("value", "y").join(x.withColumnRenamed("value", "x"), ["series", "key"], "inner")


def align_outer(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys either series has; a missing value counts as 0."""
    joined = left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), ["series", "key"], "full_outer")
    return joined.select("series", "key", F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r"))


def handle_zeros(pairs: DataFrame, mode: str = "remove") -> DataFrame:
    """``keep`` all points, ``trim`` both-zero ends, or ``remove`` any zero point."""
    if mode == "keep":
        return pairs
    if mode != "trim":
        return pairs.filter((F.col("y") != 0) & (F.col("x") != 0))
    used = (F.col("y") != 0) | (F.col("x") != 0)
    ends = pairs.filter(used).groupBy("series").agg(F.min("key").alias("__first"), F.max("key").alias("__last"))
    return (
        pairs.join(ends, "series")
        .filter((F.col("key") >= F.col("__first")) & (F.col("key") <= F.col("__last")))
        .drop("__first", "__last")
    )


def group_tail(pairs: DataFrame, percentile: float = TAIL_DEFAULT, label: str = "others") -> DataFrame:
    """Collapse the points with the lowest x of each series to their mean.

    ``ceil(n * percentile / 100)`` points collapse, at least one and not all;
    series under three points stay as they are. Ties in x fall by key.
    """
    share = max(TAIL_LOWEST, min(TAIL_HIGHEST, float(percentile)))
    # Percentiles of a sketch enclose the cut, so that only points between them are
    # put in order; short series are ordered whole. One plan for every size.
    near = [max(0.0, share / 100 - 3 / SKETCH), min(1.0, share / 100 + 3 / SKETCH)]
    spans = pairs.groupBy("series").agg(F.count("*").alias("__n"), F.percentile_approx("x", near, SKETCH).alias("__near"))
    whole = F.col("__n") < SKETCH
    spans = spans.select(
        F.col("series").alias("__series"),
        "__n",
        F.when(~whole, F.col("__near")[0]).alias("__from"),
        F.when(~whole, F.col("__near")[1]).alias("__to"),
    )
    placed = pairs.join(spans, F.col("series").eqNullSafe(F.col("__series"))).drop("__series")
    below = F.coalesce(F.coalesce(F.col("x"), F.lit(float("-inf"))) < F.col("__from"), F.lit(False))
    above = F.coalesce(F.col("x") > F.col("__to"), F.lit(False))
    placed = placed.withColumn("__part", F.when(below, -1).when(above, 1).otherwise(0))
    counts = placed.groupBy("series").agg(F.count(F.when(F.col("__part") < 0, 1)).alias("__below")).withColumnRenamed("series", "__series")
    placed = placed.join(counts, F.col("series").eqNullSafe(F.col("__series"))).drop("__series")
    order = Window.partitionBy("series").orderBy("x", "key")
    middle = placed.filter("__part = 0").withColumn("__rank", F.col("__below") + F.row_number().over(order))
    sides = placed.filter("__part <> 0").withColumn("__rank", F.when(F.col("__part") < 0, F.lit(0)).otherwise(F.col("__n")).cast("long"))
    ranked = middle.unionByName(sides)
    cut = F.greatest(F.lit(1), F.least(F.ceil(F.col("__n") * F.lit(share) / 100), F.col("__n") - 1))
    marked = ranked.withColumn("__low", (F.col("__n") >= 3) & (F.col("__rank") <= cut))
    key = F.when(F.col("__low"), F.lit(label)).otherwise(F.col("key").cast("string"))
    return (
        marked.groupBy("series", key.alias("key"), F.col("__low"))
        .agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
        .drop("__low")
    )


def guard(pairs: DataFrame) -> DataFrame:
    """Per series: whether statistics make sense, and if not, why."""
    spans = pairs.groupBy("series").agg(
        F.count("*").alias("points"),
        (F.max("x") - F.min("x")).alias("x_range"),
        (F.max("y") - F.min("y")).alias("y_range"),
    )
    reason = (
        F.when(F.col("points") < 2, "too_few_points")
        .when(F.col("x_range") < CONSTANT_RANGE, "constant_x")
        .when(F.col("y_range") < CONSTANT_RANGE, "constant_y")
    )
    return spans.select("series", "points", "x_range", "y_range", reason.alias("reason"))


def usable(pairs: DataFrame) -> DataFrame:
    """Points of the series the guard lets through."""
    good = guard(pairs).filter(F.col("reason").isNull()).select("series")
    return pairs.join(good, "series", "left_semi")
