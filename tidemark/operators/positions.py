"""Places in a global order, and groups cut into ordered parts of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder, staged

# Within a task, the lower bits of ``monotonically_increasing_id`` count its rows.
_IN_TASK = (1 << 33) - 1
# Up to this many rows a page is a side that a join may broadcast.
SMALL_PAGE = 10_000


class RangeIndex:
    """Rows in a global order, stored as sorted ranges with their counts.

        <path>/rows/__range=<r>/    rows of a range, with their place in it
        <path>/counts/              one row per range: rows in it and before it

    Rows are range partitioned, sorted in their task and numbered there; counts of
    the ranges say how many rows come before. Only the counts, one row per task,
    meet in one place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.counts = spark.read.parquet(f"{path}/counts")

    @classmethod
    def build(cls, df: DataFrame, order: Sequence[Column | str], path: str, ranges: int | None = None) -> RangeIndex:
        """Write the index. End ``order`` with something that tells rows apart: rows
        equal in all of it stay in one range."""
        parted = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
        numbered = parted.sortWithinPartitions(*order).select(
            *df.columns,
            F.spark_partition_id().alias("__range"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK)).alias("__place"),
        )
        numbered.write.partitionBy("__range").parquet(f"{path}/rows")
        # The schema is given, as an index without rows has no folder to take it from.
        stored = df.sparkSession.read.schema(numbered.schema).parquet(f"{path}/rows")
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        counts = stored.groupBy("__range").agg(F.count("*").alias("__rows"))
        counts.select("__range", "__rows", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before")).write.parquet(f"{path}/counts")
        index = cls.__new__(cls)
        index.rows, index.counts = stored, df.sparkSession.read.parquet(f"{path}/counts")
        return index

    def positions(self, ranges: Sequence[int] | None = None) -> DataFrame:
        """Rows with their ``__position``, counted from 0; of the given ranges only, if given."""
        rows, counts = self.rows, self.counts.select(F.col("__range").alias("__of"), "__before")
        if ranges is not None:
            rows = rows.filter(F.col("__range").isin(list(ranges)))
        placed = rows.join(F.broadcast(counts), F.col("__range") == F.col("__of"))
        return placed.withColumn("__position", F.col("__before") + F.col("__place")).drop("__range", "__place", "__of", "__before")

    def page(self, limit: int, page: int = 0) -> DataFrame:
        """Rows from ``page * limit`` on, in order: reads only the ranges that hold them."""
        first, end = page * limit, (page + 1) * limit
        touched = self.counts.filter((F.col("__before") < end) & (F.col("__before") + F.col("__rows") > first))
        # At most one number per range of the index.
        ranges = [r[0] for r in touched.select("__range").collect()]
        inside = self.positions(ranges).filter((F.col("__position") >= first) & (F.col("__position") < end))
        return inside.orderBy("__position")

    def page_with(self, details: DataFrame, key: str, limit: int, page: int = 0) -> DataFrame:
        """A page with the columns of ``details``, which are looked up for its rows only.

        ``key`` names the column that both have; it should be unique in ``details``.
        """
        rows = self.page(limit, page).select(F.col(key).alias("__key"), "__position")
        if limit <= SMALL_PAGE:
            rows = F.broadcast(rows)
        joined = details.join(rows, F.col(key) == F.col("__key"))
        return joined.orderBy("__position").drop("__key", "__position")


def keys_over(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """Keys with more than ``most`` rows, their columns prefixed by two underscores; None if there are none.

    Written as a table of its own, so Spark knows its size and may split rows that
    join it.
    """
    sizes = df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("__rows"))
    over = staged(sizes.filter(F.col("__rows") > most).drop("__rows"), "large")
    return None if over.isEmpty() else over


def same_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> Column:
    """Test for equal keys, null among them, in a table whose key columns are prefixed by two underscores."""
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(other[f"__{k}"])
    return same


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], at_most: int, part: str = "part") -> DataFrame:
    """Rows with the number of their part: every ``at_most`` rows of a key, in order, are one.

    Parts of a key count from 0 and all but its last are full. A key of up to
    ``at_most`` rows is one part whatever its order, so only rows of larger keys are
    put in order. Null is a key. Rows equal in keys and order are told apart by an
    arbitrary number. ``df`` is read once to count and once or twice for the rows;
    hand in stored rows where that is dear.
    """
    over = keys_over(df, keys, at_most)
    if over is None:
        return df.withColumn(part, F.lit(0))
    same = same_keys(df, over, keys)
    small = df.join(over, same, "left_anti").withColumn(part, F.lit(0))
    return small.unionByName(in_ordered_parts(df.join(over, same, "left_semi"), keys, order, at_most, part))


def in_ordered_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], at_most: int, part: str = "part") -> DataFrame:
    """``in_parts`` for keys of any size.

    A key may hold most of the rows: it is spread over ranges, and its first
    position is joined from a table of its own, so Spark may split the rows that
    join it.
    """
    path = f"{shared_folder(df.sparkSession)}/ordered-{uuid.uuid4().hex}"
    told_apart = df.withColumn("__row", F.monotonically_increasing_id())
    # Written first, so that sampling the ranges and sorting them see the same numbers.
    placed = RangeIndex.build(staged(told_apart, "rows"), [*keys, *order, "__row"], path).positions()
    firsts = staged(placed.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__position").alias("__first")), "firsts")
    number = F.floor((F.col("__position") - F.col("__first")) / at_most).cast("int")
    return placed.join(firsts, same_keys(placed, firsts, keys)).select(*df.columns, number.alias(part))
