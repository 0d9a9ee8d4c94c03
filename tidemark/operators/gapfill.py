"""Complete a time series: every period for every group that occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import GRAINS, as_date, grain_label, grain_start


def fill_gaps(
    df: DataFrame,
    time_field: str,
    grain: str,
    start: str,
    end: str,
    measures: Sequence[str],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Add a zero row for each period of [start, end] a group has no row for.

    The periods of one group are gathered into one array. Its length is bounded
    by the calendar, not by the data, since ``df`` holds one row per group and
    period. No join is made, so ``df`` is computed once.
    """
    as_text = dict(df.dtypes)[time_field] == "string"
    first, last = F.lit(as_date(start)), F.lit(as_date(end))
    days = F.sequence(grain_start(first, grain), grain_start(last, grain), F.expr(f"INTERVAL {GRAINS[grain][0]}"))
    wanted = F.transform(days, lambda d: grain_label(d, grain)) if as_text else days
    types = dict(df.dtypes)
    present = F.collect_list(F.struct(F.col(f"`{time_field}`"), *[F.col(f"`{m}`") for m in measures]))
    keys = F.collect_list(F.col(f"`{time_field}`"))
    gathered = df.groupBy(*[F.col(f"`{g}`") for g in groups]).agg(present.alias("__rows"), keys.alias("__seen"))
    zero = lambda period: F.struct(
        period.alias(time_field), *[F.lit(0).cast(types[m]).alias(m) for m in measures]
    )
    filled = F.concat(F.col("__rows"), F.transform(F.array_except(wanted, F.col("__seen")), zero))
    return gathered.select(*[F.col(f"`{g}`") for g in groups], F.inline(filled)).select(*[f"`{c}`" for c in df.columns])
