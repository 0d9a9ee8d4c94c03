"""Statistics per series.

Two-variable statistics are sums of moments, so they combine map-side whatever
the number of points. Ordered statistics take date keys only: a series then has
at most one point per calendar day, which bounds every window and array here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Usual settings of the indicators.
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
ANOMALY_LIMIT = 3.0
# Rows that leave a smoothing at a time.
ROWS_AT_ONCE = 10_000
# Shares below which a determinant or a residual counts as none.
COLLINEAR = 1e-9


def _zero_safe(top: Column, bottom: Column) -> Column:
    return top / F.nullif(bottom, F.lit(0.0))


def regression(pairs: DataFrame) -> DataFrame:
    """Least squares of y on x: slope, intercept, r squared, points."""
    return pairs.groupBy("series").agg(
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
        F.count("*").alias("points"),
    )


def elasticity(pairs: DataFrame) -> DataFrame:
    """Slope of ln y on ln x over the points where both are positive; NULL below two."""
    positive = (F.col("y") > 0) & (F.col("x") > 0)
    logs = pairs.select("series", F.when(positive, F.ln("y")).alias("y"), F.when(positive, F.ln("x")).alias("x"))
    return logs.groupBy("series").agg(F.regr_slope("y", "x").alias("elasticity"), F.count("y").alias("points"))


def _require_dates(df: DataFrame) -> None:
    if dict(df.dtypes)["key"] != "date":
        raise TypeError("ordered statistics need a date key")


def _by_day() -> Window:
    return Window.partitionBy("series").orderBy("key")


def one_per_day(series: DataFrame) -> DataFrame:
    """Points of a series with repeated days averaged, which bounds its length."""
    _require_dates(series)
    return series.groupBy("series", "key").agg(F.avg("value").alias("value"))


def granger(pairs: DataFrame) -> DataFrame:
    """Whether yesterday's x helps predict y beyond yesterday's y (lag 1).

    Both regressions are solved from centred moment sums; the F statistic
    compares their residuals. Series of fewer than four lagged points, with
    collinear predictors or without residuals have no statistic: NULL.
    """
    _require_dates(pairs)
    w = _by_day()
    daily = pairs.groupBy("series", "key").agg(F.avg("y").alias("y"), F.avg("x").alias("x"))
    lagged = daily.select("series", F.col("y").alias("t"), F.lag("y").over(w).alias("a"), F.lag("x").over(w).alias("b"))
    lagged = lagged.withColumn("t", F.when(F.col("a").isNotNull(), F.col("t")))
    n = F.count("a")
    m = lagged.groupBy("series").agg(
        n.cast("double").alias("n"),
        (F.var_pop("a") * n).alias("saa"),
        (F.var_pop("b") * n).alias("sbb"),
        (F.covar_pop("a", "b") * n).alias("sab"),
        (F.covar_pop("a", "t") * n).alias("sat"),
        (F.covar_pop("b", "t") * n).alias("sbt"),
        (F.var_pop("t") * n).alias("stt"),
    )
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    det = F.when((F.col("n") > 3) & (det > COLLINEAR * F.col("saa") * F.col("sbb")), det)
    own = _zero_safe(F.col("sat"), F.col("saa"))
    beta_a = (F.col("sat") * F.col("sbb") - F.col("sbt") * F.col("sab")) / det
    beta_b = (F.col("sbt") * F.col("saa") - F.col("sat") * F.col("sab")) / det
    restricted = F.col("stt") - own * F.col("sat")
    full = F.col("stt") - beta_a * F.col("sat") - beta_b * F.col("sbt")
    f_value = F.when(full > COLLINEAR * F.col("stt"), (restricted - full) / (full / (F.col("n") - 3)))
    return m.select("series", F.col("n").cast("long").alias("points"), beta_b.alias("lag_effect"), f_value.alias("f_statistic"))


def autocorrelation(series: DataFrame, lags: int = 7) -> DataFrame:
    """Correlation of a series with itself, 1 to ``lags`` points earlier."""
    w = _by_day()
    shifted = one_per_day(series).select("series", "value", *[F.lag("value", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    wide = shifted.groupBy("series").agg(*[F.corr("value", f"l{k}").alias(f"l{k}") for k in range(1, lags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("correlation")) for k in range(1, lags + 1)])
    return wide.select("series", F.inline(pairs))


def anomalies(series: DataFrame, limit: float = ANOMALY_LIMIT) -> DataFrame:
    """Distance of each point from its series' mean in standard deviations."""
    moments = series.groupBy("series").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    z = _zero_safe(F.col("value") - F.col("mean"), F.col("deviation"))
    scored = series.join(moments, "series").select("series", "key", "value", z.alias("z_score"))
    return scored.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > limit, F.lit(False)))


def trend(series: DataFrame, logarithmic: bool = False) -> DataFrame:
    """Straight or logarithmic line through the points in date order."""
    series = one_per_day(series)
    index = F.row_number().over(_by_day()).cast("double")
    x = F.ln(index) if logarithmic else index - 1
    return (
        series.select("series", "value", x.alias("x"))
        .groupBy("series")
        .agg(
            F.regr_slope("value", "x").alias("slope"),
            F.regr_intercept("value", "x").alias("intercept"),
            F.regr_r2("value", "x").alias("r2"),
        )
    )


def moving_average(series: DataFrame, points: int = 7) -> DataFrame:
    """Mean of the last ``points`` points; fewer at the start."""
    window = _by_day().rowsBetween(-(points - 1), 0)
    return one_per_day(series).select("series", "key", "value", F.avg("value").over(window).alias("sma"))


def _per_series(series: DataFrame, smooth: Callable[[list[float]], list[tuple[float, ...]]], names: Sequence[str]) -> DataFrame:
    """Series, key, value and what ``smooth`` makes of each point, carrying its state along.

    A recurrence has no built-in form that is linear in the length, so the points
    of a partition stream through in order, one series (bounded by the calendar) at
    a time, in Arrow batches.
    """
    ordered = one_per_day(series).repartition("series").sortWithinPartitions("series", "key")
    kind = ordered.schema["series"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held: list[list] = []

        def close() -> None:
            values = [v for _, _, v in held]
            made = smooth(values) if None not in values else [(None,) * len(names)] * len(values)
            rows.extend([*point, *extra] for point, extra in zip(held, made, strict=True))
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (3 + len(names))
            arrays = [pa.array(c, t) for c, t in zip(columns, types + [pa.float64()] * len(names), strict=True)]
            rows.clear()
            return pa.record_batch(arrays, names=["series", "key", "value", *names])

        types: list[pa.DataType] = []
        for part in batches:
            types = [part.schema.field(k).type for k in range(3)]
            for point in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                if held and held[0][0] != point[0]:
                    close()
                held.append(point)
            if len(rows) > ROWS_AT_ONCE:
                yield batch()
        if held:
            close()
        if rows:
            yield batch()

    schema = f"series {kind}, key date, value double, " + ", ".join(f"{n} double" for n in names)
    return ordered.select("series", "key", F.col("value").cast("double")).mapInArrow(run, schema)


def _smoothed(values: Iterable[float], alpha: float) -> list[float]:
    """Running ``alpha * v + (1 - alpha) * previous``, starting at the first value."""
    out: list[float] = []
    for v in values:
        out.append(v * alpha + out[-1] * (1.0 - alpha) if out else v)
    return out


def exponential_average(series: DataFrame, span: int = 7) -> DataFrame:
    return _per_series(series, lambda values: [(x,) for x in _smoothed(values, 2.0 / (span + 1))], ["ema"])


def macd(series: DataFrame, fast: int = MACD_FAST, slow: int = MACD_SLOW, signal: int = MACD_SIGNAL) -> DataFrame:
    """Fast minus slow exponential average, its own average, and their gap."""

    def smooth(values: list[float]) -> list[tuple[float, ...]]:
        lines = zip(_smoothed(values, 2.0 / (fast + 1)), _smoothed(values, 2.0 / (slow + 1)), strict=True)
        gap = [f - s for f, s in lines]
        own = _smoothed(gap, 2.0 / (signal + 1))
        return [(g, o, g - o) for g, o in zip(gap, own, strict=True)]

    return _per_series(series, smooth, ["macd", "signal", "histogram"]).drop("value")


def holt_winters(series: DataFrame, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2, season: int = 7) -> DataFrame:
    """Additive triple smoothing: the one-step-ahead fit of every point.

    The first season sets the level (its mean) and the seasonal offsets; the
    trend starts at the mean change from the first season to the second. Series
    under two seasons are smoothed without a season.
    """

    def smooth(values: list[float]) -> list[tuple[float, ...]]:
        seasonal = len(values) >= 2 * season
        level = sum(values[:season]) / season if seasonal else values[0]
        slope = (sum(values[season : 2 * season]) / season - level) / season if seasonal else 0.0
        offsets = deque((v - level for v in values[:season]) if seasonal else [0.0] * season)
        out = []
        for v in values:
            # The offsets turn round: the head belongs to the current point.
            head = offsets.popleft()
            out.append((level + slope + head,))
            before, level = level, alpha * (v - head) + (1 - alpha) * (level + slope)
            slope = beta * (level - before) + (1 - beta) * slope
            offsets.append(gamma * (v - level) + (1 - gamma) * head if seasonal else 0.0)
        return out

    return _per_series(series, smooth, ["fit"])
