"""Time grains, date parts, and date arithmetic resolved while planning."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Time grains, their step and the unit they truncate to.
GRAINS = {
    "daily": ("1 day", "day"),
    "weekly": ("7 days", "week"),
    "monthly": ("1 month", "month"),
    "quarterly": ("3 months", "quarter"),
    "yearly": ("1 year", "year"),
}
DATE_PARTS = ("year", "month", "day", "week", "quarter", "dayofweek", "dayname", "monthname")
DAILY_NAMES = ("daily", "metric_date")


def grain_label(day: Column, grain: str) -> Column:
    """Text label of the period a date falls in; weeks follow the ISO year."""
    match grain:
        case "daily":
            return F.date_format(day, "yyyy-MM-dd")
        case "weekly":
            return F.concat(
                F.date_part(F.lit("YEAROFWEEK"), day).cast("string"),
                F.lit("-W"),
                F.lpad(F.weekofyear(day).cast("string"), 2, "0"),
            )
        case "monthly":
            return F.date_format(day, "yyyy-MM")
        case "quarterly":
            return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
        case "yearly":
            return F.year(day).cast("string")
    raise ValueError(f"unknown time grain {grain!r}")


def grain_start(day: Column, grain: str) -> Column:
    return F.trunc(day, GRAINS[grain][1]) if grain != "daily" else day


def date_part(day: Column, part: str) -> Column:
    """Calendar part of a date; Sunday is 0, weeks are ISO weeks."""
    match part:
        case "year":
            return F.year(day)
        case "month":
            return F.month(day)
        case "day":
            return F.dayofmonth(day)
        case "week":
            return F.weekofyear(day)
        case "quarter":
            return F.quarter(day)
        case "dayofweek":
            return F.dayofweek(day) - 1
        case "dayname":
            return F.date_format(day, "EEEE")
        case "monthname":
            return F.date_format(day, "MMMM")
    raise ValueError(f"unknown date part {part!r}")


def base_date_column(columns: list[str]) -> str:
    """The date a request bounds: the metric date, else when the row was created."""
    for name in ("metric_date", "platform_created_at", "created_at", "date"):
        if name in columns:
            return name
    raise ValueError("no date column among " + ", ".join(columns))


def in_range(day: Column, start: str | date | None, end: str | date | None) -> Column:
    """Inclusive range test, written on the bare column so it reaches the scan."""
    keep = F.lit(True)
    if start is not None:
        keep = day >= F.lit(as_date(start))
    if end is not None:
        upper = day <= F.lit(as_date(end))
        keep = upper if start is None else keep & upper
    return keep


def as_date(value: str | date | datetime) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return date.fromisoformat(resolve_relative(value))


def month_number(value: str | date | datetime) -> int:
    """Month as a number such as 202401, which orders like dates."""
    day = as_date(value)
    return day.year * 100 + day.month


def month_of(day: Column) -> Column:
    """Month of a date column, as ``month_number`` gives it."""
    return F.year(day) * 100 + F.month(day)


def resolve_relative(value: str, today: date | None = None) -> str:
    """``today``, ``yesterday``, ``-3 days`` and the like as an ISO date."""
    text = value.strip().lower()
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return text
    today = today or date.today()
    named = {"today": 0, "now": 0, "yesterday": -1, "tomorrow": 1}
    if text in named:
        return (today + timedelta(days=named[text])).isoformat()
    ago = re.fullmatch(r"(\d+) (day|week|month|year)s? ago", text)
    shift = re.fullmatch(r"([+-]?\d+) ?(day|week|month|year)s?", text)
    if ago:
        return _shift(today, -int(ago[1]), ago[2]).isoformat()
    if shift:
        return _shift(today, int(shift[1]), shift[2]).isoformat()
    return value


def _shift(day: date, count: int, unit: str) -> date:
    if unit in ("day", "week"):
        return day + timedelta(days=count * (7 if unit == "week" else 1))
    months = day.month - 1 + count * (12 if unit == "year" else 1)
    year, month = day.year + months // 12, months % 12 + 1
    # Days beyond the month's end roll over into the next month.
    return date(year, month, 1) + timedelta(days=day.day - 1)


def iso_interval(human: str) -> str:
    """``3 years`` as ``P3Y``; unknown text is returned lower-cased."""
    text = human.strip().lower()
    found = re.fullmatch(r"(\d+)\s*(year|month|week|day|hour|minute|second)s?", text)
    if not found:
        return text
    prefix = "PT" if found[2] in ("hour", "minute", "second") else "P"
    return f"{prefix}{found[1]}{found[2][0].upper()}"


def chunk_starts(start: Column, end: Column, step: str) -> Column:
    """Array of ``{start, end}`` covering [start, end] in steps such as ``1 week``."""
    interval = F.expr(f"INTERVAL {step}")
    firsts = F.sequence(start, end, interval)
    return F.when(
        start <= end,
        F.transform(
            firsts,
            lambda d: F.struct(
                d.alias("start"),
                F.least(F.date_sub((d + interval).cast("date"), 1), end).alias("end"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<start:date,end:date>>"))


def quarter_windows(start: Column, yesterday: Column) -> Column:
    """History windows: quarter by quarter from start, the last cut at yesterday."""
    quarter = F.expr("INTERVAL 3 MONTHS")
    firsts = F.sequence(F.trunc(start, "quarter"), yesterday, quarter)
    windows = F.transform(
        firsts,
        lambda q: F.struct(
            F.greatest(q, start).alias("start"),
            F.least(F.date_sub((q + quarter).cast("date"), 1), yesterday).alias("end"),
            F.concat_ws("-", F.year(q).cast("string"), F.quarter(q).cast("string")).alias("label"),
        ),
    )
    return F.when(start < yesterday, F.filter(windows, lambda w: w["start"] < yesterday))


def next_evaluation(now: Column, schedule: Column, time_of_day: Column, day_of_week: Column) -> Column:
    """When an alert runs next: daily, weekly, biweekly, monthly; once gives NULL."""
    hour = F.coalesce(F.split(time_of_day, ":")[0].try_cast("int"), F.lit(8))
    minute = F.coalesce(F.split(time_of_day, ":")[1].try_cast("int"), F.lit(0))

    def at(day: Column) -> Column:
        return F.make_timestamp(F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0))

    today = F.to_date(now)
    # 1 = Monday … 7 = Sunday; weekday() counts Monday as 0.
    ahead = F.pmod(F.coalesce(day_of_week, F.lit(1)) - 1 - F.weekday(today) + 6, F.lit(7)) + 1
    next_day = F.date_add(today, ahead.cast("int"))
    daily = F.when(at(today) <= now, at(F.date_add(today, 1))).otherwise(at(today))
    # A day past the end of the next month rolls over into the month after it.
    month_later = F.date_add(F.trunc(F.add_months(F.trunc(today, "month"), 1), "month"), F.dayofmonth(today) - 1)
    return (
        F.when(F.coalesce(schedule, F.lit("daily")) == "daily", daily)
        .when(schedule == "weekly", at(next_day))
        .when(schedule == "biweekly", at(F.date_add(next_day, 7)))
        .when(schedule == "monthly", at(month_later))
    )


def format_dates(df):
    """Dates as ``YYYY-MM-DD`` and timestamps as ``YYYY-MM-DD HH:MM:SS`` text."""
    patterns = {"date": "yyyy-MM-dd", "timestamp": "yyyy-MM-dd HH:mm:ss", "timestamp_ntz": "yyyy-MM-dd HH:mm:ss"}
    return df.select(
        *[
            F.date_format(F.col(f"`{name}`"), patterns[kind]).alias(name) if kind in patterns else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
