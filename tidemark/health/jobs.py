"""Reports over the log of load jobs.

``jobs``: id, status, channel, entity, priority, worker_id, payload JSON text,
message, created_at, updated_at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import json_path
from tidemark.operators.rank import best_per_group, oldest_and_newest

# Job status codes.
STATUS = {"scheduled": 1, "processing": 2, "completed": 3, "failed": 4, "delayed": 5, "cancelled": 6}
# How a job's account is named when it has none.
GLOBAL_ACCOUNT = "global"
RECENT_START = "-3 days"
# Active jobs a channel may have where it sets no limit.
DEFAULT_WORKERS = 3


PAYLOAD_SCHEMA = (
    "account_id string, instance_name string, "
    "params struct<account_id: string, type: string, startDate: string, endDate: string, start_date: string>"
)


def with_payload(jobs: DataFrame) -> DataFrame:
    """Jobs with the parts of their payload the reports read, parsed once.

    ``is_recent`` marks jobs that re-pull the last days.
    """
    # Behind a generator the parse is not copied into every filter on its parts.
    kept = [c for c in jobs.columns if c != "payload"]
    fields = F.struct(F.from_json("payload", PAYLOAD_SCHEMA).alias("p"))
    parsed = jobs.select(*kept, F.inline(F.array(fields)))
    params = F.col("p.params")
    recent = (
        F.coalesce(F.col("p.instance_name").like("%-recent"), F.lit(False))
        | F.coalesce(params["type"] == "recent", F.lit(False))
        | F.coalesce(F.coalesce(params["startDate"], params["start_date"]) == RECENT_START, F.lit(False))
    )
    return parsed.select(
        *kept,
        F.coalesce(F.col("p.account_id"), params["account_id"]).alias("account_id"),
        F.col("p.instance_name").alias("instance_name"),
        params["startDate"].alias("start_date"),
        params["endDate"].alias("end_date"),
        recent.alias("is_recent"),
    )


def _is(status: str) -> Column:
    return F.col("status") == STATUS[status]


def account_status(jobs: DataFrame, accounts: DataFrame | None = None, count_cancelled: bool = True) -> DataFrame:
    """Job counts per channel and account, and what counts towards completion.

    Cancelled and delayed jobs, and scheduled recent ones, do not count. Accounts
    known to be disabled are left out.
    """
    keyed = with_payload(jobs).withColumn("account_id", F.coalesce("account_id", F.lit(GLOBAL_ACCOUNT)))
    if accounts is not None:
        disabled = accounts.filter(~F.col("enabled")).select(F.col("platform_id").alias("account_id")).distinct()
        disabled = disabled.filter(F.col("account_id") != GLOBAL_ACCOUNT)
        keyed = keyed.join(disabled, "account_id", "left_anti")
    name = F.ltrim(F.btrim(F.trim("account_id"), F.lit('"')), F.lit("#"))
    keyed = keyed.withColumn("account_id", name).filter((name != "") & (name != "null"))
    left_out = _is("cancelled") | _is("delayed") | (F.col("is_recent") & _is("scheduled"))
    return keyed.groupBy("channel", "account_id").agg(
        (F.count("*") if count_cancelled else F.count_if(~_is("cancelled"))).alias("total"),
        *[F.count_if(_is(s)).alias(s) for s in ("completed", "failed", "processing", "scheduled")],
        F.count_if(~left_out).alias("total_for_percentage"),
    )


def _completion() -> Column:
    share = F.col("completed") / F.nullif(F.col("total_for_percentage"), F.lit(0)) * 100
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def channel_status(per_account: DataFrame, capped: bool = False) -> DataFrame:
    """Completion of each channel: the mean over its accounts."""
    completion = F.least(_completion(), F.lit(100.0)) if capped else _completion()
    valued = per_account.withColumn("completion", completion)
    return valued.groupBy("channel").agg(
        F.round(F.avg("completion"), 2).alias("completion_percentage"),
        F.count_if(F.col("completion") >= 100).alias("fully_synced_count"),
        F.round(F.count_if(F.col("completion") >= 100) / F.count("*") * 100, 2).alias("fully_synced_percentage"),
        F.count("*").alias("total_assets"),
        F.sum("total").alias("total_jobs"),
        *[F.sum(s).alias(s) for s in ("completed", "processing", "failed", "scheduled")],
    )


def global_status(per_channel: DataFrame) -> DataFrame:
    """Completion overall: the mean over channels."""
    return per_channel.agg(
        F.coalesce(F.round(F.avg("completion_percentage"), 2), F.lit(0.0)).alias("completion_percentage"),
        F.coalesce(F.sum("total_assets"), F.lit(0)).alias("total_assets"),
        F.coalesce(F.sum("fully_synced_count"), F.lit(0)).alias("fully_synced_count"),
        F.coalesce(
            F.round(F.sum("fully_synced_count") / F.nullif(F.sum("total_assets"), F.lit(0)) * 100, 2), F.lit(0.0)
        ).alias("fully_synced_percentage"),
    )


def channel_accounts(jobs: DataFrame, accounts: DataFrame, channel: str, account: str | None = None) -> DataFrame:
    """Accounts of one channel, or one of them, with completion (at most 100) and name."""
    counted = account_status(jobs.filter(F.col("channel") == channel), accounts, count_cancelled=False)
    if account is not None:
        counted = counted.filter(F.col("account_id") == account)
    names = accounts.groupBy(F.col("platform_id").alias("account_id")).agg(
        F.min("name").alias("name"), F.bool_and("enabled").alias("enabled")
    )
    joined = counted.join(names, "account_id", "left")
    return joined.select(
        "account_id",
        "name",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.least(_completion(), F.lit(100.0)).alias("completion"),
        "total",
        "completed",
        "failed",
        "processing",
        "scheduled",
        "total_for_percentage",
    )


def completed_days(jobs: DataFrame) -> DataFrame:
    """Days covered by completed jobs, per channel and account."""
    start = F.col("start_date").try_cast("date")
    end = F.coalesce(F.col("end_date").try_cast("date"), start)
    done = with_payload(jobs.filter(_is("completed"))).select(
        "channel",
        F.coalesce("account_id", F.lit(GLOBAL_ACCOUNT)).alias("account_id"),
        start.alias("first"),
        end.alias("last"),
    )
    # Equal ranges collapse before they are spread out into days.
    ranges = done.filter(F.col("first").isNotNull() & (F.col("last") >= F.col("first"))).distinct()
    days = F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY")))
    return ranges.select("channel", "account_id", days.alias("completed_day")).distinct()


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("count"))


def failed_by_channel(jobs: DataFrame, since: str) -> DataFrame:
    recent = jobs.filter(_is("failed") & (F.col("updated_at") >= F.lit(since).cast("timestamp")))
    return recent.groupBy("channel").agg(F.count("*").alias("count"))


def delayed_by_channel(jobs: DataFrame) -> DataFrame:
    return jobs.filter(_is("delayed")).groupBy("channel").agg(F.count("*").alias("count"))


def recent_by_status(jobs: DataFrame, channels: Sequence[str]) -> DataFrame:
    named = json_path(F.col("payload"), "instance_name").contains("-recent")
    return jobs.filter(F.col("channel").isin(list(channels)) & named).groupBy("status").agg(F.count("*").alias("count"))


def stuck_jobs(jobs: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return jobs.filter(_is("processing") & (F.col("updated_at") < limit))


def last_success(jobs: DataFrame, now: str, within_hours: int = 24) -> DataFrame:
    """When each instance last succeeded, and whether that is recent enough."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(within_hours))
    return (
        jobs.filter(_is("completed"))
        .groupBy(json_path(F.col("payload"), "instance_name").alias("instance_name"))
        .agg(F.max("updated_at").alias("last_success"))
        .withColumn("is_recent", F.col("last_success") >= since)
    )


def unblocked(jobs: DataFrame, status: str = "scheduled") -> DataFrame:
    """Waiting jobs whose account (or instance, without one) has no running job."""
    known = with_payload(jobs.filter(_is("processing") | _is(status)))
    running, waiting = known.filter(_is("processing")), known.filter(_is(status))
    instance = F.coalesce("instance_name", F.lit(""))
    busy_accounts = running.select(F.col("account_id").alias("__busy")).filter("__busy IS NOT NULL").distinct()
    busy_instances = running.select(instance.alias("__busy")).distinct()
    with_account = waiting.filter(F.col("account_id").isNotNull())
    without = waiting.filter(F.col("account_id").isNull())
    return with_account.join(busy_accounts, F.col("account_id") == F.col("__busy"), "left_anti").unionByName(
        without.join(busy_instances, instance == F.col("__busy"), "left_anti")
    )


def backlog(jobs: DataFrame, per_account: int = 5, limit: int = 100) -> DataFrame:
    """The next jobs to run: the best few per account and instance."""
    order = [F.col("priority").desc(), F.col("updated_at").asc(), F.col("id").asc()]
    best = best_per_group(unblocked(jobs), ["account_id", "instance_name"], order, per_account, "account_rank")
    return best.orderBy(*order).limit(limit)


def busy_channels(jobs: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels with as many running jobs as they may have.

    ``channels``: name, max_workers.
    """
    running = jobs.filter(_is("processing")).groupBy("channel").agg(F.count("*").alias("active_count"))
    limits = channels.select(F.col("name").alias("channel"), F.coalesce("max_workers", F.lit(DEFAULT_WORKERS)).alias("max_workers"))
    return running.join(limits, "channel").filter(F.col("active_count") >= F.col("max_workers"))


def channel_by_status(jobs: DataFrame) -> DataFrame:
    """Job totals of each channel, one column per status."""
    return jobs.groupBy(F.lower("channel").alias("channel")).agg(
        *[F.count_if(_is(s)).alias(s) for s in STATUS if s != "delayed"]
    )


def sampled_jobs(jobs: DataFrame, keep: int = 5) -> DataFrame:
    """A few oldest and newest jobs per channel and status."""
    return oldest_and_newest(jobs, ["channel", "status"], "id", keep)


def history(jobs: DataFrame, previous: int = 10) -> DataFrame:
    """Latest job per scope, how long it ran, and its predecessors.

    A scope is channel, entity, account and date range.
    """
    scoped = with_payload(jobs).select(
        F.lower(F.trim("channel")).alias("channel"),
        F.lower(F.trim("entity")).alias("entity"),
        F.coalesce("account_id", F.lit("all_accounts")).alias("account_id"),
        F.coalesce("start_date", F.lit("null")).alias("start_date"),
        F.coalesce("end_date", F.lit("null")).alias("end_date"),
        "id",
        "status",
        "message",
        "created_at",
        "updated_at",
    )
    scope = ["channel", "entity", "account_id", "start_date", "end_date"]
    kept = best_per_group(scoped, scope, [F.col("id").desc()], previous + 1, "age")
    finished = F.col("status").isin(STATUS["completed"], STATUS["failed"])
    seconds = F.when(finished, F.unix_timestamp("updated_at") - F.unix_timestamp("created_at"))
    latest = F.col("age") == 1
    return kept.groupBy(*scope).agg(
        F.max(F.when(latest, F.col("id"))).alias("id"),
        F.max(F.when(latest, F.col("status"))).alias("status"),
        F.max(F.when(latest, seconds)).alias("execution_seconds"),
        F.transform(
            F.array_sort(F.collect_list(F.when(~latest, F.struct("age", "status")))), lambda h: h["status"]
        ).alias("history"),
    )
