"""Health reports over the job log, the fact table and the query event log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.dates import as_date
from tidemark.health import fallbacks, inventory
from tidemark.health import jobs as J
from tidemark.operators import reads as R
from tidemark.queries.registry import ACCOUNTS, EVENTS, JOBS, query
from tidemark.session import shared_folder
from tidemark.sources import files
from tidemark.sources import tables as T
from tidemark.sources.sink import EventSink

_PER_ACCOUNT = """per AS (SELECT channel, COALESCE(account_id, 'global') AS account_id, COUNT(*) AS total, COUNT(*) FILTER (status = 3) AS completed,
    COUNT(*) FILTER (status = 4) AS failed, COUNT(*) FILTER (status = 2) AS processing, COUNT(*) FILTER (status = 1) AS scheduled,
    COUNT(*) FILTER (status NOT IN (5, 6) AND NOT (recent AND status = 1)) AS total_for_percentage FROM jobs
    WHERE COALESCE(account_id, 'global') NOT IN (SELECT platform_id FROM accounts WHERE NOT enabled) GROUP BY 1, 2)"""
_PER_CHANNEL = """valued AS (SELECT *, COALESCE(ROUND(completed / NULLIF(total_for_percentage, 0) * 100, 2), 0) AS completion FROM per),
    chan AS (SELECT channel, ROUND(AVG(completion), 2) AS completion_percentage, COUNT(*) FILTER (completion >= 100) AS fully_synced_count,
    ROUND(COUNT(*) FILTER (completion >= 100) / COUNT(*) * 100, 2) AS fully_synced_percentage, COUNT(*) AS total_assets, CAST(SUM(total) AS BIGINT) AS total_jobs,
    CAST(SUM(completed) AS BIGINT) AS completed, CAST(SUM(processing) AS BIGINT) AS processing, CAST(SUM(failed) AS BIGINT) AS failed, CAST(SUM(scheduled) AS BIGINT) AS scheduled FROM valued GROUP BY channel)"""


def _accounts(spark, folder):
    return T.entities(spark, folder)["channeled_accounts"]


@query("d18_account_status", f"WITH {JOBS}, {ACCOUNTS}, {_PER_ACCOUNT} SELECT * FROM per")
def account_status(spark, folder):
    return J.account_status(T.jobs(spark, folder), _accounts(spark, folder))


@query("d19_channel_status", f"WITH {JOBS}, {ACCOUNTS}, {_PER_ACCOUNT}, {_PER_CHANNEL} SELECT * FROM chan")
def channel_status(spark, folder):
    return J.channel_status(J.account_status(T.jobs(spark, folder), _accounts(spark, folder)))


@query(
    "l1_global_status",
    f"""WITH {JOBS}, {ACCOUNTS}, {_PER_ACCOUNT}, {_PER_CHANNEL} SELECT ROUND(AVG(completion_percentage), 2) AS completion_percentage, CAST(SUM(total_assets) AS BIGINT) AS total_assets,
    CAST(SUM(fully_synced_count) AS BIGINT) AS fully_synced_count, ROUND(SUM(fully_synced_count) / SUM(total_assets) * 100, 2) AS fully_synced_percentage FROM chan""",
)
def global_status(spark, folder):
    return J.global_status(J.channel_status(J.account_status(T.jobs(spark, folder), _accounts(spark, folder))))


@query(
    "l2_channel_accounts",
    f"""WITH {JOBS}, {ACCOUNTS}, c AS (SELECT COALESCE(account_id, 'global') AS account_id, COUNT(*) FILTER (status <> 6) AS total, COUNT(*) FILTER (status = 3) AS completed,
    COUNT(*) FILTER (status = 4) AS failed, COUNT(*) FILTER (status = 2) AS processing, COUNT(*) FILTER (status = 1) AS scheduled,
    COUNT(*) FILTER (status NOT IN (5, 6) AND NOT (recent AND status = 1)) AS total_for_percentage FROM jobs WHERE channel = 'ch2' GROUP BY 1)
    SELECT c.*, name, COALESCE(enabled, TRUE) AS enabled, LEAST(100, COALESCE(ROUND(completed / NULLIF(total_for_percentage, 0) * 100, 2), 0)) AS completion
    FROM c LEFT JOIN accounts a ON account_id = a.platform_id WHERE COALESCE(enabled, TRUE)""",
)
def channel_accounts(spark, folder):
    return J.channel_accounts(T.jobs(spark, folder), _accounts(spark, folder), "ch2")


@query(
    "l3_completed_days",
    f"""WITH {JOBS} SELECT DISTINCT channel, COALESCE(account_id, 'global') AS account_id, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS completed_day FROM jobs WHERE status = 3""",
)
def completed_days(spark, folder):
    return J.completed_days(T.jobs(spark, folder))


@query(
    "l4_coverage",
    """WITH seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-06' AND DATE '2024-02-03'), s AS (SELECT user_id, COUNT(*) AS n FROM seen GROUP BY 1)
    SELECT u.user_id, 29 - COALESCE(n, 0) AS missing_days, ROUND((30 - (29 - COALESCE(n, 0))) / 30 * 100, 2) AS coverage_percent FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN s USING (user_id)""",
)
def coverage(spark, folder):
    facts = T.table(spark, folder, "events").select("user_id", F.to_date("ts").alias("metric_date"))
    return R.coverage(facts, "2024-02-04", 30, by=("user_id",))


@query("l5_status_counts", f"WITH {JOBS} SELECT status, COUNT(*) AS count FROM jobs GROUP BY 1")
def status_counts(spark, folder):
    return J.status_counts(T.jobs(spark, folder))


@query("l5_failed_by_channel", f"WITH {JOBS} SELECT channel, COUNT(*) AS count FROM jobs WHERE status = 4 AND updated_at >= TIMESTAMP '1998-01-01' GROUP BY 1")
def failed_by_channel(spark, folder):
    return J.failed_by_channel(T.jobs(spark, folder), "1998-01-01")


@query("l6_delayed_by_channel", f"WITH {JOBS} SELECT channel, COUNT(*) AS count FROM jobs WHERE status = 5 GROUP BY 1")
def delayed_by_channel(spark, folder):
    return J.delayed_by_channel(T.jobs(spark, folder))


@query("l6_recent_by_status", f"WITH {JOBS} SELECT status, COUNT(*) AS count FROM jobs WHERE recent AND channel IN ('ch1', 'ch4') GROUP BY 1")
def recent_by_status(spark, folder):
    return J.recent_by_status(T.jobs(spark, folder), ["ch1", "ch4"])


@query("l7_stuck_jobs", f"WITH {JOBS} SELECT id, channel FROM jobs WHERE status = 2 AND updated_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 30 MINUTE")
def stuck_jobs(spark, folder):
    return J.stuck_jobs(T.jobs(spark, folder), "1998-06-01 00:00:00").select("id", "channel")


@query(
    "l8_last_success",
    f"WITH {JOBS} SELECT instance_name, MAX(updated_at) AS last_success, MAX(updated_at) >= TIMESTAMP '2001-08-02 00:00:00' - INTERVAL 24 HOUR AS is_recent FROM jobs WHERE status = 3 GROUP BY 1",
)
def last_success(spark, folder):
    result = J.last_success(T.jobs(spark, folder), "2001-08-02 00:00:00")
    return result.withColumn("last_success", F.col("last_success").cast("timestamp_ntz"))


_UNBLOCKED = """free AS (SELECT * FROM jobs WHERE status = 1 AND ((account_id IS NOT NULL AND account_id NOT IN (SELECT account_id FROM jobs WHERE status = 2 AND account_id IS NOT NULL))
    OR (account_id IS NULL AND instance_name NOT IN (SELECT instance_name FROM jobs WHERE status = 2))))"""


@query("c13_unblocked_jobs", f"WITH {JOBS}, {_UNBLOCKED} SELECT id, account_id FROM free")
def unblocked(spark, folder):
    return J.unblocked(T.jobs(spark, folder)).select("id", "account_id")


@query(
    "l11_backlog",
    f"""WITH {JOBS}, {_UNBLOCKED} SELECT id, account_id, instance_name, CAST(rn AS INT) AS account_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY account_id, instance_name ORDER BY priority DESC, updated_at, id) AS rn FROM free) WHERE rn <= 5 ORDER BY priority DESC, updated_at, id LIMIT 100""",
)
def backlog(spark, folder):
    return J.backlog(T.jobs(spark, folder)).select("id", "account_id", "instance_name", "account_rank")


@query(
    "f1_ranked_backlog",
    f"""WITH {JOBS} SELECT id, account_id, CAST(rn AS INT) AS account_rank FROM (SELECT *, row_number() OVER (PARTITION BY account_id, instance_name ORDER BY priority DESC, updated_at, id) AS rn FROM jobs WHERE status = 1) WHERE rn <= 5""",
)
def ranked_backlog(spark, folder):
    from tidemark.operators.rank import best_per_group

    keyed = J.with_payload(T.jobs(spark, folder).filter(F.col("status") == 1))
    order = [F.col("priority").desc(), F.col("updated_at").asc(), F.col("id").asc()]
    return best_per_group(keyed, ["account_id", "instance_name"], order, 5, "account_rank").select("id", "account_id", "account_rank")


@query(
    "d20_busy_channels",
    f"""WITH {JOBS} SELECT channel, COUNT(*) AS active_count, CAST(50 * CAST(substr(channel, 3) AS INT) AS INT) AS max_workers FROM jobs WHERE status = 2 GROUP BY 1 HAVING COUNT(*) >= 50 * CAST(substr(channel, 3) AS INT)""",
)
def busy_channels(spark, folder):
    jobs = T.jobs(spark, folder)
    channels = jobs.select(F.col("channel").alias("name")).distinct()
    limits = channels.select("name", (F.substring("name", 3, 3).cast("int") * 50).alias("max_workers"))
    return J.busy_channels(jobs, limits)


@query(
    "d24_channel_by_status",
    f"""WITH {JOBS} SELECT channel, {', '.join(f"COUNT(*) FILTER (status = {c}) AS {n}" for n, c in J.STATUS.items() if n != 'delayed')} FROM jobs GROUP BY 1""",
)
def channel_by_status(spark, folder):
    return J.channel_by_status(T.jobs(spark, folder))


@query(
    "f8_sampled_jobs",
    f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, status ORDER BY id) AS a, row_number() OVER (PARTITION BY channel, status ORDER BY id DESC) AS b FROM jobs) SELECT id, channel, status FROM r WHERE a <= 5 OR b <= 5""",
)
def sampled_jobs(spark, folder):
    return J.sampled_jobs(T.jobs(spark, folder)).select("id", "channel", "status")


@query(
    "f9_job_history",
    f"""WITH {JOBS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel, account_id, first_day ORDER BY id DESC) AS age FROM jobs)
    SELECT channel, 'metric' AS entity, COALESCE(account_id, 'all_accounts') AS account_id, CAST(first_day AS VARCHAR) AS start_date, MAX(CASE WHEN age = 1 THEN id END) AS id, CAST(MAX(CASE WHEN age = 1 THEN status END) AS INT) AS status,
    CAST(MAX(CASE WHEN age = 1 AND status IN (3, 4) THEN epoch(updated_at) - epoch(created_at) END) AS BIGINT) AS execution_seconds, COUNT(*) FILTER (age BETWEEN 2 AND 11) AS earlier FROM r GROUP BY channel, account_id, first_day""",
)
def job_history(spark, folder):
    history = J.history(T.jobs(spark, folder))
    return history.select(
        "channel", "entity", "account_id", "start_date", "id", "status", "execution_seconds", F.size("history").cast("bigint").alias("earlier")
    )


@query("d22_table_counts", "SELECT 'orders' AS \"table\", COUNT(*) AS count FROM orders UNION ALL SELECT 'events', COUNT(*) FROM events UNION ALL SELECT 'pages', COUNT(*) FROM pages")
def table_counts(spark, folder):
    return inventory.table_counts({n: T.table(spark, folder, n) for n in ("orders", "events", "pages")})


@query(
    "d23_row_inventory",
    f"""WITH {ACCOUNTS}, acc AS (SELECT *, 'crm' AS channel FROM accounts)
    SELECT 'events' AS "table", 'events' AS channel, type, COUNT(*) AS count FROM events LEFT JOIN acc ON user_id = id GROUP BY type
    UNION ALL SELECT 'orders', channel, type, COUNT(*) FROM orders LEFT JOIN acc ON 'acc-' || o_custkey = platform_id GROUP BY channel, type
    UNION ALL SELECT 'documents', source, NULL, COUNT(*) FROM documents GROUP BY source""",
)
def row_inventory(spark, folder):
    accounts = _accounts(spark, folder).withColumn("channel", F.lit("crm"))
    tables = {
        "events": T.table(spark, folder, "events").select(F.lit("events").alias("channel"), F.col("user_id").alias("channeled_account_id")),
        "orders": T.table(spark, folder, "orders").select(F.concat(F.lit("acc-"), F.col("o_custkey").cast("string")).alias("platform_id")),
        "documents": T.table(spark, folder, "documents").select(F.col("source").alias("channel")),
    }
    return inventory.row_inventory(tables, accounts)


def _query_events(spark, folder):
    """Events as a log of answered queries."""
    events = T.table(spark, folder, "events")
    legacy = F.col("event_type").isin("error", "signup", "purchase")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(legacy, "Legacy").otherwise("optimized").alias("executor_path_decision"),
        F.when(F.col("event_type") == "error", " missing_profile_capability").alias("executor_fallback_reason"),
        F.struct(
            F.when(k < 90, F.concat(F.lit("Ch"), (k % 4).cast("string"))).alias("profile_channel"),
            (F.col("value") > 10).alias("profile_checked"),
            F.when(F.col("value") > 10, F.col("value") > 50).alias("profile_supported"),
        ).alias("planner_diagnostics"),
    )


_LOG = """q AS (SELECT event_type IN ('error', 'signup', 'purchase') AS legacy, event_type = 'error' AS missing, value > 10 AS checked, CASE WHEN value > 10 THEN value > 50 END AS supported,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 90 THEN 'ch' || (CAST(json_extract_string(props, '$.k') AS INT) % 4) END AS channel FROM events)"""


@query(
    "d21_fallback_totals",
    f"""WITH {_LOG} SELECT COUNT(*) AS total_events, COUNT(*) FILTER (legacy) AS legacy_events, COUNT(*) FILTER (missing) AS missing_profile_capability_events,
    COUNT(*) FILTER (missing AND channel = 'ch1') AS pilot_missing_profile_capability_events, COUNT(*) FILTER (missing AND (channel IS NULL OR channel <> 'ch1')) AS non_pilot_missing_profile_capability_events FROM q""",
)
def fallback_totals(spark, folder):
    return fallbacks.fallback_totals(_query_events(spark, folder), ["CH1 "])


@query(
    "l9_fallback_report",
    f"""WITH {_LOG} SELECT COALESCE(channel, 'unknown') AS channel, COUNT(*) AS events, COUNT(*) FILTER (legacy) AS legacy_events, COUNT(*) FILTER (missing) AS missing_profile_capability_events,
    COUNT(*) FILTER (checked) AS profile_checked_true_events, COUNT(*) FILTER (NOT supported) AS profile_supported_false_events FROM q GROUP BY 1""",
)
def fallback_report(spark, folder):
    """The log is appended as JSON lines by day, read back, and summed up."""
    path = f"{shared_folder(spark)}/query-events-{uuid.uuid4().hex}"
    files.append_event_log(_query_events(spark, folder), path)
    return fallbacks.fallback_by_channel(files.read_event_log(spark, path))


@query(
    "a8_log_lines",
    """WITH l AS (SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '(?i)error|critical|fatal') OR role = 'user'),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM l) SELECT 'conv-' || conv_id AS file, turn AS line_no FROM r WHERE rn <= 2""",
)
def log_lines(spark, folder):
    """Turns written as packed text logs and read as lines; user turns are marked FATAL."""
    found = R.error_lines(files.read_logs(spark, _turn_logs(spark, folder)), keep=2)
    return found.select("file", F.regexp_extract("line", r"^(\d+)\t", 1).cast("bigint").alias("line_no"))


def _turn_logs(spark, folder):
    turns = T.table(spark, folder, "conversations")
    one_line = F.regexp_replace("text", r"\s+", " ")
    marked = F.when(F.col("role") == "user", F.concat(F.lit("[Fatal] "), one_line)).otherwise(one_line)
    path = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    line = F.concat(F.col("turn").cast("string"), F.lit("\t"), marked).alias("line")
    lines = turns.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("conv"), "turn", line)
    # Small files, so that small tables take several as well.
    files.write_logs(lines, path, "conv", ["turn"], size=1 << 20)
    return path


@query(
    "a8_last_errors",
    "SELECT 'conv-' || conv_id AS file, turn AS line_no FROM conversations WHERE role = 'user' OR regexp_matches(text, '(?i)error|critical|fatal') ORDER BY 1 DESC, 2 DESC LIMIT 40",
)
def last_errors(spark, folder):
    """The last 40 lines of all logs that speak of an error, read from the end of the logs."""
    found = files.last_lines(spark, _turn_logs(spark, folder), "(?i)error|critical|fatal", 40)
    return found.select("file", F.regexp_extract("line", r"^(\d+)\t", 1).cast("bigint").alias("line_no"))


@query(
    "a7_event_documents",
    f"""WITH {_LOG} SELECT COALESCE(channel, 'unknown') AS channel, 2 * COUNT(*) AS events, 2 * COUNT(*) FILTER (legacy) AS legacy_events, 2 * COUNT(*) FILTER (missing) AS missing_profile_capability_events,
    2 * COUNT(*) FILTER (checked) AS profile_checked_true_events, 2 * COUNT(*) FILTER (NOT supported) AS profile_supported_false_events FROM q GROUP BY 1""",
)
def event_documents(spark, folder):
    """The log as whole-file JSON, once as arrays and once as objects with events."""
    path = f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}"
    events = _query_events(spark, folder)
    found = None
    for form, wrap in {"arrays": False, "objects": True}.items():
        files.write_event_documents(events, f"{path}/{form}", wrap)
        part = files.read_event_documents(spark, f"{path}/{form}")
        found = part if found is None else found.unionByName(part)
    return fallbacks.fallback_by_channel(found)


@query("a9_fact_files", f"WITH {EVENTS} SELECT d AS day, COUNT(*) AS facts, R(SUM(value)) AS total FROM ev WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' GROUP BY 1")
def fact_files(spark, folder):
    """Facts written by month and read back for a range of dates."""
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    facts = T.event_facts(spark, folder).select("metric_date", "value", F.xxhash64("name").alias("metric_config_id"))
    files.write_facts(facts, path)
    kept = files.read_facts(spark, path, "2024-01-05", "2024-01-19")
    return kept.groupBy(F.col("metric_date").alias("day")).agg(F.count("*").alias("facts"), F.sum("value").alias("total"))


@query(
    "a9_event_sink",
    f"""WITH {_LOG}, e AS (SELECT CAST(ts AS DATE) AS date, event_type FROM events) SELECT date, COUNT(*) AS events, COUNT(*) FILTER (event_type IN ('error', 'signup', 'purchase')) AS legacy FROM e GROUP BY 1""",
)
def event_sink(spark, folder):
    """Events appended in two parts as JSON lines, a folder per day, and counted from there."""
    path = f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    events = _query_events(spark, folder)
    for part in (F.col("executor_path_decision") == "Legacy", F.col("executor_path_decision") != "Legacy"):
        files.append_event_log(events.filter(part), path)
    read = spark.read.schema("date date, executor_path_decision string").json(path)
    return read.groupBy("date").agg(F.count("*").alias("events"), F.count_if(F.col("executor_path_decision") == "Legacy").alias("legacy"))


@query(
    "a9_packed_event_sink",
    f"""WITH {_LOG}, e AS (SELECT CAST(ts AS DATE) AS date, event_type FROM events) SELECT date, COUNT(*) AS events, COUNT(*) FILTER (event_type IN ('error', 'signup', 'purchase')) AS legacy,
    TRUE AS packed FROM e WHERE CAST(date AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' GROUP BY 1""",
)
def packed_event_sink(spark, folder):
    """The sink after three appends, with the small files of each day put together."""
    sink = EventSink(spark, f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}")
    events = _query_events(spark, folder)
    part = F.pmod(F.xxhash64("timestamp"), F.lit(3))
    for k in range(3):
        sink.append(events.filter(part == k))
    sink.pack()
    packed = all(len(own) == 1 or min(own.values()) * 2 >= 128 << 20 for own in sink.live().values())
    read = sink.read("executor_path_decision string", "2024-01-05", "2024-01-19")
    return read.groupBy("date").agg(
        F.count("*").alias("events"), F.count_if(F.col("executor_path_decision") == "Legacy").alias("legacy"), F.lit(packed).alias("packed")
    )
