"""Files the engine reads and writes besides parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.dates import as_date, month_of
from tidemark.ingest.merge import merge_largest
from tidemark.ingest.metrics import FACT_KEYS
from tidemark.sources.store import Files

QUERY_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("executor_path_decision", T.StringType()),
        T.StructField("executor_fallback_reason", T.StringType()),
        T.StructField("fallback_reason", T.StringType()),
        T.StructField(
            "planner_diagnostics",
            T.StructType(
                [
                    T.StructField("profile_channel", T.StringType()),
                    T.StructField("profile_checked", T.BooleanType()),
                    T.StructField("profile_supported", T.BooleanType()),
                ]
            ),
        ),
    ]
)


def read_event_log(spark: SparkSession, path: str, schema: T.StructType = QUERY_EVENT_SCHEMA) -> DataFrame:
    """Events from a folder of JSON lines; lines that do not parse are skipped."""
    events = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return _one_reason(events)


def read_event_documents(spark: SparkSession, path: str, schema: T.StructType = QUERY_EVENT_SCHEMA) -> DataFrame:
    """Events from whole-file JSON: an array, or an object with an ``events`` array.

    A file is read by one task, as JSON without line breaks cannot be split.
    """
    text = spark.read.text(path, wholetext=True)
    array = T.ArrayType(schema)
    wrapped = F.from_json("value", T.StructType([T.StructField("events", array)]))["events"]
    events = F.when(F.ltrim("value").startswith("["), F.from_json("value", array)).otherwise(wrapped)
    return _one_reason(text.select(F.inline(events)))


def write_event_documents(events: DataFrame, path: str, wrap: bool = False, size: int = 5_000, timestamp: str = "timestamp") -> None:
    """Events as whole-file JSON, some ``size`` of a day per file: arrays, or objects with ``events`` if ``wrap``.

    A day is dealt over as many files as its count asks for, so no row, file or
    task holds a whole day.
    """
    # The number is taken before the join, so it does not depend on how rows are joined.
    numbered = events.select(F.substring(timestamp, 1, 10).alias("__day"), F.xxhash64(F.monotonically_increasing_id()).alias("__deal"), F.struct(*events.columns).alias("__event"))
    days = events.groupBy(F.substring(timestamp, 1, 10).alias("__of")).agg(F.ceil(F.count("*") / size).alias("__files"))
    # Written first, as Spark's size check then sees that it has one row per day.
    counted = f"{path}/_days"
    days.write.parquet(counted)
    days = events.sparkSession.read.schema(days.schema).parquet(counted)
    dealt = numbered.join(days, F.col("__day").eqNullSafe(F.col("__of")))
    array = F.to_json(F.collect_list("__event"))
    value = F.concat(F.lit('{"events": '), array, F.lit("}")) if wrap else array
    documents = dealt.groupBy(F.col("__day").alias("document"), F.pmod("__deal", "__files").alias("part")).agg(value.alias("value"))
    # One row per document is one file.
    documents.write.mode("append").partitionBy("document", "part").text(path)


def _one_reason(events: DataFrame) -> DataFrame:
    reason: Column = F.coalesce("executor_fallback_reason", "fallback_reason")
    return events.withColumn("executor_fallback_reason", reason).drop("fallback_reason")


def append_event_log(events: DataFrame, path: str, timestamp: str = "timestamp") -> None:
    """Append events as JSON lines, in one folder per day."""
    day = F.date_format(F.to_timestamp(timestamp), "yyyy-MM-dd")
    events.withColumn("date", day).write.mode("append").partitionBy("date").json(path)


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and a number that grows within the file.

    Files are cut into splits; a line's number is the byte offset of its split
    plus its place in it, so lines of one file keep their order.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__seq"),
        F.col("value").alias("line"),
    )
    return lines.select("file", F.struct("__block", "__seq").alias("line_no"), "line")


def write_logs(lines: DataFrame, path: str, key: str, order: Sequence[str], line: str = "line", size: int = 128 << 20) -> None:
    """Text logs of many sources, packed into files of about ``size`` bytes.

    Each line begins with the name of its log, percent-encoded, and a tab; line
    breaks in a line become blanks. Files follow ``key`` and ``order``, so a log
    with most of the lines takes many files and many small ones share one: tasks
    and files grow with the bytes, not with the number of logs.
    """
    text = F.regexp_replace(F.coalesce(F.col(line), F.lit("")), r"[\r\n]+", " ")
    packed = lines.select(F.col(key).alias("__key"), *[F.col(o).alias(f"__{i}") for i, o in enumerate(order)], F.concat(F.coalesce(F.url_encode(key), F.lit("")), F.lit("\t"), text).alias("value"))
    total = packed.agg(F.sum(F.octet_length("value") + 1)).first()[0] or 0
    keys = ["__key", *[f"__{i}" for i in range(len(order))]]
    placed = packed.repartitionByRange(max(1, -(-total // size)), *keys).sortWithinPartitions(*keys)
    placed.select("value").write.text(path)


def read_logs(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """Lines written by ``write_logs``: ``file`` (the log), ``line_no`` (grows within and across files) and ``line``.

    ``names`` are the written files to read; all if not given.
    """
    raw = spark.read.schema("value string").text([f"{path}/{n}" for n in names] if names is not None else path)
    return raw.select(
        F.try_url_decode(F.substring_index("value", "\t", 1)).alias("file"),
        F.struct(
            F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("int").alias("__part"),
            F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__seq"),
        ).alias("line_no"),
        F.expr("substring(value, instr(value, '\t') + 1)").alias("line"),
    )


def last_lines(spark: SparkSession, path: str, pattern: str, keep: int) -> DataFrame:
    """The last ``keep`` lines of all logs that match, newest first: reads from the end and stops once there are enough.

    Only counts reach the driver; the files read double from step to step.
    """
    listed = sorted((n for n in Files(spark, path).names(path) if n.startswith("part-")), key=lambda n: int(n.split("-")[1]))
    taken = 1
    while True:
        found = read_logs(spark, path, listed[-taken:]).filter(F.col("line").rlike(pattern)) if listed else None
        if found is None:
            return spark.createDataFrame([], "file string, line_no struct<__part:int,__block:bigint,__seq:bigint>, line string")
        if taken >= len(listed) or found.limit(keep).count() == keep:
            return found.orderBy(F.col("line_no").desc()).limit(keep)
        taken *= 2


def write_facts(facts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Facts in one folder per month, sorted by day so row groups skip by date.

    The rebalance hint lets Spark split a month with most of the facts over many
    files and keep small months together, from the sizes it sees at run time.
    """
    order = [c for c in ("month", "metric_date", "metric_config_id") if c == "month" or c in facts.columns]
    dated = facts.withColumn("month", month_of(F.col("metric_date"))).hint("rebalance", "month")
    dated.sortWithinPartitions(*order).write.mode(mode).partitionBy("month").parquet(path)


def merge_fact_files(spark: SparkSession, batch: DataFrame, path: str, load: str, keys: Sequence[str] = FACT_KEYS) -> list[int]:
    """Merge a batch into facts on disk, rewriting the months it falls into.

    The batch has one row per key (``fact_rows``). It is staged first, so what it
    comes from runs once; the merged months are written in full to
    ``_staging/<load>``, which readers skip, and then swapped in. A load that broke
    off may simply be run again: the larger value wins, so nothing is counted twice.
    """
    staged = f"{path}/_staging/{load}-batch"
    batch.write.mode("overwrite").parquet(staged)
    batch = spark.read.schema(batch.schema).parquet(staged)
    months = [r["month"] for r in batch.select(month_of(F.col("metric_date")).alias("month")).distinct().collect()]
    stored = spark.read.parquet(path)
    near = stored.filter(F.col("month").isin(months)).drop("month")
    staging = f"{path}/_staging/{load}"
    write_facts(merge_largest(near, batch.select(*near.columns), keys), staging)
    merged = spark.read.parquet(staging)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return sorted(months)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """Save a table in buckets of a key; tables with equal buckets join without a shuffle.

    It lies in the warehouse, or in ``path``. Rows are dealt by bucket first, so a
    bucket is one file.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_facts(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facts of a date range."""
    return in_months(spark.read.parquet(path), start, end)


def in_months(facts: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Facts of a date range, from facts stored by month: other months are not read."""
    if start is not None:
        first = F.lit(as_date(start))
        facts = facts.filter((F.col("month") >= month_of(first)) & (F.col("metric_date") >= first))
    if end is not None:
        last = F.lit(as_date(end))
        facts = facts.filter((F.col("month") <= month_of(last)) & (F.col("metric_date") <= last))
    return facts.drop("month")
