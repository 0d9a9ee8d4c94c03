"""Facts from files as they arrive, merged by key.

Each micro-batch is reduced to one row per key, the last one written, and stored in
a folder of its own. A batch that runs again overwrites that folder, so nothing is counted twice.
Readers take the larger value per key over all batches, which makes late and
repeated files harmless; ``compact`` folds the batches into a new base folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.ingest.merge import last_write_wins


def follow_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    prepare,
    keys: Sequence[str],
    target: str,
    checkpoint: str,
    glob: str | None = None,
    sequence: str | None = None,
) -> StreamingQuery:
    """Load the files that are new in ``source`` and stop when none are left.

    ``prepare`` turns a raw batch into rows with ``keys``, ``value`` and, if given,
    ``sequence``, which says what was written last. Without it the largest value of
    a batch counts.
    """
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch)
        if sequence is None:
            merged = rows.groupBy(*keys).agg(F.max("value").alias("value"))
        else:
            merged = last_write_wins(rows.select(*keys, "value", sequence), keys, sequence).drop(sequence)
        merged.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_merged(
    spark: SparkSession, target: str, keys: Sequence[str], base: str | None = None, after: int = -1
) -> DataFrame:
    """The merged facts: the larger value per key over all batches.

    With ``base``, a folder ``compact`` wrote, only batches past ``after`` are read beside it.
    """
    rows = spark.read.parquet(target).filter(F.col("batch") > after).select(*keys, "value")
    if base is not None:
        rows = rows.unionByName(spark.read.parquet(base).select(*keys, "value"))
    return rows.groupBy(*keys).agg(F.max("value").alias("value"))


def compact(spark: SparkSession, target: str, keys: Sequence[str], output: str) -> DataFrame:
    """Write the merged facts to a new folder and read them from there."""
    read_merged(spark, target, keys).write.mode("overwrite").parquet(output)
    return spark.read.parquet(output)
