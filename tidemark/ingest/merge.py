"""Loads merged into tables, as pure functions from tables to tables.

Every merge is a union and one aggregate by key: map-side combined, without a
join, and giving the same table when a load is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that an upsert never replaces by NULL.
KEEP_IF_NULL = ("channeled_account_id", "account_id", "page_id")


def last_write_wins(batch: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row per key: the one that came last."""
    rest = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("r"))
    return picked.select(*keys, "r.*").select(*batch.columns)


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: Sequence[str], sequence: str | None = None) -> DataFrame:
    """Add rows with new keys; the first of each new key wins."""
    order = F.col(sequence) if sequence else F.struct(*[c for c in batch.columns if c not in keys])
    rest = [c for c in stored.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    fresh = new_keys(first, stored, keys)
    return stored.unionByName(fresh.select(*stored.columns))


def new_keys(batch: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key is not stored yet."""
    known = stored.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return batch.join(known, same, "left_anti")


def upsert(
    stored: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], keep_if_null: Sequence[str] = KEEP_IF_NULL
) -> DataFrame:
    """Insert new keys and replace the ``update`` columns of known ones.

    Columns in ``keep_if_null`` keep their value where the new one is NULL. A key
    may come once in ``batch``; use ``last_write_wins`` before where it may not.
    """
    columns = stored.columns
    both = stored.withColumn("__new", F.lit(False)).unionByName(
        batch.select(*columns).withColumn("__new", F.lit(True))
    )
    old = {c: F.max_by(c, F.when(~F.col("__new"), 1)) for c in columns if c not in keys}
    new = {c: F.max_by(c, F.when(F.col("__new"), 1)) for c in columns if c not in keys}
    has_old = F.bool_or(~F.col("__new"))
    has_new = F.bool_or(F.col("__new"))
    merged = both.groupBy(*keys).agg(
        has_old.alias("__has_old"),
        has_new.alias("__has_new"),
        *[c.alias(f"__o_{n}") for n, c in old.items()],
        *[c.alias(f"__n_{n}") for n, c in new.items()],
    )

    def value(name: str) -> Column:
        before, after = F.col(f"__o_{name}"), F.col(f"__n_{name}")
        if name not in update:
            return F.when(F.col("__has_old"), before).otherwise(after)
        if name in keep_if_null:
            return F.coalesce(after, before)
        return F.when(F.col("__has_new"), after).otherwise(before)

    return merged.select(*[F.col(c) if c in keys else value(c).alias(c) for c in columns])


def merge_largest(stored: DataFrame, batch: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Keep the larger value per key; other columns stay as first stored.

    A key comes at most once on either side.

    The merge is commutative and idempotent, so late, repeated and reordered
    loads all give the same table.
    """
    rest = [c for c in stored.columns if c not in (*keys, value)]
    both = stored.withColumn("__load", F.lit(0)).unionByName(batch.select(*stored.columns).withColumn("__load", F.lit(1)))
    # Column by column, so that fixed-width columns aggregate by hash, without a sort.
    first_stored = [F.min_by(c, "__load").alias(c) for c in rest]
    return both.groupBy(*keys).agg(F.max(value).alias(value), *first_stored).select(*stored.columns)


def merge_last_into_largest(stored: DataFrame, batch: DataFrame, keys: Sequence[str], sequence: str, value: str = "value") -> DataFrame:
    """``merge_largest`` with what ``last_write_wins`` leaves of a batch, in one aggregate.

    A key comes at most once in ``stored`` and any number of times in ``batch``,
    which has the column ``sequence`` besides.
    """
    columns = stored.columns
    rest = [c for c in columns if c not in (*keys, value)]
    new = F.col("__new")
    both = stored.select(*columns, F.lit(None).cast(batch.schema[sequence].dataType).alias("__sequence"), F.lit(False).alias("__new")).unionByName(
        batch.select(*columns, F.col(sequence).alias("__sequence"), F.lit(True).alias("__new"))
    )
    merged = both.groupBy(*keys).agg(
        F.bool_or(~new).alias("__known"),
        F.max(F.when(~new, F.col(value))).alias("__largest"),
        *[F.max_by(c, F.when(~new, 1)).alias(f"__first_{c}") for c in rest],
        # Stored rows have no sequence, so they are never the last write.
        F.max_by(F.struct(value, *rest), "__sequence").alias("__last"),
    )
    kept = {c: F.when(F.col("__known"), F.col(f"__first_{c}")).otherwise(F.col(f"__last.{c}")) for c in rest}
    kept[value] = F.greatest("__largest", F.col(f"__last.{value}"))
    return merged.select(*[kept[c].alias(c) if c in kept else F.col(c) for c in columns])


def repoint(df: DataFrame, column: str, survivors: DataFrame) -> DataFrame:
    """Replace duplicate ids by their survivor. ``survivors``: duplicate_id, survivor_id."""
    mapping = survivors.select(F.col("duplicate_id").alias("__dup"), F.col("survivor_id").alias("__keep"))
    joined = df.join(mapping, F.col(column) == F.col("__dup"), "left")
    return joined.withColumn(column, F.coalesce("__keep", F.col(column))).drop("__dup", "__keep")


def drop_duplicates_of(df: DataFrame, key: str, survivors: DataFrame) -> DataFrame:
    return df.join(survivors.select(F.col("duplicate_id").alias("__dup")), F.col(key) == F.col("__dup"), "left_anti")


def rekey_configs(configs: DataFrame, signature: Column) -> tuple[DataFrame, DataFrame]:
    """Configs under a new signature, merged where two now agree.

    Returns the merged configs, the smallest id surviving, and the id mapping.
    The survivor is found by a partial aggregate, not by gathering a group.
    """
    fresh = configs.withColumn("config_signature", signature)
    best = fresh.groupBy("config_signature").agg(F.min("id").alias("survivor_id"))
    mapping = fresh.select("id", "config_signature").join(best, "config_signature")
    duplicates = mapping.filter(F.col("id") != F.col("survivor_id")).select(F.col("id").alias("duplicate_id"), "survivor_id")
    kept = fresh.join(best, (fresh["config_signature"] == best["config_signature"]) & (F.col("id") == F.col("survivor_id")), "left_semi")
    return kept, duplicates


def rekey_metrics(metrics: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Facts moved to the surviving config; the newer config's fact wins a clash."""
    mapping = duplicates.select(F.col("duplicate_id").alias("__dup"), F.col("survivor_id").alias("__keep"))
    # Only facts of configs that merge can clash; all others stay where they are.
    merging = duplicates.select(F.explode(F.array("duplicate_id", "survivor_id")).alias("__id")).distinct()
    same = F.col("metric_config_id") == F.col("__id")
    untouched, clashing = metrics.join(merging, same, "left_anti"), metrics.join(merging, same, "left_semi")
    moved = clashing.join(mapping, F.col("metric_config_id") == F.col("__dup"), "left")
    moved = moved.withColumn("__from", F.col("metric_config_id")).withColumn(
        "metric_config_id", F.coalesce("__keep", "metric_config_id")
    )
    keys = ["metric_config_id", "dimensions_hash", "metric_date"]
    rest = [c for c in metrics.columns if c not in keys]
    picked = moved.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__from").alias("r"))
    return untouched.unionByName(picked.select(*keys, "r.*").select(*metrics.columns))


def purge_channel(metrics: DataFrame, configs: DataFrame, channel: str) -> tuple[DataFrame, DataFrame]:
    """Facts and configs without those of one channel."""
    gone = configs.filter(F.lower("channel") == channel.lower()).select(F.col("id").alias("__gone"))
    kept_facts = metrics.join(gone, F.col("metric_config_id") == F.col("__gone"), "left_anti")
    return kept_facts, configs.filter(F.coalesce(F.lower("channel") != channel.lower(), F.lit(True)))
