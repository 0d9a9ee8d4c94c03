"""Entity loads: global identities, their per-channel rows, and their parents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import surrogate_id
from tidemark.functions.text import canonical_page_id
from tidemark.ingest.merge import last_write_wins, new_keys, upsert
from tidemark.ingest.payloads import merged_payloads

# The key of a per-channel row.
CHANNELED_KEY = ("channel", "platform_id")


def identities(values: DataFrame, column: str, stored: DataFrame | None = None) -> DataFrame:
    """Table ``(id, <column>)`` of natural keys; missing and empty keys are left out."""
    found = values.select(F.col(column).cast("string").alias(column)).filter(F.coalesce(column, F.lit("")) != "").distinct()
    fresh = found.select(surrogate_id(F.col(column)).alias("id"), column)
    return fresh if stored is None else stored.unionByName(new_keys(fresh, stored, [column]).select(*stored.columns))


def channeled_id(*parts: Column | str) -> Column:
    """Stable id of a per-channel row from the parts of its key."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return surrogate_id(F.to_json(F.array(*[c.cast("string") for c in columns])))


def lookup(rows: DataFrame, column: str, table: DataFrame, natural: str, output: str | Sequence[str], key: str = "id") -> DataFrame:
    """Add what a reference stands for; unknown references give NULL.

    Platform ids are unique within a channel only: where both sides have a
    channel, it is part of the key. Of several rows with one key the least id
    counts, so no row multiplies. ``output`` may name more columns of the table,
    which then come from that same row.
    """
    names = [output] if isinstance(output, str) else list(output)
    shared = ["channel"] if "channel" in rows.columns and "channel" in table.columns else []
    keys = {f"__k{i}": F.col(c).cast("string") for i, c in enumerate([natural, *shared])}
    picked = F.struct(F.col(key).alias(names[0]), *names[1:])
    one = table.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.min_by(picked, key).alias("__r"))
    ids = one.select(*keys, *[F.col(f"__r.{n}").alias(f"__o_{n}") for n in names])
    test = F.col(column).cast("string") == F.col("__k0")
    if shared:
        test = test & (F.col("channel").cast("string") == F.col("__k1"))
    joined = rows.drop(*names).join(ids, test, "left").drop(*keys)
    return joined.withColumnsRenamed({f"__o_{n}": n for n in names})


def first_per_key(batch: DataFrame, keys: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """One row per key: the one that came first."""
    rest = [c for c in batch.columns if c not in keys]
    picked = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), sequence).alias("r"))
    return picked.select(*keys, "r.*").select(*batch.columns)


def upsert_entities(
    stored: DataFrame | None, batch: DataFrame, update: Sequence[str], keys: Sequence[str] = CHANNELED_KEY, sequence: str = "sequence"
) -> DataFrame:
    """Insert or update entity rows; within a batch the last row of a key counts."""
    rows = last_write_wins(batch, keys, sequence).drop(sequence) if sequence in batch.columns else batch
    return rows if stored is None else upsert(stored, rows, keys, update)


# --- advertising -----------------------------------------------------------


def load_campaigns(
    batch: DataFrame, accounts: DataFrame, stored: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Campaign identities and channeled campaigns with their account.

    ``batch``: channel, platform_id, name, start_date, end_date, account_ref,
    budget, status, objective, buying_type, data, sequence.
    """
    stored = stored or {}
    named = batch.select(F.col("platform_id").alias("campaign_id"), "name", "start_date", "end_date", "sequence")
    rows = last_write_wins(named, ["campaign_id"], "sequence").drop("sequence")
    rows = rows.select(surrogate_id(F.col("campaign_id")).alias("id"), *rows.columns)
    campaigns = upsert_entities(stored.get("campaigns"), rows, ["name", "start_date", "end_date"], ["campaign_id"])
    linked = lookup(batch, "account_ref", accounts, "platform_id", "channeled_account_id")
    channeled = linked.select(
        channeled_id("channel", "platform_id").alias("id"),
        *CHANNELED_KEY,
        surrogate_id(F.col("platform_id")).alias("campaign_id"),
        "channeled_account_id",
        F.coalesce(F.col("budget").cast("double"), F.lit(0.0)).alias("budget"),
        "status",
        "objective",
        "buying_type",
        "data",
        "sequence",
    )
    fields = ["budget", "status", "objective", "buying_type", "data"]
    return {"campaigns": campaigns, "channeled_campaigns": upsert_entities(stored.get("channeled_campaigns"), channeled, fields)}


def load_ad_groups(
    batch: DataFrame, accounts: DataFrame, campaigns: DataFrame, stored: DataFrame | None = None
) -> DataFrame:
    """Channeled ad groups with their account and campaign.

    ``batch``: channel, platform_id, account_ref, campaign_ref, name, status, data, sequence.
    """
    linked = lookup(batch, "account_ref", accounts, "platform_id", "channeled_account_id")
    linked = lookup(linked, "campaign_ref", campaigns, "platform_id", "channeled_campaign_id")
    rows = linked.select(
        channeled_id("channel", "platform_id").alias("id"),
        *CHANNELED_KEY,
        "channeled_account_id",
        "channeled_campaign_id",
        "name",
        "status",
        "data",
        "sequence",
    )
    return upsert_entities(stored, rows, ["channeled_account_id", "channeled_campaign_id", "name", "status", "data"])


def load_ads(
    batch: DataFrame, ad_groups: DataFrame, creatives: DataFrame | None = None, stored: DataFrame | None = None
) -> DataFrame:
    """Channeled ads under their ad group, taking account and campaign from it.

    ``batch``: channel, platform_id, ad_group_ref, creative_ref, name, status, data, sequence.
    """
    linked = lookup(batch, "ad_group_ref", ad_groups, "platform_id", ["channeled_ad_group_id", "channeled_account_id", "channeled_campaign_id"])
    if creatives is not None:
        linked = lookup(linked, "creative_ref", creatives, "creative_id", "creative_id")
    else:
        linked = linked.withColumn("creative_id", F.lit(None).cast("bigint"))
    columns = ["channeled_ad_group_id", "channeled_account_id", "channeled_campaign_id", "creative_id", "name", "status", "data"]
    rows = linked.select(channeled_id("channel", "platform_id").alias("id"), *CHANNELED_KEY, *columns, "sequence")
    return upsert_entities(stored, rows, columns)


def load_creatives(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Creatives by their platform id. ``batch``: platform_id, name, data, sequence."""
    rows = batch.select(F.col("platform_id").alias("creative_id"), "name", "data", "sequence")
    rows = last_write_wins(rows, ["creative_id"], "sequence").drop("sequence")
    rows = rows.select(surrogate_id(F.col("creative_id")).alias("id"), *rows.columns)
    return upsert_entities(stored, rows, ["name", "data"], ["creative_id"])


# --- pages and posts -------------------------------------------------------


def load_pages(batch: DataFrame, accounts: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """Pages by canonical id; an unknown account never replaces a known one.

    ``batch``: url, canonical_id?, title, hostname, platform_id, account_ref?, data, sequence.
    """
    given = F.col("canonical_id") if "canonical_id" in batch.columns else F.lit(None).cast("string")
    rows = batch.withColumn("canonical_id", F.coalesce(given, canonical_page_id(F.col("url"))))
    if accounts is not None and "account_ref" in batch.columns:
        rows = lookup(rows, "account_ref", accounts, "name", "account_id")
    elif "account_id" not in rows.columns:
        rows = rows.withColumn("account_id", F.lit(None).cast("bigint"))
    columns = ["url", "title", "hostname", "platform_id", "account_id", "data"]
    rows = rows.select(surrogate_id(F.col("canonical_id")).alias("id"), "canonical_id", *columns, "sequence")
    return upsert_entities(stored, rows, columns, ["canonical_id"])


def load_accounts(batch: DataFrame, stored: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Accounts by name and channeled accounts below them.

    ``batch``: channel, platform_id, account, name, type, enabled, data, sequence.
    """
    stored = stored or {}
    accounts = identities(batch.select(F.col("account").alias("name")), "name", stored.get("accounts"))
    linked = lookup(batch, "account", accounts, "name", "account_id")
    columns = ["account_id", "name", "type", "enabled", "data"]
    rows = linked.select(channeled_id("channel", "platform_id").alias("id"), *CHANNELED_KEY, *columns, "sequence")
    return {"accounts": accounts, "channeled_accounts": upsert_entities(stored.get("channeled_accounts"), rows, columns)}


def load_posts(batch: DataFrame, accounts: DataFrame, pages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Posts by platform id with their account and page.

    ``batch``: post_id, account_ref, page_ref, data, sequence.
    """
    linked = lookup(batch, "account_ref", accounts, "platform_id", "channeled_account_id")
    linked = lookup(linked, "page_ref", pages, "platform_id", "page_id")
    columns = ["channeled_account_id", "page_id", "data"]
    rows = linked.select(surrogate_id(F.col("post_id")).alias("id"), "post_id", *columns, "sequence")
    return upsert_entities(stored, rows, columns, ["post_id"])


# --- events ----------------------------------------------------------------


def load_events(batch: DataFrame, accounts: DataFrame, stored: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Events by name and their per-account rows; rows without name or id drop.

    ``batch``: channel, platform_id, name, account_ref, data, sequence.
    """
    stored = stored or {}
    events = identities(batch, "name", stored.get("events"))
    valid = batch.filter((F.coalesce("name", F.lit("")) != "") & (F.coalesce("platform_id", F.lit("")) != ""))
    linked = lookup(lookup(valid, "account_ref", accounts, "platform_id", "channeled_account_id"), "name", events, "name", "event_id")
    columns = ["event_id", "channeled_account_id", "name", "data"]
    rows = linked.select(channeled_id("channel", "platform_id").alias("id"), *CHANNELED_KEY, *columns, "sequence")
    return {"events": events, "channeled_events": upsert_entities(stored.get("channeled_events"), rows, columns)}


# --- shared by commerce loads ----------------------------------------------


def payload_rows(batch: DataFrame, keys: Sequence[str] = CHANNELED_KEY, union_arrays: bool = True) -> DataFrame:
    return merged_payloads(batch, keys, union_arrays=union_arrays)
