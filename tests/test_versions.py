"""Loads that become visible at once: broken, late, repeated, purged and concurrent ones."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.ingest import metrics, versions
from tidemark.ingest.versions import Conflict, VersionedStore
from tidemark.session import shared_folder

CONFIGS = "id bigint, config_signature string, channel string, name string, period string, channeled_account_id bigint, page_id bigint, account_id bigint"
BATCH = "channel string, name string, period string, channeled_account_id bigint, page_id bigint, platform_id string, metric_date date, value double, dimensions_hash string, metadata string, data string, sequence bigint"
STEPS = ("batch", "configs", "facts", "provenance", "watermarks")
TABLES = ("configs", "facts", "provenance", "watermarks")


class Broken(Exception):
    pass


@pytest.fixture
def store(spark):
    return VersionedStore(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", CONFIGS)


def batch(spark, rows):
    """Rows of (channel, name, account, page, day, value)."""
    full = [(c, n, "daily", a, p, f"{c}-{n}-{a}-{d}", d, v, "none", None, "{}", k) for k, (c, n, a, p, d, v) in enumerate(rows)]
    raw = spark.createDataFrame([(*r[:6], *r[6:]) for r in full], BATCH.replace("metric_date date", "metric_date string"))
    return metrics.signature_of(raw.withColumn("metric_date", F.to_date("metric_date")).select(*[x.split()[0] for x in BATCH.split(", ")]))


FIRST = [("ads", "clicks", 1, 10, "2024-01-30", 5.0), ("ads", "clicks", 1, 10, "2024-02-02", 6.0), ("search", "clicks", 2, None, "2024-02-03", 1.0)]
SECOND = [("ads", "clicks", 1, 10, "2024-02-02", 9.0), ("ads", "spend", 3, 11, "2024-03-01", 2.0), ("ads", "clicks", 1, 10, "2024-01-02", 4.0)]


def state(version):
    return {name: sorted(map(str, version.read(name).collect())) for name in TABLES}


def full_scan(version, entity):
    facts = version.read("facts").join(version.read("configs").select(F.col("id").alias("metric_config_id"), "channel", entity), "metric_config_id")
    rows = facts.where(F.col(entity).isNotNull()).groupBy("channel", entity).agg(F.max("metric_date").alias("last_day"))
    return sorted(map(tuple, rows.collect()))


def marks(version, entity):
    return sorted(map(tuple, version.last_loaded_day(entity).select("channel", entity, "last_day").collect()))


def test_a_broken_load_changes_nothing(spark, store):
    store.load(batch(spark, FIRST), "first")
    before = state(store.version())
    for step in STEPS:

        def stop(done, at=step):
            if done == at:
                raise Broken(at)

        with pytest.raises(Broken):
            store.load(batch(spark, SECOND), "second", on_step=stop)
        assert store.versions() == [1] and state(store.version()) == before
    after = store.load(batch(spark, SECOND), "second")
    assert after.number == 2 and state(after) == state(store.version()) != before
    values = {(str(r.metric_date), r.value) for r in after.read("facts").collect()}
    assert values == {("2024-01-30", 5.0), ("2024-02-02", 9.0), ("2024-02-03", 1.0), ("2024-03-01", 2.0), ("2024-01-02", 4.0)}
    # An older version still reads as it was.
    assert state(store.version(1)) == before


def test_repeated_loads_change_nothing(spark, store):
    store.load(batch(spark, FIRST), "first")
    once = store.load(batch(spark, SECOND), "second")
    again = store.load(batch(spark, SECOND), "second")
    late = store.load(batch(spark, FIRST), "late")
    for name in TABLES:
        assert sorted(map(str, once.read(name).collect())) == sorted(map(str, again.read(name).collect())) == sorted(map(str, late.read(name).collect()))


@pytest.mark.parametrize("entity", ["channeled_account_id", "page_id"])
def test_watermarks_equal_a_full_scan(spark, store, entity):
    assert marks(store.version(), entity) == []
    for name, rows in (("first", FIRST), ("late", SECOND), ("repeat", FIRST)):
        version = store.load(batch(spark, rows), name)
        assert marks(version, entity) == full_scan(version, entity) != []
    purged = store.purge_channel("SEARCH", "purge")
    assert marks(purged, entity) == full_scan(purged, entity) and all(m[0] == "ads" for m in marks(purged, entity))
    assert purged.read("facts").count() == 4 and purged.read("provenance").where("channel = 'search'").count() == 0
    files = purged.last_loaded_day(entity).inputFiles()
    assert files and all("/watermarks/" in f for f in files)


def test_months_of_other_channels_are_not_rewritten(spark, store):
    before = store.load(batch(spark, FIRST + SECOND), "first")
    after = store.purge_channel("search", "purge")
    same = {m for m in before.parts["facts"] if before.parts["facts"][m] == after.parts["facts"].get(m)}
    assert same == {"202401", "202403"} and after.months("facts") == [202401, 202402, 202403]
    everything = store.purge_channel("ads", "all")
    assert all(everything.read(name).count() == 0 for name in TABLES)


def test_a_month_filter_reads_that_month_only(spark, store):
    version = store.load(batch(spark, FIRST + SECOND), "first")
    plan = version.read("facts").where("month = 202403")
    assert [f.split("/month=")[1][:6] for f in plan.inputFiles()] and plan.count() == 1
    assert "PartitionFilters: [isnotnull(month" in plan._jdf.queryExecution().toString()


def test_concurrent_loads_lose_nothing(spark, store):
    store.load(batch(spark, FIRST), "first")
    others = [batch(spark, [("ads", "clicks", 7, 70, "2024-02-20", 3.0)])]

    def meanwhile(step):
        if step == "facts" and others:
            store.load(others.pop(), "other")

    version = store.load(batch(spark, SECOND), "second", on_step=meanwhile)
    assert version.number == 3 and version.read("facts").where("value = 3.0").count() == 1 and version.read("facts").count() == 6
    with pytest.raises(Conflict):
        store._commit(store.version(1), "too late", {})
    assert store.versions() == [1, 2, 3]


def test_vacuum_keeps_what_versions_name(spark, store, monkeypatch):
    monkeypatch.setattr(versions, "MOST_CONFIG_PARTS", 2)
    for k in range(4):
        store.load(batch(spark, [("ads", f"m{k}", 1, 10, f"2024-0{1 + k % 2}-05", float(k + 1))]), f"load{k}")
    before = state(store.version())
    store.vacuum(keep=1)
    assert store.versions() == [4] and state(store.version()) == before and store.version().read("configs").count() == 4
    assert len(store.version().parts["configs"]["*"]) <= 2
    assert len(store._files.names(f"{store.root}/facts/month=202401")) == 1
    assert store.load(batch(spark, FIRST), "next").number == 5


def test_an_empty_batch_makes_a_version_of_the_same_rows(spark, store):
    store.load(batch(spark, FIRST), "first")
    before = state(store.version())
    assert state(store.load(batch(spark, FIRST).limit(0), "none")) == before
