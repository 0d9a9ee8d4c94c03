"""Normalisation, loads, merges, files and the incremental load."""

from __future__ import annotations

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.health import fallbacks, inventory
from tidemark.health import jobs as J
from tidemark.ingest import commerce, entities, merge, metrics
from tidemark.ingest.payloads import merged_payloads
from tidemark.operators import reads as R
from tidemark.operators.normalise import normalise_entities, normalise_metrics
from tidemark.sources import files
from tidemark.streaming.incremental import compact, follow_files, read_merged


def test_search_rows(spark, rows):
    raw = spark.createDataFrame(
        [("2026-01-01", "shoes", "esp", "mobile", 3.0, 40.0, 0.075, 5.5)],
        "date string, query string, country string, device string, clicks double, impressions double, ctr double, position double",
    )
    names = {m: m for m in ("clicks", "impressions", "ctr", "position")}
    out = normalise_metrics(raw, "search", names, dimensions=["query"], context={"page": "/x"})
    assert out.count() == 4
    assert rows(out, "name", "value") == [("clicks", 3.0), ("ctr", 0.075), ("impressions", 40.0), ("position", 5.5)]
    first = out.filter("name = 'clicks'").first()
    assert first["dims"] == {"query": "shoes"} and first["metric_date"] == date(2026, 1, 1)
    assert first["country"] == "esp" and first["page"] == "/x"
    assert out.select("signature").distinct().count() == 4 and out.select("dimensions_hash").distinct().count() == 1


def test_ads_rows(spark, rows):
    raw = spark.createDataFrame(
        [(100, 7, "2026-01-01", "18-24", "female", [{"value": "3"}]), (50, None, "2026-01-01", "25-34", None, None)],
        "impressions long, clicks long, date_start string, age string, gender string, actions array<struct<value:string>>",
    )
    names = {"impressions": "impressions", "clicks": "clicks", "actions": "results"}
    out = normalise_metrics(raw, "ads", names, dimensions=["age", "gender"], date_field="date_start")
    assert rows(out, "name", "value") == [("clicks", 7.0), ("impressions", 100.0), ("impressions", 50.0), ("results", 3.0)]
    assert {len(r["dims"]) for r in out.collect()} == {1, 2}
    padded = normalise_metrics(raw, "ads", names, dimensions=["age"], date_field="date_start", include_nulls=True)
    assert padded.count() == 6


def test_entity_rows(spark):
    raw = spark.createDataFrame([(7, '{"vendor": {"name": "V"}}', "2026-01-01 10:00:00")], "id long, body string, created_at string")
    row = normalise_entities(raw, "shop", {"vendor": "body.vendor.name", "none": "missing.path"}, context={"origin": "x"}).first()
    assert (row["platform_id"], row["vendor"], row["none"], row["origin"]) == ("7", "V", None, "x")
    assert json.loads(row["data"])["id"] == 7


KEYED = "k string, day date, value double, note string"


def keyed(spark, *values):
    return spark.createDataFrame([(k, date(2026, 1, 1), float(v), n) for k, v, n in values], KEYED)


def test_larger_value_wins(spark, rows):
    keys = ["k", "day"]
    merged = merge.merge_largest(keyed(spark, ("a", 7, "first")), keyed(spark, ("a", 5, "second")), keys)
    assert rows(merged, "value", "note") == [(7.0, "first")]
    merged = merge.merge_largest(keyed(spark, ("a", 5, "first")), keyed(spark, ("a", 7, "second")), keys)
    assert rows(merged, "value", "note") == [(7.0, "first")]
    batch = keyed(spark, ("a", 7, "x"), ("b", 2, "y"))
    once = merge.merge_largest(keyed(spark, ("a", 9, "s")), batch, keys)
    assert rows(merge.merge_largest(once, batch, keys)) == rows(once)


def test_upsert_keeps_known_account(spark, rows):
    schema = "platform_id string, account_id long, name string, origin string"
    stored = spark.createDataFrame([("p1", 5, "old", "s"), ("p2", 6, "same", "s")], schema)
    batch = spark.createDataFrame([("p1", None, "new", "b"), ("p3", 7, "third", "b")], schema)
    out = merge.upsert(stored, batch, ["platform_id"], ["account_id", "name"])
    assert rows(out) == [("p1", 5, "new", "s"), ("p2", 6, "same", "s"), ("p3", 7, "third", "b")]


def test_insert_ignore_and_last_write(spark, rows):
    stored = keyed(spark, ("a", 1, "s"))
    batch = spark.createDataFrame([("a", date(2026, 1, 1), 2.0, "b1", 1), ("b", date(2026, 1, 1), 3.0, "b2", 2), ("b", date(2026, 1, 1), 4.0, "b3", 3)], KEYED + ", seq long")
    assert rows(merge.insert_ignore(stored, batch, ["k", "day"], "seq"), "k", "value") == [("a", 1.0), ("b", 3.0)]
    assert rows(merge.last_write_wins(batch, ["k", "day"], "seq"), "k", "value") == [("a", 2.0), ("b", 4.0)]


def test_payloads_merge(spark):
    df = spark.createDataFrame(
        [
            ("o", 1, '{"items":[{"id":1},{"id":2}],"note":"a","n":1.50,"old":true}'),
            ("o", 2, '{"items":[{"id":2},{"id":3}],"note":"b \\"q\\"","n":2}'),
            ("p", 1, "not json"),
        ],
        "k string, sequence long, data string",
    )
    out = {r["k"]: json.loads(r["data"]) for r in merged_payloads(df, ["k"], union_arrays=True).collect()}
    assert out["o"] == {"items": [{"id": 1}, {"id": 2}, {"id": 3}], "note": 'b "q"', "n": 2, "old": True}
    assert out["p"] == {}
    plain = {r["k"]: json.loads(r["data"]) for r in merged_payloads(df, ["k"]).collect()}
    assert plain["o"]["items"] == [{"id": 2}, {"id": 3}]


BATCH = (
    "channel string, name string, period string, value double, metric_date date, platform_id string, dims map<string,string>, "
    "dimensions_hash string, metadata string, data string, channeled_account string, channeled_account_id long, sequence long"
)


def batch(spark, *listed):
    built = [
        ("ads", n, p, float(v), date.fromisoformat(d), "row1", {}, "h", "{}", json.dumps({"v": v, f"k{s}": s}), "a1", 1, s)
        for s, (n, p, v, d) in enumerate(listed)
    ]
    return metrics.signature_of(spark.createDataFrame(built, BATCH))


def test_metric_load_end_to_end(spark, rows):
    first = batch(spark, ("clicks", "lifetime", 80, "2023-01-01"))
    tables = metrics.MetricTables(
        metrics.config_rows(first).limit(0), metrics.fact_rows(first).limit(0), spark.createDataFrame([], "platform_id string, channel string, metric_id long, platform_created_at date, data string")
    )
    parents = spark.createDataFrame([(1, 99)], "channeled_account_id long, account_id long")
    tables = metrics.load_batch(tables, first, parents)
    assert rows(tables.configs, "name", "period") == [("clicks", "lifetime"), ("clicks_daily", "daily")]
    loaded = metrics.load_batch(tables, batch(spark, ("clicks", "lifetime", 100, "2023-01-02"), ("clicks", "lifetime", 70, "2023-01-01")), parents)
    assert loaded.configs.count() == 2
    names = loaded.configs.select(F.col("id").alias("metric_config_id"), "name")
    facts = loaded.metrics.join(names, "metric_config_id")
    assert rows(facts, "name", "metric_date", "value") == [
        ("clicks", date(2023, 1, 1), 80.0),
        ("clicks", date(2023, 1, 2), 100.0),
        ("clicks_daily", date(2023, 1, 1), 80.0),
        ("clicks_daily", date(2023, 1, 2), 20.0),
    ]
    assert loaded.provenance.count() == 4
    merged = loaded.provenance.filter("platform_created_at = date'2023-01-01'").first()
    assert json.loads(merged["data"])["v"] == 70


def test_missing_account_comes_from_its_parent(spark):
    parents = spark.createDataFrame([(1, 99)], "channeled_account_id long, account_id long")
    assert metrics.config_rows(batch(spark, ("clicks", "daily", 1, "2023-01-01")), parents).first()["account_id"] == 99


def test_order_load(spark, rows):
    raw = spark.createDataFrame(
        [
            ("shop", "o1", None, ("c1", "x@e.com"), ["SALE"], [("p1", "v1"), ("p1", "v2")], '{"items":[1]}', 1),
            ("shop", "o1", None, ("c2", None), ["SALE", "TEN"], [("p2", None), (None, "v9")], '{"items":[2],"s":1}', 2),
            ("shop", "o2", None, None, [], [], "{}", 3),
        ],
        "channel string, platform_id string, platform_created_at timestamp, customer struct<id:string,email:string>, discount_codes array<string>, "
        "line_items array<struct<product_id:string,variant_id:string>>, data string, sequence long",
    )
    out = commerce.load_orders(raw)
    sizes = {n: t.count() for n, t in out.items()}
    assert sizes == {
        "orders": 2,
        "channeled_orders": 2,
        "customers": 1,
        "channeled_customers": 2,
        "channeled_discounts": 2,
        "channeled_products": 2,
        "channeled_product_variants": 2,
        "order_products": 2,
        "order_variants": 2,
        "order_discounts": 2,
    }
    order = out["channeled_orders"].filter("platform_id = 'o1'").first()
    assert json.loads(order["data"]) == {"items": [1, 2], "s": 1}
    customer = out["channeled_customers"].filter("platform_id = 'c1'").first()
    assert order["channeled_customer_id"] == customer["id"]


def test_rekeyed_configs(spark, rows):
    configs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "id long, name string, config_signature string")
    facts = spark.createDataFrame(
        [(1, "h", date(2026, 1, 1), 1.0), (2, "h", date(2026, 1, 1), 2.0), (1, "h", date(2026, 1, 2), 5.0), (3, "h", date(2026, 1, 1), 9.0)],
        "metric_config_id long, dimensions_hash string, metric_date date, value double",
    )
    kept, duplicates = merge.rekey_configs(configs, F.md5("name"))
    assert rows(kept, "id") == [(1,), (3,)]
    assert rows(merge.rekey_metrics(facts, duplicates), "metric_config_id", "value") == [(1, 2.0), (1, 5.0), (3, 9.0)]


def test_nesting_splits_big_parents(spark):
    parents = spark.range(3)
    children = spark.range(1000).select((F.col("id") % 2).alias("parent"), F.col("id").alias("child"))
    nested = R.nest_children(parents, "id", children, "parent", "kids", at_most=100)
    assert nested.select(F.explode("kids")).count() == 1000
    assert nested.agg(F.max(F.size("kids"))).first()[0] < 200
    assert nested.filter("id = 2").first()["kids"] is None
    whole = R.nest_children(parents, "id", children, "parent", "kids")
    assert whole.count() == 3


JOBS = (
    "id long, status int, channel string, entity string, priority int, worker_id string, payload string, message string, "
    "created_at timestamp, updated_at timestamp"
)


@pytest.fixture
def job_log(spark):
    def job(i, status, account="a1", channel="ads", kind="history", priority=1, start="2026-01-01", end="2026-01-02", instance="i1"):
        payload = {"params": {"type": kind, "startDate": start, "endDate": end}, "instance_name": instance}
        if account:
            payload["account_id"] = account
        return (i, status, channel, "metric", priority, None, json.dumps(payload), None, f"2026-01-05 00:00:{i:02d}", f"2026-01-05 01:00:{i:02d}")

    listed = [
        job(1, 3),
        job(2, 3, start="2026-01-02", end="2026-01-03"),
        job(3, 4),
        job(4, 6),
        job(5, 5),
        job(6, 1, kind="recent"),
        job(7, 1, account="a2", priority=9),
        job(8, 1, account="a2"),
        job(9, 2, account="a3"),
        job(10, 1, account="a3"),
        job(11, 1, account=None, instance="i2"),
        job(12, 3, account="a4", channel="web", end=None),
    ]
    rows_ = spark.createDataFrame(listed, JOBS.replace("timestamp", "string"))
    return rows_.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at")})


def test_job_reports(spark, job_log, rows):
    per_account = J.account_status(job_log)
    a1 = per_account.filter("account_id = 'a1'").first()
    assert (a1["total"], a1["completed"], a1["failed"], a1["scheduled"], a1["total_for_percentage"]) == (6, 2, 1, 1, 3)
    channels = {r["channel"]: r for r in J.channel_status(per_account).collect()}
    assert channels["web"]["completion_percentage"] == 100.0 and channels["web"]["fully_synced_count"] == 1
    assert channels["ads"]["completion_percentage"] == pytest.approx(16.67)
    overall = J.global_status(J.channel_status(per_account)).first()
    assert overall["completion_percentage"] == pytest.approx(58.34, abs=0.01) and overall["total_assets"] == 5
    assert rows(J.completed_days(job_log).filter("account_id = 'a1'"), "completed_day") == [(date(2026, 1, d),) for d in (1, 2, 3)]
    assert rows(J.completed_days(job_log).filter("account_id = 'a4'"), "completed_day") == [(date(2026, 1, 1),)]
    assert rows(J.unblocked(job_log), "id") == [(11,), (6,), (7,), (8,)]
    assert [r["id"] for r in J.backlog(job_log, per_account=1).collect()] == [7, 6, 11]
    assert rows(J.stuck_jobs(job_log, "2026-01-05 02:00:00"), "id") == [(9,)]
    disabled = spark.createDataFrame([("a2", False), ("a1", True)], "platform_id string, enabled boolean")
    assert J.account_status(job_log, disabled).filter("account_id = 'a2'").count() == 0
    history = J.history(job_log).filter("account_id = 'a1' AND start_date = '2026-01-01'").first()
    assert (history["id"], history["history"]) == (6, [5, 6, 4, 3])


def test_inventory(spark, rows):
    accounts = spark.createDataFrame([(1, "p1", "ads", "page"), (2, "p2", "web", None)], "id long, platform_id string, channel string, type string")
    tables = {
        "campaigns": spark.createDataFrame([("x", 1), ("x", 1), ("x", None)], "channel string, channeled_account_id long"),
        "pages": spark.createDataFrame([("p1",), ("p9",)], "platform_id string"),
        "plain": spark.createDataFrame([("z",)], "channel string"),
    }
    assert rows(inventory.row_inventory(tables, accounts)) == [
        ("campaigns", "x", "page", 2),
        ("campaigns", "x", None, 1),
        ("pages", "ads", "page", 1),
        ("pages", None, None, 1),
        ("plain", "z", None, 1),
    ]


EVENTS = [
    {"executor_path_decision": "legacy", "executor_fallback_reason": "missing_profile_capability", "planner_diagnostics": {"profile_channel": "Alpha", "profile_checked": True, "profile_supported": False}},
    {"executor_path_decision": "legacy", "fallback_reason": "missing_profile_capability", "planner_diagnostics": {"profile_channel": "beta"}},
    {"executor_path_decision": "LEGACY", "planner_diagnostics": {"profile_channel": "alpha"}},
    {"executor_path_decision": "optimized", "planner_diagnostics": {}},
]


def test_event_log_files(spark, tmp_path, rows):
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "a.jsonl").write_text("\n".join(json.dumps(e) for e in EVENTS) + "\nnot json\n")
    documents = tmp_path / "documents"
    documents.mkdir()
    (documents / "a.json").write_text(json.dumps(EVENTS[:2], indent=1))
    (documents / "b.json").write_text(json.dumps({"events": EVENTS[2:]}))
    (documents / "c.json").write_text("broken {")
    for events in (files.read_event_log(spark, str(lines)), files.read_event_documents(spark, str(documents))):
        total = fallbacks.fallback_totals(events, ["Alpha", "beta"]).first()
        assert tuple(total) == (4, 3, 2, 2, 0)
        assert tuple(fallbacks.fallback_totals(events, ["beta"]).first())[3:] == (1, 1)
        assert rows(fallbacks.fallback_by_channel(events), "channel", "events") == [("alpha", 2), ("beta", 1), ("unknown", 1)]


def test_orphans_read_a_table_once_and_combine_first(spark, tmp_path, rows):
    entities = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    spark.createDataFrame([(1, None), (1, 2), (None, None)], "page long, parent long").write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    users = [(facts, "page"), (facts, "parent")]
    assert rows(R.orphans(entities, "id", users)) == [(3,), (None,)]
    assert rows(R.without_orphans(entities, "id", users)) == [(1,), (2,)]
    plan = R.orphans(entities, "id", users)._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [") == 1
    assert "partial" in plan.executedPlan().toString() or plan.executedPlan().toString().count("HashAggregate") >= 2


def test_event_sink_appends_by_day(spark, tmp_path):
    events = spark.createDataFrame([("2026-01-01 10:00:00", 1), ("2026-01-02 10:00:00", 2)], "timestamp string, n long")
    path = str(tmp_path / "log")
    files.append_event_log(events, path)
    files.append_event_log(events, path)
    back = spark.read.json(path)
    assert back.count() == 4 and back.select("date").distinct().count() == 2


def test_log_files(spark, tmp_path):
    (tmp_path / "app.log").write_text("\n".join(f"line {i} {'ERROR' if i % 2 else 'fine'}" for i in range(50)))
    (tmp_path / "web.log").write_text("all good\nA Fatal thing\n")
    digest = R.error_lines(files.read_log_lines(spark, str(tmp_path)), keep=3)
    found = sorted(r["line"] for r in digest.collect())
    assert found == ["A Fatal thing", "line 45 ERROR", "line 47 ERROR", "line 49 ERROR"]


def test_fact_files_prune_months(spark, tmp_path):
    facts = spark.createDataFrame([(date(2026, m, 15), m, float(m)) for m in range(1, 7)], "metric_date date, metric_config_id long, value double")
    path = str(tmp_path / "facts")
    files.write_facts(facts, path)
    kept = files.read_facts(spark, path, "2026-02-01", "2026-03-31")
    assert kept.agg(F.sum("value")).first()[0] == 5.0
    assert "month" in kept._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_incremental_load_is_idempotent(spark, tmp_path, rows):
    source, target, progress = (str(tmp_path / n) for n in ("in", "facts", "progress"))
    schema = "k string, value double"
    keys = ["k"]

    def arrive(*values):
        spark.createDataFrame(list(values), schema).coalesce(1).write.mode("append").parquet(source)

    def load():
        stream = follow_files(spark, source, spark.createDataFrame([], schema).schema, lambda df: df, keys, target, progress)
        stream.awaitTermination()
        return rows(read_merged(spark, target, keys))

    arrive(("a", 7.0), ("b", 1.0), ("a", 3.0))
    assert load() == [("a", 7.0), ("b", 1.0)]
    arrive(("a", 5.0), ("b", 2.0))
    assert load() == [("a", 7.0), ("b", 2.0)]
    assert load() == [("a", 7.0), ("b", 2.0)]
    base = str(tmp_path / "base")
    assert rows(compact(spark, target, keys, base)) == [("a", 7.0), ("b", 2.0)]
    arrive(("b", 9.0), ("c", 1.0))
    load()
    assert rows(read_merged(spark, target, keys, base, after=1)) == [("a", 7.0), ("b", 9.0), ("c", 1.0)]


def test_coverage(spark, rows):
    facts = spark.createDataFrame([("x", date(2026, 1, d)) for d in (1, 3, 4)] + [("y", date(2025, 1, 1))], "channel string, metric_date date")
    assert rows(R.coverage(facts, "2026-01-04", 4)) == [("x", 1, 75.0), ("y", 3, 25.0)]
    assert rows(R.missing_days(facts, "2026-01-04", 4).filter("channel = 'x'"), "missing_day") == [(date(2026, 1, 2),)]


def test_fact_files_merge_touches_its_months_only(spark, tmp_path, rows):
    schema = "metric_config_id long, dimensions_hash string, metric_date date, value double"
    path = str(tmp_path / "facts")
    files.write_facts(spark.createDataFrame([(1, "h", date(2026, m, 15), float(m)) for m in (1, 2, 3)], schema), path)
    january = {p.name for p in (tmp_path / "facts" / "month=202601").iterdir()}
    batch = spark.createDataFrame([(1, "h", date(2026, 2, 15), 1.0), (1, "h", date(2026, 3, 15), 9.0), (2, "h", date(2026, 4, 1), 4.0)], schema)
    for load in ("one", "again"):
        assert files.merge_fact_files(spark, batch, path, load) == [202602, 202603, 202604]
        got = rows(files.read_facts(spark, path), "metric_config_id", "metric_date", "value")
        assert got == [
            (1, date(2026, 1, 15), 1.0),
            (1, date(2026, 2, 15), 2.0),
            (1, date(2026, 3, 15), 9.0),
            (2, date(2026, 4, 1), 4.0),
        ]
    assert {p.name for p in (tmp_path / "facts" / "month=202601").iterdir()} == january


def test_bucketed_tables_join_without_a_shuffle(spark):
    facts = spark.range(1000).select((F.col("id") % 50).alias("metric_config_id"), F.col("id").cast("double").alias("value"))
    configs = spark.range(50).select(F.col("id").alias("metric_config_id"), F.lit("clicks").alias("name"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frame, name in ((facts, "bucketed_facts"), (configs, "bucketed_configs")):
            files.write_bucketed(frame, name, "metric_config_id", 4)
        joined = spark.table("bucketed_facts").join(spark.table("bucketed_configs"), "metric_config_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_facts", "bucketed_configs"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_references_are_looked_up_within_their_channel(spark, rows):
    """Two channels know account 7; a reference finds its own, and no row multiplies."""
    accounts = spark.createDataFrame([(1, "ads", "7"), (2, "shop", "7"), (9, "ads", "7"), (3, "ads", "8")], "id long, channel string, platform_id string")
    batch = spark.createDataFrame([("ads", "7", 1), ("shop", "7", 2), ("mail", "7", 3), ("ads", None, 4)], "channel string, channeled_account string, n int")
    got = metrics.resolve_keys(batch, {"channeled_account": (accounts, "platform_id")})
    assert rows(got, "n", "channeled_account_id") == [(1, 1), (2, 2), (3, None), (4, None)]
    unchanneled = metrics.resolve_keys(batch, {"channeled_account": (accounts.drop("channel"), "platform_id")})
    assert rows(unchanneled, "n", "channeled_account_id") == [(1, 1), (2, 1), (3, 1), (4, None)]


def test_ads_take_account_and_campaign_from_their_own_ad_group(spark, rows):
    groups = spark.createDataFrame([(5, "ads", "g", 50, 500), (6, "shop", "g", 60, 600), (7, "ads", "g", 70, 700)], "id long, channel string, platform_id string, channeled_account_id long, channeled_campaign_id long")
    columns = "channel string, platform_id string, ad_group_ref string, creative_ref string, name string, status string, data string, sequence long"
    batch = spark.createDataFrame([("ads", "a1", "g", "c", "n", "s", "{}", 1), ("shop", "a2", "g", "x", "n", "s", "{}", 2)], columns)
    creatives = entities.load_creatives(spark.createDataFrame([("c", "old", "{}", 1), ("c", "new", "{}", 2)], "platform_id string, name string, data string, sequence long"))
    assert rows(creatives, "creative_id", "name") == [("c", "new")]
    ads = entities.load_ads(batch, groups, creatives.withColumnRenamed("id", "key").withColumn("id", F.col("key")))
    assert rows(ads, "platform_id", "channeled_ad_group_id", "channeled_account_id", "channeled_campaign_id") == [("a1", 5, 50, 500), ("a2", 6, 60, 600)]


def test_event_documents_are_bounded(spark, tmp_path):
    day = F.when(F.col("id") % 20 == 0, "2026-01-02").when(F.col("id") % 33 != 0, "2026-01-01")
    planner = F.struct(F.concat(F.lit("ch"), F.col("id").cast("string")).alias("profile_channel"), F.lit(True).alias("profile_checked"), F.lit(None).cast("boolean").alias("profile_supported"))
    events = spark.range(3000).select(F.concat(day, F.lit(" 10:00:00")).alias("timestamp"), F.lit("Legacy").alias("executor_path_decision"), F.lit("x").alias("executor_fallback_reason"), planner.alias("planner_diagnostics"))
    for wrap in (False, True):
        path = str(tmp_path / f"documents-{wrap}")
        files.write_event_documents(events, path, wrap, size=100)
        texts = spark.read.text(path, wholetext=True).collect()
        sizes = [r.value.count("profile_checked") for r in texts]
        assert sum(sizes) == 3000 and max(sizes) <= 200 and len(sizes) >= 25
        assert all(r.value.startswith('{"events"') == wrap for r in texts)
        read = files.read_event_documents(spark, path)
        assert read.count() == 3000 and read.select("planner_diagnostics.profile_channel").distinct().count() == 3000


PAYLOADS = [("a", i, json.dumps({"items": [i % 7, {"n": i % 3}], "note": f"n{i}", 'q"[]': None})) for i in range(200)] + [
    ("b", 1, '{"items":[1,1,2]}'), ("b", 2, '{"items":[]}'), ("c", 1, '{"x":1}'), ("c", 2, "no json"), ("d", None, '{"x":1,"y":[2]}'), ("e", 1, None), (None, 3, '{"x":[3]}'), ("f", 1, '{"x":[1]}'), ("f", 2, '{"x":"text"}')
]


def test_payloads_merge_alike_in_place_and_apart(spark, monkeypatch):
    from tidemark.ingest import payloads

    df = spark.createDataFrame(PAYLOADS, "k string, sequence long, data string")
    for union in (False, True):
        in_place = merged_payloads(df, ["k"], union_arrays=union)
        assert "Generate" not in in_place._jdf.queryExecution().optimizedPlan().toString()
        whole = sorted(map(str, in_place.collect()))
        apart = payloads._merged_apart(df, ["k"], "sequence", "data", union)
        assert sorted(map(str, apart.collect())) == whole
        with monkeypatch.context() as small:
            small.setattr(payloads, "SMALL_BUCKET", 1000)
            # One row key has most of the bytes: it is taken apart, the others are not.
            mixed = merged_payloads(df, ["k"], union_arrays=union)
            plan = mixed._jdf.queryExecution().optimizedPlan().toString()
            assert "Generate" in plan and "RepartitionByExpression" in plan
            assert sorted(map(str, mixed.collect())) == whole


def test_last_writes_merge_into_the_largest_in_one_step(spark, rows):
    keys = ["k", "day"]
    stored = keyed(spark, ("a", 7, "old"), ("b", 1, None), ("c", 5, "only"))
    day = date(2026, 1, 1)
    batch = spark.createDataFrame(
        [("a", day, 9.0, "x", 1), ("a", day, 3.0, "y", 2), ("b", day, 4.0, "z", 1), ("d", day, 8.0, "p", 1), ("d", day, 2.0, "q", 2), ("e", day, 6.0, "n", None), ("a", day, 99.0, "null", None)], KEYED + ", seq long"
    )
    merged = merge.merge_last_into_largest(stored, batch, keys, "seq")
    assert rows(merged) == rows(merge.merge_largest(stored, merge.last_write_wins(batch, keys, "seq").drop("seq"), keys))
    assert rows(merged, "k", "value", "note") == [("a", 7.0, "old"), ("b", 4.0, None), ("c", 5.0, "only"), ("d", 2.0, "q"), ("e", None, None)]


def test_loads_read_a_batch_that_is_stored(spark, folder):
    """Several loads take parts of it, so what it comes from runs once."""
    from tidemark.queries import loads

    _, whole, late = loads._versioned(spark, folder)
    assert all("staged-metrics" in f for df in (whole, late) for f in df.inputFiles())


def test_a_batch_without_lifetime_rows_is_staged_once(spark):
    from tidemark.ingest.storage import MetricStore
    from tidemark.ingest.versions import VersionedStore
    from tidemark.session import shared_folder
    from tidemark.sources.store import Files

    for kind, columns in ((MetricStore, ""), (VersionedStore, ", channeled_account_id bigint, page_id bigint")):
        root = f"{shared_folder(spark)}/once-{kind.__name__}-{date.today():%j}-{id(kind)}"
        store = kind(spark, root, f"id bigint, config_signature string, channel string, name string, period string{columns}")
        if kind is MetricStore:
            store.create()
        files = Files(spark, root)
        for period, expected in (("daily", {"batch"}), ("lifetime", {"batch", "full"})):
            store.load(batch(spark, ("clicks", period, 5, "2023-01-02")), period)
            folder = next(n for n in files.names(f"{root}/_staging") if n.startswith(period))
            assert {n.split("-")[0] for n in files.names(f"{root}/_staging/{folder}")} - {"facts", "provenance"} == expected
