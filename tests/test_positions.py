"""Places in a global order, ordered parts, and the pages, nestings and unions that rest on them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.ingest.payloads import array_unions, merged_payloads
from tidemark.operators import reads as R
from tidemark.operators.positions import RangeIndex, in_parts
from tidemark.plans.request import page_of


def test_positions_follow_the_order(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("k"))
    index = RangeIndex.build(df, [F.col("k").desc(), "id"], str(tmp_path / "i"), ranges=6)
    assert index.counts.count() == 6
    placed = [r["id"] for r in index.positions().orderBy("__position").collect()]
    assert placed == sorted(range(5000), key=lambda i: (-(i % 7), i))
    assert sorted(r[0] for r in index.positions().select("__position").collect()) == list(range(5000))


def test_pages_read_their_ranges_only(spark, tmp_path):
    df = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(40)).alias("k"), F.lit("x").alias("wide"))
    RangeIndex.build(df.select("id", "k"), ["k", "id"], str(tmp_path / "i"), ranges=10)
    index = RangeIndex(spark, str(tmp_path / "i"))
    for page in (0, 17, 59, 60, 1000):
        expected = page_of(df, ["k", "id"], 50, page).collect()
        assert index.page_with(df, "id", 50, page).collect() == expected
    plan = index.page(50, 17)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "__range" in filters and filters.count(",") <= 2


def test_an_index_without_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, k string")
    index = RangeIndex.build(empty, ["k", "id"], str(tmp_path / "i"))
    assert index.page(10, 0).count() == 0 and index.page_with(empty, "id", 10).columns == ["id", "k"]
    assert in_parts(empty, ["k"], ["id"], 3).count() == 0


def test_parts_are_full_and_in_order(spark):
    """A key with most of the rows, repeated rows, a null key and single rows."""
    keys = F.when(F.col("id") < 700, "hot").when(F.col("id") < 703, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    df = spark.range(1000).select(keys.alias("k"), (F.col("id") % 350).alias("v"))
    got = in_parts(df, ["k"], ["v"], 100)
    by_key: dict = {}
    for r in got.collect():
        by_key.setdefault(r["k"], {}).setdefault(r["part"], []).append(r["v"])
    assert sorted(by_key["hot"]) == list(range(7)) and all(len(p) == 100 for p in by_key["hot"].values())
    assert [v for p in sorted(by_key["hot"]) for v in sorted(by_key["hot"][p])] == sorted([*range(350), *range(350)])
    assert set(by_key[None]) == {0} and len(by_key[None][0]) == 3
    assert sum(len(p) for own in by_key.values() for p in own.values()) == 1000


def test_nesting_in_parts(spark):
    parents = spark.range(4)
    children = spark.range(1001).select(F.when(F.col("id") < 1000, F.col("id") % 2).otherwise(F.lit(None)).alias("parent"), F.col("id").alias("child"))
    rows = R.nest_in_parts(parents, "id", children, "parent", "kids", at_most=120).orderBy("id", "kids_part").collect()
    own = [r for r in rows if r["id"] == 1]
    assert [r["kids_part"] for r in own] == [0, 1, 2, 3, 4] and [r["kids_before"] for r in own] == [0, 120, 240, 360, 480]
    assert [c["child"] for r in own for c in r["kids"]] == list(range(1, 1000, 2))
    assert [(r["kids_part"], r["kids"]) for r in rows if r["id"] == 2] == [(None, None)]


def test_unions_in_parts_equal_whole_unions(spark):
    listed = [("hot", i, json.dumps({"items": [i % 90, {"a": i % 40}], "note": "n"})) for i in range(300)]
    listed += [("a", 1, '{"items":[1,2]}'), ("a", 2, '{"items":"none"}'), ("b", 1, '{"items":[3,3,1]}'), (None, 1, '{"items":[7]}'), ("c", 1, "no json"), ("d", 1, '{"items":[]}'), ("e", 1, None)]
    df = spark.createDataFrame(listed, "k string, sequence long, data string")
    parts = array_unions(df, ["k"], at_most=16).orderBy("k", "part").collect()
    assert max(r["size"] for r in parts) == 16
    joined: dict = {}
    for r in parts:
        assert r["key"] == "items" and len(json.loads(r["elements"])) == r["size"]
        joined.setdefault(r["k"], []).extend(json.loads(r["elements"]))
    whole = {r["k"]: json.loads(r["data"]).get("items") for r in merged_payloads(df, ["k"], union_arrays=True).collect()}
    assert joined == {k: v for k, v in whole.items() if k in ("hot", "b", None)}
    assert len(joined["hot"]) == 130


def test_only_large_keys_are_put_in_order(spark, monkeypatch):
    """Keys of one part need no order; with one larger key, only its rows are ordered."""
    seen = []
    build = RangeIndex.build.__func__

    def counted(cls, df, *args, **kwargs):
        seen.append(df.count())
        return build(cls, df, *args, **kwargs)

    monkeypatch.setattr(RangeIndex, "build", classmethod(counted))
    df = spark.range(40).select((F.col("id") % 10).alias("k"), F.col("id").alias("v"))
    assert {r["part"] for r in in_parts(df, ["k"], ["v"], 4).collect()} == {0} and not seen
    parents = spark.range(12)
    nested = R.nest_in_parts(parents, "id", df, "k", "kids", at_most=4).collect()
    assert not seen and sorted(len(r["kids"] or []) for r in nested) == [0, 0] + [4] * 10
    large = df.unionByName(spark.range(100, 109).select(F.lit(3).cast("long").alias("k"), F.col("id").alias("v")))
    rows = R.nest_in_parts(parents, "id", large, "k", "kids", at_most=4).orderBy("id", "kids_part").collect()
    assert seen == [13]
    assert [[c["v"] for c in r["kids"]] for r in rows if r["id"] == 3] == [[3, 13, 23, 33], [100, 101, 102, 103], [104, 105, 106, 107], [108]]
    assert [(r["kids_part"], r["kids_before"], [c["v"] for c in r["kids"]]) for r in rows if r["id"] == 4] == [(0, 0, [4, 14, 24, 34])]
