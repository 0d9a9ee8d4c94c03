"""The packed event sink, also when a packing breaks off, and packed text logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reads as R
from tidemark.sources import files
from tidemark.sources.sink import EventSink
from tidemark.sources.store import Conflict

SCHEMA = "timestamp string, n long"


def appended(spark, path, times=4, rows=60):
    sink = EventSink(spark, str(path))
    for k in range(times):
        day = F.when(F.col("id") % 3 == 0, "2026-01-02 10:00:00").otherwise("2026-01-01 09:00:00")
        sink.append(spark.range(k * rows, (k + 1) * rows, numPartitions=3).select(day.alias("timestamp"), F.col("id").alias("n")))
    return sink


def numbers(sink, *dates):
    return sorted(r["n"] for r in sink.read(SCHEMA, *dates).collect())


def test_packing_keeps_rows_and_bounds_files(spark, tmp_path):
    sink = appended(spark, tmp_path / "log")
    before = sink.live()
    assert all(len(own) >= 12 for own in before.values())
    total = {day: sum(own.values()) for day, own in before.items()}
    assert sink.pack(size=2000) == 2
    after = sink.live()
    assert {day: sum(own.values()) for day, own in after.items()} == total
    assert all(len(own) <= -(-total[day] // 2000) for day, own in after.items())
    assert numbers(sink) == list(range(240))
    assert numbers(sink, "2026-01-02", "2026-01-02") == list(range(0, 240, 3))
    sink.vacuum()
    assert numbers(sink) == list(range(240)) and sink.live() == after


def test_appends_after_a_packing_are_packed_again(spark, tmp_path):
    sink = appended(spark, tmp_path / "log", times=2)
    sink.pack(size=1 << 20)
    assert all(len(own) == 1 for own in sink.live().values())
    assert sink.pack(size=1 << 20) == 0
    sink.append(spark.range(120, 150).select(F.lit("2026-01-01 00:00:00").alias("timestamp"), F.col("id").alias("n")))
    assert numbers(sink) == list(range(150))
    assert sink.pack(size=1 << 20) == 1
    assert all(len(own) == 1 for own in sink.live().values()) and numbers(sink) == list(range(150))


@pytest.mark.parametrize("step", ["written", "committed"])
def test_a_packing_that_breaks_off_loses_and_repeats_nothing(spark, tmp_path, step):
    sink = appended(spark, tmp_path / "log", times=2)

    def broken(at):
        if at == step:
            raise OSError(at)

    with pytest.raises(OSError):
        sink.pack(size=1 << 20, at=broken)
    assert numbers(sink) == list(range(120))
    sink.pack(size=1 << 20)
    sink.vacuum()
    assert numbers(sink) == list(range(120)) and all(len(own) == 1 for own in sink.live().values())


def test_two_packings_at_once(spark, tmp_path):
    sink, other = appended(spark, tmp_path / "log", times=2), EventSink(spark, str(tmp_path / "log"))
    with pytest.raises(Conflict):
        sink.pack(size=1 << 20, at=lambda step: other.pack(size=1 << 20) if step == "written" else None)
    assert numbers(sink) == list(range(120))


def test_an_empty_sink_and_undated_events(spark, tmp_path):
    sink = EventSink(spark, str(tmp_path / "log"))
    assert sink.read(SCHEMA).count() == 0 and sink.pack() == 0
    for n in (1, 2):
        sink.append(spark.createDataFrame([(None, n)], SCHEMA))
    assert sink.pack() == 1 and numbers(sink) == [1, 2] and numbers(sink, "2026-01-01", None) == []
    assert {r["date"] for r in sink.read(SCHEMA).collect()} == {None}


def test_packed_logs_split_hot_ones_and_join_small_ones(spark, tmp_path):
    hot = spark.range(4000).select(F.lit("hot log/1").alias("log"), "id", F.concat(F.lit("line\n"), F.col("id").cast("string"), F.when(F.col("id") % 100 == 0, "\tERROR").otherwise("")).alias("line"))
    small = spark.range(200).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("log"), "id", F.lit("fatal").alias("line"))
    path = str(tmp_path / "logs")
    files.write_logs(hot.unionByName(small), path, "log", ["id"], size=10_000)
    written = [p for p in (tmp_path / "logs").iterdir() if p.name.startswith("part-")]
    assert 5 <= len(written) <= 12 and max(p.stat().st_size for p in written) < 30_000
    read = files.read_logs(spark, path)
    assert read.count() == 4200 and read.select("file").distinct().count() == 201
    ordered = [r["line"] for r in read.filter("file = 'hot log/1'").orderBy("line_no").collect()]
    assert [int(x.split()[1]) for x in ordered] == list(range(4000))
    digest = R.error_lines(read, keep=2).filter("file = 'hot log/1'").collect()
    assert sorted(r["line"] for r in digest) == ["line 3800\tERROR", "line 3900\tERROR"]
    last = files.last_lines(spark, path, "(?i)error|fatal", 3)
    assert [r["file"] for r in last.collect()] == ["s99", "s98", "s97"] and len(last.inputFiles()) == 1
    assert [r["line"] for r in files.last_lines(spark, path, "ERROR", 45).limit(2).collect()] == ["line 3900\tERROR", "line 3800\tERROR"]
    assert files.last_lines(spark, path, "ERROR", 45).count() == 40


def test_logs_without_lines(spark, tmp_path):
    path = str(tmp_path / "logs")
    files.write_logs(spark.createDataFrame([], "log string, id long, line string"), path, "log", ["id"])
    assert files.read_logs(spark, path).count() == 0 and files.last_lines(spark, path, "x", 5).count() == 0
