"""Shards and mixes against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, mixed_documents, permuted, source_targets, taken_words
from tidemark.llm.queries import QUERIES
from tidemark.llm.sharding import byte_shards


def plain_shards(rows, shards):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    sizes = [len((r[1] or "").encode()) + 1 for r in rows]
    total, start, out = sum(sizes), 0, []
    for r, size in zip(rows, sizes):
        out.append((r[0], size, zlib.crc32((r[1] or "").encode()), min(shards - 1, (2 * start + size) * shards // (2 * total))))
        start += size
    return out


def test_byte_shards(spark, folder, docs):
    got = QUERIES["op5_byte_shards"](spark, folder).collect()
    want = plain_shards([(r.doc_id, r.text) for r in docs.collect()], 8)
    assert sorted((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == sorted(want)
    for shard in range(8):
        rows = sorted((r.slot, r.doc_id) for r in got if r.shard == shard)
        assert [s for s, _ in rows] == list(range(len(rows))) and [d for _, d in rows] == sorted(d for _, d in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_byte_shards_of_odd_rows(odd, nothing):
    got = byte_shards(odd, 3).collect()
    assert sorted(r["size"] for r in got) == sorted(len((r.text or "").encode()) + 1 for r in odd.collect())
    for shard in range(3):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert max(r.start + r["size"] for r in got) == sum(r["size"] for r in got)
    assert byte_shards(nothing, 3).count() == 0
    with pytest.raises(ValueError):
        byte_shards(odd, 0)


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, None: 1000, "é": 1}, {"a": 0, "b": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 10_000, "d": 0, None: 5}])
def test_targets(spark, sizes):
    rows = [("n" if s is None else "s" + s, s, n) for s, n in sizes.items()]
    got = source_targets(spark.createDataFrame(rows, "skey string, source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000])
def test_permutation(spark, size):
    p = spark.range(size).withColumn("p", permuted(F.col("id"), F.lit(size).cast("long"), F.lit("k")))
    rows = p.withColumn("b", permuted(F.col("p"), F.lit(size).cast("long"), F.lit("k"), back=True)).collect()
    assert sorted(r.p for r in rows) == list(range(size)) and all(r.id == r.b for r in rows)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_meets_targets(spark, folder, docs):
    got = QUERIES["op7_block_mix"](spark, folder).collect()
    again = QUERIES["op7_block_mix"](spark, folder).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size, source = {r.doc_id: len(words(r.text)) for r in docs.collect()}, {r.doc_id: r.source for r in docs.collect()}
    by_source = defaultdict(int)
    for d, n in size.items():
        by_source[source[d]] += n
    want, taken = plain_targets(by_source), defaultdict(int)
    assert len(got) == len(size)
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], by_source[source[r.doc_id]])
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - t) <= 0.51 for s, t in want.items())


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_of_odd_rows(odd, block):
    mixed = mix(odd, block=block)
    got = taken_words(mixed).collect()
    rows = odd.collect()
    assert sorted((r["size"], str(r.source)) for r in got) == sorted((len(words(r.text)), str(r.source)) for r in rows)
    by_source = defaultdict(int)
    for r in rows:
        by_source[r.source] += len(words(r.text))
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.51 for s, t in plain_targets(by_source).items())
    # Slots name each block at most once per pass, and number each shard without gaps.
    slots = mixed.slots.collect()
    assert len({(s.skey, s["pass"], s.block) for s in slots}) == len(slots)
    assert sorted(s.shard * 4096 + s.slot for s in slots) == list(range(len(slots)))


def test_mixed_texts_hold_the_words_taken(odd, nothing):
    out = mixed_documents(odd)
    assert out.columns == odd.columns
    total = sum(len(words(r.text)) for r in odd.collect())
    assert abs(sum(len(words(r.text)) for r in out.collect()) - total) <= 5
    texts = [words(r.text) for r in odd.collect()]
    for r in out.collect():
        assert any(set(words(r.text)) <= set(t) for t in texts)
    assert mixed_documents(nothing).count() == 0 and taken_words(mix(nothing)).count() == 0


def test_sql_counterparts(spark, folder):
    from compare import difference, duck
    from tidemark.llm.queries import SQL
    from tidemark.queries.registry import Query

    con = duck(folder)
    for name, sql in SQL.items():
        assert difference(Query(name, QUERIES[name], sql), spark, con, folder) is None
