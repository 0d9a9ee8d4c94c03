"""Documents with a Jaccard similarity of word shingles above a threshold.

Candidates come from bands of MinHash values. Values are compared a few at a time
and a pair is dropped as soon as the posterior probability that it reaches the
threshold falls below a tolerance; the rest is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, saved, sorted_groups
from tidemark.llm.components import components

KNOWN_WORDS = 400_000
PAIRS_AT_ONCE = 60_000


@dataclass(frozen=True)
class Similarity:
    """Parameters. A pair at the threshold escapes all bands with a probability of (1 - t^rows)^bands, here 5e-8."""

    threshold: float = 0.8
    shingle: int = 5
    bands: int = 32
    rows: int = 4
    step: int = 16
    tolerance: float = 1e-9
    block_rows: int = 256
    block_bytes: int = 8_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def needed(self) -> list[tuple[int, int]]:
        """After so many values, the equal ones below which a pair is dropped.

        With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1),
        and its mass above t is the probability of at most m in n + 1 trials of t.
        """
        t, out = self.threshold, []
        for n in range(self.step, self.hashes + 1, self.step):
            mass, m = 0.0, 0
            while m <= n:
                mass += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if mass >= self.tolerance:
                    break
                m += 1
            out.append((n, m))
        return out


class Shingler:
    """Sets of hashed shingles, and their MinHash values."""

    def __init__(self, how: Similarity):
        self.how, self.known = how, {}
        rng = np.random.Generator(np.random.PCG64(11))
        self.factor = rng.integers(1, 2**32, how.hashes, dtype=np.uint32) | np.uint32(1)
        self.mask = rng.integers(0, 2**32, how.hashes, dtype=np.uint32)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words than a shingle is one shingle."""
        words = text.encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        at = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        size = min(self.how.shingle, len(at))
        h = np.full(len(at) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            h = (h ^ at[k : len(at) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.how.hashes, 2**32 - 1, dtype=np.uint32)
        for k in range(0, len(values), 1024):
            np.minimum(least, ((values[k : k + 1024, None] ^ self.mask) * self.factor).min(axis=0), out=least)
        return least


def surviving(values: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are still likely enough after each step."""
    equal, done = np.zeros(len(i), dtype=np.int32), 0
    for n, least in needed:
        equal += (values[i, done:n] == values[j, done:n]).sum(axis=1, dtype=np.int32)
        live = equal >= least
        i, j, equal, done = i[live], j[live], equal[live], n
    return i, j


def linked_roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member that each of 0 .. size-1 is connected to."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    return (i[i < j], j[i < j]) if same else (i, j)


def _in_blocks(df: DataFrame, group: str, rows: int, size: str = "n", bytes_column: str | None = None, block_bytes: int = 1) -> DataFrame:
    """Split large groups: each row goes to the tasks of its block with every other block.

    Two blocks meet in exactly one task, so no pair is lost or seen twice.
    """
    blocks = F.ceil(F.col(size) / rows)
    if bytes_column:
        blocks = F.greatest(blocks, F.ceil(F.col(bytes_column) / block_bytes))
    df = df.withColumn("_blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("rid"), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    df = df.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_blocks", "_other")
    return df.repartition(partitions(df.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j")


def _signatures(docs: DataFrame, how: Similarity, kind: str) -> DataFrame:
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how)
        for batch in batches:
            made = []
            for text in batch["text"].to_pylist():
                shingles = shingler.shingles(text)
                key = xxhash.xxh128_digest(shingles.tobytes())
                made.append((*np.frombuffer(key, dtype=np.int64).tolist(), len(shingles), len(text), shingler.signature(shingles).tobytes()))
            k1, k2, n, chars, values = zip(*made, strict=True) if made else ((),) * 5
            yield pa.record_batch(
                [batch["id"], batch["t1"], batch["t2"], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int64()), pa.array(chars, pa.int64()), pa.array(values, pa.binary())],
                names=["id", "t1", "t2", "k1", "k2", "shingles", "chars", "signature"],
            )

    return docs.mapInArrow(signed, f"id {kind}, t1 long, t2 long, k1 long, k2 long, shingles long, chars long, signature binary")


def similar_documents(docs: DataFrame, how: Similarity = Similarity(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Links between documents, as counts and classes.

    Returns one row per input row: id, ``copy_id`` (least id with the same set of
    shingles), ``class_id`` (least id of the documents connected by links; a link
    is a similarity of ``threshold`` or more) and ``n_links`` (other rows linked
    directly, copies counted). Pairs are never written out:

    1. Rows with equal sets become one; a hot text is combined before the shuffle.
    2. Rows that share a band meet in buckets, large ones in pairs of blocks.
       What survives the comparison of MinHash bytes connects them to clusters.
    3. Texts go to their cluster once (once per block in a large one). There all
       pairs are compared by whole values, and the survivors by whole sets.

    A text of fewer words than a shingle is one shingle. A null text and one
    without words has none and is linked to nothing, not even to others like it.
    A null id sorts before others only among itself: it is nobody's least id
    unless all ids are null. Equal rows are copies of each other. Columns other
    than id and text are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))
    signed = saved(_signatures(texts, how, kind), "signatures")

    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2"))
    sets = signed.where("shingles > 0").groupBy("k1", "k2").agg(first.alias("first"), F.count("*").alias("copies"), F.first("chars").alias("chars"), F.first("signature").alias("signature"))
    sets = saved(sets.select("k1", "k2", "first.id", "first.t1", "first.t2", "copies", "chars", "signature", F.monotonically_increasing_id().alias("rid")), "sets")

    clusters = saved(components(_candidate_links(sets, how)), "clusters")
    verified = saved(_verified(texts, sets, clusters, how), "verified")
    links = verified.groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rid")

    marked = sets.select("k1", "k2", "id", "copies", "rid").join(links, "rid", "left").join(joined, "rid", "left")
    marked = saved(marked.select("k1", "k2", "id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rid").alias("root")), "marked")
    least = marked.groupBy("root").agg(F.min("id").alias("class_id"))
    marked = marked.join(least, "root").select("k1", "k2", F.col("id").alias("copy_id"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    rows = signed.select("id", "k1", "k2", (F.col("shingles") > 0).alias("any"))
    out = rows.join(marked, ["k1", "k2"], "left")
    return out.select(
        F.col("id").alias(id_column),
        F.when(F.col("any"), F.col("copy_id")).otherwise(F.col("id")).alias("copy_id"),
        F.when(F.col("any"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _candidate_links(sets: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) that connect all pairs which share a band and survive the comparison."""
    width = 4 * how.rows
    bands = sets.select("rid", "signature", F.explode(F.sequence(F.lit(0), F.lit(how.bands - 1))).alias("band"))
    bands = bands.select("rid", F.xxhash64("band", F.expr(f"substring(signature, band * {width} + 1, {width})")).alias("bucket"))
    bands = saved(bands, "bands")
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = bands.join(shared, "bucket").join(sets.select("rid", "signature"), "rid")
    blocks = _in_blocks(members, "bucket", how.block_rows)
    needed = how.needed()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, values, left, right, rows, pairs = [], [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal rids, values, left, right, rows, pairs
            if not pairs:
                return pa.record_batch([pa.array([], pa.int64())] * 2, names=["a", "b"])
            own = np.concatenate(rids)
            # The lowest byte of each value: equal values stay equal, so no pair is lost by it.
            i, j = surviving(np.concatenate(values), np.concatenate(left), np.concatenate(right), needed)
            ids, place = np.unique(own, return_inverse=True)
            root = linked_roots(len(ids), place[i], place[j])
            tied = np.flatnonzero(root != np.arange(len(ids)))
            rids, values, left, right, rows, pairs = [], [], [], [], 0, 0
            return pa.record_batch([pa.array(ids[tied]), pa.array(ids[root[tied]])], names=["a", "b"])

        for (_, i, j), table in sorted_groups(batches, ["bucket", "i", "j"]):
            signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint32).reshape(table.num_rows, -1)
            own = table["own"].to_numpy()
            at = np.arange(rows, rows + table.num_rows)
            a, b = _pairs(at[own == i], at[own == j], i == j)
            rids.append(table["rid"].to_numpy())
            values.append(signatures.astype(np.uint8))
            left.append(a)
            right.append(b)
            rows, pairs = rows + table.num_rows, pairs + len(a)
            if pairs > PAIRS_AT_ONCE:
                yield flush()
        yield flush()

    return blocks.select("bucket", "i", "j", "own", "rid", "signature").mapInArrow(compared, "a long, b long")


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over a few columns at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    row, column = row[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for low in range(0, int(common.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        ones = np.zeros((len(sets), min(4096, int(common.sum()) - low)), dtype=np.float32)
        ones[row[a:b], column[a:b] - low] = 1
        out += ones @ ones.T
    return out.astype(np.int64)


def _verified(texts: DataFrame, sets: DataFrame, clusters: DataFrame, how: Similarity) -> DataFrame:
    """(``rid``, ``links``, ``root``) from each task that compares a row with others."""
    sized = sets.select("rid", "id", "t1", "t2", "copies", "chars").join(clusters, sets["rid"] == clusters["node"]).drop("node")
    totals = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    sized = sized.join(totals, "root")
    # Ids spread a hot text; equal rows come once.
    found = texts.join(sized, texts["id"].eqNullSafe(sized["id"]) & (texts["t1"] == sized["t1"]) & (texts["t2"] == sized["t2"]))
    found = found.select("root", "n", "all_chars", "rid", "copies", "text").dropDuplicates(["rid"])
    blocks = _in_blocks(found, "root", how.block_rows, bytes_column="all_chars", block_bytes=how.block_bytes)
    needed, limit = how.needed(), Fraction(how.threshold).limit_denominator(10_000)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(how)
        for (_, i, j), table in sorted_groups(batches, ["root", "i", "j"]):
            own, copies, rid = (table[c].to_numpy() for c in ("own", "copies", "rid"))
            sets = [shingler.shingles(t) for t in table["text"].to_pylist()]
            values = np.array([shingler.signature(s) for s in sets])
            at = np.arange(len(sets))
            a, b = surviving(values, *_pairs(at[own == i], at[own == j], i == j), needed)
            if len(a):
                shared, size = _shared_counts(sets)[a, b], np.array([len(s) for s in sets])
                # shared / (size + size - shared) >= p / q, in whole numbers
                linked = shared * (limit.numerator + limit.denominator) >= limit.numerator * (size[a] + size[b])
                a, b = a[linked], b[linked]
            links = np.bincount(a, copies[b], len(sets)) + np.bincount(b, copies[a], len(sets))
            root = linked_roots(len(sets), a, b)
            yield pa.record_batch([pa.array(rid), pa.array(links.astype(np.int64)), pa.array(rid[root])], names=["rid", "links", "root"])

    return blocks.select("root", "i", "j", "own", "rid", "copies", "text").mapInArrow(compared, "rid long, links long, root long")


def one_of_each(docs: DataFrame, how: Similarity = Similarity(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without near copies: of each class the row with the least id stays.

    Equal ids with different texts are kept apart by the text; equal rows are one.
    """
    found = similar_documents(docs.select(F.struct(F.col(id_column), F.xxhash64(text_column), F.xxhash64(F.lit(1), F.col(text_column))).alias("_id"), F.col(text_column).alias("_text")), how, "_id", "_text")
    keep = found.where("_id = class_id").select("_id").distinct()
    marked = docs.withColumn("_id", F.struct(F.col(id_column), F.xxhash64(text_column), F.xxhash64(F.lit(1), F.col(text_column))))
    first = marked.join(keep, "_id", "left_semi")
    return first.dropDuplicates(["_id"]).select(*docs.columns)
