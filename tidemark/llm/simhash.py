"""Near copies by SimHash fingerprints, compared as vertical bit planes.

Fingerprints lie as 64 planes, one bit of many fingerprints in each word. A query
meets 64 fingerprints at once: plane by plane, the bits in which they differ from it
are added to bitwise counters (ones, twos, and a flag for more than three), and a
word of 64 is abandoned as soon as all of its fingerprints are beyond the radius.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, saved
from tidemark.llm.components import components
from tidemark.llm.near_duplicates import linked_roots

RADIUS = 3
BITS = 64
SEED = 42
ALL = np.uint64(2**64 - 1)
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Planes:
    """Words of a shingle; rows of a block of a large group; rows compared at once; planes between two looks."""

    shingle: int = 3
    block_rows: int = 1_024
    rows_at_once: int = 32_768
    meetings_at_once: int = 1 << 18
    look_every: int = 8
    #: Fingerprints that share a key by chance, on average, from which keys take more bits.
    by_chance: int = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority of the bits of all shingle hashes (XXH64); 0 without words."""
    # With a surrogate no text is valid UTF-8; Spark's strings hold none.
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER).split()
    if not words:
        return 0
    joined, size = memoryview(b" ".join(words)), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64), len(starts)
    for low in range(0, total, 16_384):
        some = [digest(joined[a:b], SEED) for a, b in zip(starts[low : low + 16_384], ends[size - 1 + low : size - 1 + low + 16_384].tolist())]
        ones += np.unpackbits(np.array(some, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 planes by words of 64 lanes: bit l of word w of plane b is bit b of value 64 w + l. The last word is padded with the last value."""
    words = -(-len(values) // 64)
    padded = np.concatenate([values, np.full(64 * words - len(values), values[-1], dtype=np.uint64)])
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").astype(np.uint64)


def within_radius(values: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray, look_every: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) of at most three differing bits, of the given meetings of a query with a word of lanes."""
    ones, twos, over = (np.zeros(len(query), dtype=np.uint64) for _ in range(3))
    for b in range(BITS):
        own = np.uint64(0) - ((values[query] >> np.uint64(b)) & np.uint64(1))
        differ = planes[b, word] ^ own
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if b % look_every == look_every - 1:
            live = over != ALL
            query, word, ones, twos, over = query[live], word[live], ones[live], twos[live], over[live]
            if not len(query):
                break
    lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    query, lane = query[at], 64 * word[at] + lane
    real = lane < len(values)
    return query[real], lane[real]


def near_rows(values: np.ndarray, first: np.ndarray, last: np.ndarray, how: Planes = Planes()) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius, each row compared with the rows ``first`` to ``last`` - 1."""
    planes = bit_planes(values)
    low, high = first // 64, -(-last // 64)
    times = np.where(last > first, high - low, 0)
    left, right, start = [], [], 0
    upto = np.cumsum(times)
    while start < len(values):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + how.meetings_at_once, side="right")))
        n = times[start:stop]
        query = np.repeat(np.arange(start, stop), n)
        word = np.repeat(low[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        i, j = within_radius(values, planes, query, word, how.look_every)
        left.append(i)
        right.append(j)
        start = stop
    return np.concatenate(left), np.concatenate(right)


def key_parts(rows: int, by_chance: int) -> list[list[tuple[int, int]]]:
    """Which bits make the keys: each a list of (shift, width).

    Of p parts of a fingerprint, three differing bits leave p - 3 equal, so two
    fingerprints within the radius share one of the keys made of p - 3 parts. More
    parts give more keys of more bits; the least number is taken at which few
    fingerprints share a key by chance.
    """
    for parts in range(RADIUS + 1, 12):
        cuts = [BITS * k // parts for k in range(parts + 1)]
        bounds = [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(parts)]
        keys = [list(chosen) for chosen in itertools.combinations(bounds, parts - RADIUS)]
        if rows <= by_chance << min(sum(w for _, w in key) for key in keys):
            break
    return keys


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 3) -> DataFrame:
    """(``id``, ``print`` as a signed long) of every row."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch["id"], pa.array(made.view(np.int64))], names=["id", "print"])

    return rows.mapInArrow(printed, f"id {rows.schema['id'].dataType.simpleString()}, print long")


def near_links(prints: DataFrame, how: Planes = Planes()) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints within the radius.

    ``prints`` holds distinct ``print``. They meet by the keys of ``key_parts``. A key
    with more than ``block_rows`` is dealt in blocks, each pair of blocks to one task.
    """
    keys = key_parts(prints.count(), how.by_chance)
    made = [F.xxhash64(F.lit(k), *[F.shiftrightunsigned("print", s).bitwiseAND(F.lit(2**w - 1)) for s, w in key]) for k, key in enumerate(keys)]
    keyed = saved(prints.select("print", F.explode(F.array(*made)).alias("key")), "keyed-prints")
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(counts, "key").withColumn("blocks", F.ceil(F.col("n") / how.block_rows).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("later"), "print")
    met = met.repartition(partitions(prints.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "later")

    def linked(groups: list[np.ndarray]) -> pa.RecordBatch:
        key, i, j, later, value = groups
        change = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        end = np.repeat(starts + sizes, sizes)
        # Within a block a row meets those after it; of two blocks the first meets the second.
        second = np.repeat(starts + sizes - np.add.reduceat(later.astype(np.int64), starts), sizes)
        at = np.arange(len(key))
        first = np.where(i == j, at + 1, np.where(later, end, second))
        a, b = near_rows(value.view(np.uint64), first, end, how)
        own, place = np.unique(value, return_inverse=True)
        root = linked_roots(len(own), place[a], place[b])
        tied = np.flatnonzero(root != np.arange(len(own)))
        return pa.record_batch([pa.array(own[tied]), pa.array(own[root[tied]])], names=["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch[c].to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "later", "print")])
            rows += batch.num_rows
            if rows < how.rows_at_once:
                continue
            columns = [np.concatenate(c) for c in zip(*held)]
            key, i, j = columns[:3]
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero((key != key[-1]) | (i != i[-1]) | (j != j[-1]))[-1:].max(initial=-1)) + 1
            if cut:
                yield linked([c[:cut] for c in columns])
            held, rows = [[c[cut:] for c in columns]], len(key) - cut
        if rows:
            yield linked([np.concatenate(c) for c in zip(*held)])

    return met.mapInArrow(compared, "a long, b long")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", how: Planes = Planes()) -> DataFrame:
    """Fingerprint and component of every document.

    Words are runs of anything but ASCII white space after lower-casing A to Z; all
    shingles count, repeats included. A text of fewer words than a shingle is one
    shingle. A null or wordless text has fingerprint zero and is linked like any
    other. Documents whose fingerprints differ in at most three bits are linked.

    Returns id, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least
    id of all documents that links connect; nulls are no least id unless all ids of a
    component are null. Repeated rows come as often as they do. Columns other than id
    and text are not read. An empty table gives no rows.
    """
    printed = saved(fingerprints(docs, id_column, text_column, how.shingle), "prints")
    distinct = saved(printed.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    roots = components(near_links(distinct.select("print"), how))
    marked = saved(distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")), "marked-prints")
    least = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    # Saved, so that the join may split a fingerprint that very many documents share.
    marked = saved(marked.join(least, "root").select("print", "component_id"), "components")
    out = printed.join(marked, "print")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
