"""Chroma audio fingerprints, and the alignment of recordings by them.

Frames of a recording become the energy of the twelve pitch classes. Filters on
this picture, taken from an integral image, are quantised to two bits each and
packed into one 32-bit integer per frame. Two recordings are aligned by the offset
at which most pairs of bytes of their integers agree, and compared by the bits that
differ there.
"""

from __future__ import annotations

import io
import itertools
import math
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, saved, sorted_groups

RATE = 8_000
FRAME, HOP = 2_048, 512
LOW_HZ, HIGH_HZ = 60.0, 3_000.0
WIDTH = 16
SAMPLES_AT_ONCE = 2_000_000
VOTES_AT_ONCE = 4_000_000
# Fixed values, as public chroma fingerprints use them. Filters: kind, first pitch class, pitch classes, frames. Kinds: 0 the whole against
# nothing, 1 upper against lower half, 2 left against right half, 3 checkered,
# 4 middle third against outer ones by class, 5 the same by frame.
FILTERS = (
    (0, 4, 3, 15), (4, 4, 6, 15), (1, 0, 4, 16), (3, 8, 2, 12), (3, 4, 4, 8), (4, 0, 3, 5), (1, 2, 2, 9), (2, 7, 3, 4),
    (2, 6, 2, 16), (2, 1, 3, 2), (5, 10, 1, 15), (3, 6, 2, 10), (2, 1, 1, 14), (3, 5, 6, 4), (1, 9, 2, 12), (3, 4, 2, 14),
)
STEPS = (-0.12, 0.0, 0.12)


@dataclass(frozen=True)
class Alignment:
    """Least agreeing pairs of bytes to try an offset, least overlap, greatest share of differing bits.

    An integer has six pairs of its four bytes. With errors spread evenly over the
    bits, which spares the fewest pairs, a pair is whole with ``(1 - errors) ** 16``;
    an offset is tried at ``share`` of the pairs that are then expected, and at
    ``votes`` of them at least.
    """

    votes: int = 2
    share: float = 0.3
    overlap: int = 16
    errors: float = 0.15
    block_queries: int = 256
    block_rows: int = 2_048


def _pitch_classes(rate: int) -> np.ndarray:
    """Matrix that sums the bins of a spectrum by pitch class (A is 0)."""
    hertz = np.arange(FRAME // 2 + 1) * rate / FRAME
    out = np.zeros((len(hertz), 12))
    inside = np.flatnonzero((hertz >= LOW_HZ) & (hertz <= HIGH_HZ))
    out[inside, np.round(12 * np.log2(hertz[inside] / 440.0)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch classes, each frame of length 1 (0 if silent)."""
    window, classes, parts = np.hanning(FRAME), _pitch_classes(rate), []
    frames = max(0, 1 + (len(samples) - FRAME) // HOP)
    step = max(1, SAMPLES_AT_ONCE // FRAME)
    for low in range(0, frames, step):
        at = (np.arange(low, min(frames, low + step)) * HOP)[:, None] + np.arange(FRAME)
        energy = np.abs(np.fft.rfft(samples[at] * window, axis=1)) ** 2 @ classes
        norm = np.linalg.norm(energy, axis=1, keepdims=True)
        parts.append(np.where(norm > 1e-6, energy / np.maximum(norm, 1e-6), 0.0))
    return np.concatenate(parts) if parts else np.zeros((0, 12))


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One 32-bit integer for each place at which the widest filter fits; none for a short recording."""
    picture = chroma(np.asarray(samples, dtype=float), rate)
    places = len(picture) - WIDTH + 1
    if places < 1:
        return np.zeros(0, dtype=np.uint32)
    integral = np.zeros((len(picture) + 1, 13))
    integral[1:, 1:] = picture.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(places)

    def area(x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        """Sum over frames x0 to x1 and classes y0 to y1, from every place on."""
        return integral[at + x1, y1] - integral[at + x0, y1] - integral[at + x1, y0] + integral[at + x0, y0]

    out = np.zeros(places, dtype=np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, y, w, min(12, y + h))
        top = min(12, y + h)
        if kind == 0:
            part = np.zeros(places)
        elif kind == 1:
            part = area(0, y + h // 2, w, top)
        elif kind == 2:
            part = area(w // 2, y, w, top)
        elif kind == 3:
            part = area(w // 2, y, w, y + h // 2) + area(0, y + h // 2, w // 2, top)
        elif kind == 4:
            part = area(0, y + h // 3, w, y + h - h // 3)
        else:
            part = area(w // 3, y, w - w // 3, top)
        value = np.log1p(part) - np.log1p(whole - part) if kind else np.log1p(whole) - np.log1p(w * h / 4)
        level = np.searchsorted(STEPS, value)
        # Neighbouring levels differ in one bit.
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)
    return out


def decoded_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (channels averaged) and rate of a 16-bit WAV file."""
    with wave.open(io.BytesIO(data)) as file:
        if file.getsampwidth() != 2:
            raise ValueError("16-bit samples are needed")
        samples = np.frombuffer(file.readframes(file.getnframes()), dtype="<i2").reshape(-1, file.getnchannels())
        return samples.mean(axis=1) / 32768.0, file.getframerate()


def fingerprints(recordings: DataFrame, id_column: str, audio_column: str, decode: Callable = decoded_wav) -> DataFrame:
    """(id, ``fingerprint`` array of long) of every recording.

    ``decode`` turns a value of the audio column into samples and their rate. A null
    or too short recording has an empty fingerprint. Rows may repeat and ids may be
    null; other columns are not read.
    """
    rows = recordings.select(F.col(id_column).alias("id"), F.col(audio_column).alias("audio"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[] if x is None else fingerprint(*decode(x)).astype(np.int64).tolist() for x in batch["audio"].to_pylist()]
            yield pa.record_batch([batch["id"], pa.array(made, pa.list_(pa.int64()))], names=["id", "fingerprint"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(printed, f"id {kind}, fingerprint array<long>").withColumnRenamed("id", id_column)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) if hasattr(np, "bitwise_count") else np.array([bin(v).count("1") for v in x])


PAIRS = tuple(itertools.combinations((0, 8, 16, 24), 2))


def _pairs(prints: np.ndarray) -> np.ndarray:
    """The six pairs of bytes of each integer, told apart by their places in it."""
    low, high = (np.array(x, dtype=np.uint32) for x in zip(*PAIRS, strict=True))
    one, other = prints[:, None] >> low & np.uint32(255), prints[:, None] >> high & np.uint32(255)
    return ((one << np.uint32(8) | other).astype(np.int64) + (np.arange(len(PAIRS)) << 16)).ravel()


class _Queries:
    """A block of queries, the pairs of bytes of their integers in one sorted index."""

    def __init__(self, prints: list[np.ndarray]):
        self.prints = prints
        values, times = _pairs(np.concatenate(prints)), len(PAIRS)
        owner = np.repeat(np.repeat(np.arange(len(prints)), [len(p) for p in prints]), times)
        place = np.repeat(np.concatenate([np.arange(len(p)) for p in prints]), times)
        self.lengths = np.array([len(p) for p in prints])
        order = np.argsort(values, kind="stable")
        self.starts = np.searchsorted(values[order], np.arange((times << 16) + 1))
        self.owner, self.place = owner[order], place[order]
        self.span = 2 * max(map(len, prints), default=0) + 2

    def aligned(self, other: np.ndarray, how: Alignment) -> list[tuple[int, int, float, int]]:
        """(query, offset, share of differing bits, overlap) for every query that aligns."""
        seen = _pairs(other)
        low, times = self.starts[seen], self.starts[seen + 1] - self.starts[seen]
        if not times.sum():
            return []
        reach, parts, first = max(len(other), self.span), [], 0
        # A held note agrees with itself everywhere, so the votes are counted some at a time.
        upto = np.cumsum(times)
        while first < len(seen):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - times[first] + VOTES_AT_ONCE, side="right")))
            n = times[first:last]
            at = np.repeat(low[first:last] - np.cumsum(n) + n, n) + np.arange(n.sum())
            shift = np.repeat(np.arange(first, last) // len(PAIRS), n) - self.place[at]
            parts.append(np.unique(self.owner[at] * (4 * reach) + shift + 2 * reach, return_counts=True))
            first = last
        keys, votes = parts[0]
        if len(parts) > 1:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            votes = np.bincount(place, np.concatenate([v for _, v in parts])).astype(np.int64)
        owners, offsets = keys // (4 * reach), keys % (4 * reach) - 2 * reach
        overlaps = np.minimum(self.lengths[owners], len(other) - offsets) - np.maximum(0, -offsets)
        expected = len(PAIRS) * overlaps * (1 - how.errors) ** 16
        tried = (votes >= np.maximum(how.votes, how.share * expected)) & (overlaps >= np.minimum(how.overlap, np.minimum(self.lengths[owners], len(other))))
        best: dict[int, tuple] = {}
        for q, offset, n in zip(owners[tried].tolist(), offsets[tried].tolist(), votes[tried].tolist(), strict=True):
            own = self.prints[q]
            a, b = max(0, -offset), min(len(own), len(other) - offset)
            share = float(_popcount(own[a:b] ^ other[a + offset : b + offset]).sum()) / (32 * (b - a))
            if share <= how.errors and (q not in best or (share, -n, offset) < best[q][0]):
                best[q] = ((share, -n, offset), b - a)
        return [(q, key[2], key[0], overlap) for q, (key, overlap) in best.items()]


def search(prints: DataFrame, queries: DataFrame, id_column: str, how: Alignment = Alignment()) -> DataFrame:
    """Recordings that align with each query: a stated set of queries against all rows, in blocks.

    Both tables hold the id and ``fingerprint``. Returns (``query_id``, id,
    ``offset``, ``errors``, ``overlap``): the offset in frames at which the query
    begins in the recording. An offset is tried if enough pairs of bytes of the integers agree
    at it (see ``Alignment``); of several the one with least errors is reported. A recording that is a query
    aligns with itself. The overlap must reach ``overlap``, or the length of the shorter
    recording. Empty fingerprints align with nothing; repeated rows are
    reported as often as they come.
    """
    rows = prints.where(F.size("fingerprint") > 0).select(F.col(id_column).alias("id"), "fingerprint", F.lit(False).alias("query"))
    asked = queries.where(F.size("fingerprint") > 0).select(F.col(id_column).alias("id"), "fingerprint", F.lit(True).alias("query"))
    across = max(1, math.ceil(asked.count() / how.block_queries))
    down = max(1, math.ceil(rows.count() / how.block_rows))
    mark = F.xxhash64("id", "fingerprint", F.monotonically_increasing_id())
    # Every block of rows meets every block of queries in one task.
    rows = rows.withColumn("y", F.pmod(mark, F.lit(down))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    asked = asked.withColumn("x", F.pmod(mark, F.lit(across)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    both = rows.unionByName(asked).repartition(partitions(prints.sparkSession), "x", "y").sortWithinPartitions("x", "y", F.col("query").desc())

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in sorted_groups(batches, ["x", "y"]):
            is_query = table["query"].to_numpy(zero_copy_only=False)
            prints = [np.array(p, dtype=np.uint32) for p in table["fingerprint"].to_pylist()]
            n = int(is_query.sum())
            if not 0 < n < len(prints):
                continue
            block, found = _Queries(prints[:n]), []
            for k in range(n, len(prints)):
                found += [(q, k, offset, share, overlap) for q, offset, share, overlap in block.aligned(prints[k], how)]
            q, k, offset, share, overlap = zip(*found, strict=True) if found else ((),) * 5
            ids = table["id"].combine_chunks()
            yield pa.record_batch([ids.take(pa.array(q, pa.int64())), ids.take(pa.array(k, pa.int64())), pa.array(offset, pa.int64()), pa.array(share, pa.float64()), pa.array(overlap, pa.int64())], names=["query_id", "id", "offset", "errors", "overlap"])

    kind = rows.schema["id"].dataType.simpleString()
    found = both.select("x", "y", "query", "id", "fingerprint").mapInArrow(compared, f"query_id {kind}, id {kind}, offset long, errors double, overlap long")
    return found.withColumnRenamed("id", id_column)


def melody(values: list[float]) -> tuple[np.ndarray, int]:
    """A recording derived from a vector: each pair of numbers sets two notes of a sixteenth of a second."""
    numbers = np.nan_to_num(np.asarray([0.0 if v is None else v for v in values], dtype=float))
    ranks = np.clip(np.round(18 + 40 * numbers), 0, 36)
    time = np.arange(RATE // 16) / RATE
    notes = 110.0 * 2 ** (ranks / 12)
    second = np.roll(notes, 1)
    return (np.sin(2 * np.pi * notes[:, None] * time) + 0.5 * np.sin(2 * np.pi * second[:, None] * time)).ravel(), RATE


def saved_fingerprints(recordings: DataFrame, id_column: str, audio_column: str, decode: Callable = decoded_wav) -> DataFrame:
    """Fingerprints written once, as a search reads them several times."""
    return saved(fingerprints(recordings, id_column, audio_column, decode), "fingerprints")
