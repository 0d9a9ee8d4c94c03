"""Remove every byte that a string of given length covers which starts elsewhere too.

A merge sort of suffixes, distributed and aware of common prefixes. Suffixes are
taken at content-defined places only: of all 64-byte grams in a window the one with
the least hash is its anchor, so equal windows hang on equal anchors at equal
distances, and one suffix per anchor stands for all windows around it.

1. Anchors are counted by hash; those that occur once have no equal window.
2. Each task sorts the suffixes at its other anchors and sends them as front-coded
   runs (length of the prefix shared with the suffix before, and the rest) to
   ranges of the order.
3. A loser tree merges the runs of a range. Every contender knows the prefix that
   it shares with the last winner; only bytes beyond it are ever compared. The
   shared lengths of the merged order tell which suffixes agree for how long to the
   right; a sort of the bytes to the left tells the same there. Windows with equal
   classes on both sides are equal strings.

Anchors of very frequent strings would fill one range. Their windows are equal or not
as a whole, so they are told apart by 128-bit hashes, combined per task, and dealt by
those.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import partitions, saved, sorted_groups

GRAM = 64
# Records of a run; windows held at once; occurrences from which an anchor's windows are dealt one by one.
RUN_RECORDS = 40_000
WINDOWS = 200_000
HOT = 5_000
RANGES_PER_TASK = 4
SALTED = 16


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the gram at each place, by doubling the hashed length."""
    h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    n = 1
    while n < GRAM:
        h = h[:-n] * np.uint64(0xD6E8FEB86659FD93) + (h[n:] ^ (h[n:] >> np.uint64(31)))
        n *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, nearest, farthest): anchors and the range of distances of their windows' starts."""
    if len(data) < length:
        return (np.zeros(0, dtype=np.uint64), *[np.zeros(0, dtype=np.int64)] * 3)
    least = gram_hashes(data)
    at = np.arange(len(least), dtype=np.int32)
    width, n = length - GRAM + 1, 1
    hashes = least

    def combine(shift: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        left = least[:size] <= least[shift : shift + size]  # the leftmost of equals
        return np.where(left, least[:size], least[shift : shift + size]), np.where(left, at[:size], at[shift : shift + size])

    while n * 2 <= width:
        least, at = combine(n, len(least) - n)
        n *= 2
    if n < width:
        least, at = combine(width - n, len(least) - (width - n))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    place = at[first].astype(np.int64)
    return hashes[place], place, place - last, place - first


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), dtype=np.uint8).reshape(len(strings), width)


def neighbour_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix that each string shares with the one before it (0 for the first)."""
    out = np.zeros(len(strings), dtype=np.int32)
    if len(strings) < 2:
        return out
    lengths = np.array([len(s) for s in strings], dtype=np.int32)
    for low in range(1, len(strings), 20_000):
        part = _padded(strings[low - 1 : low + 20_000], max(1, int(lengths.max())))
        differ = part[1:] != part[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), part.shape[1])
        out[low : low + len(same)] = np.minimum(same, np.minimum(lengths[low : low + len(same)], lengths[low - 1 : low + len(same) - 1]))
    return out


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    shared = neighbour_prefixes(strings)
    rests = [s[k:] for s, k in zip(strings, shared.tolist(), strict=True)]
    return shared, np.array([len(r) for r in rests], dtype=np.int32), b"".join(rests)


def decoded_run(shared: np.ndarray, sizes: np.ndarray, rests: bytes) -> Iterator[tuple[bytes, int]]:
    """Strings of a run in order, each with the prefix shared with the one before."""
    last, at = b"", 0
    for k, n in zip(shared.tolist(), sizes.tolist(), strict=True):
        last = last[:k] + rests[at : at + n]
        at += n
        yield last, k


def _agree(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that ``known`` bytes agree."""
    end = min(len(a), len(b))
    while known < end and a[known : known + 32] == b[known : known + 32]:
        known += 32
    known = min(known, end)
    while known < end and a[known] == b[known]:
        known += 1
    return known


def merged(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """Merge sorted runs by a loser tree: (run, string, prefix shared with the string before).

    A contender carries the length that it shares with the last winner. Of two, the
    one that shares more is less; only if both share the same length are bytes
    compared, and only those beyond it. The loser then knows what it shares with
    the winner, so no known prefix is compared again.
    """
    count = 1
    while count < len(runs):
        count *= 2
    strings: list[bytes | None] = [None] * count
    shares = [0] * count
    for r, run in enumerate(runs):
        first = next(run, None)
        strings[r] = first[0] if first else None

    def beaten(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); what the loser shares is brought up to date."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        k = _agree(x, y, shares[a])
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            shares[b] = k
            return a, b
        shares[a] = k
        return b, a

    losers = [0] * count
    winners = [0] * count + list(range(count))
    for node in range(count - 1, 0, -1):
        winners[node], losers[node] = beaten(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if count > 1 else 0
    while strings[winner] is not None:
        yield winner, strings[winner], shares[winner]
        following = next(runs[winner], None)
        # A run's next string shares with the last winner what it shares with the one before it.
        strings[winner], shares[winner] = following if following else (None, 0)
        node = (winner + count) // 2
        while node:
            winner, losers[node] = beaten(winner, losers[node])
            node //= 2


class _Run:
    """Suffixes of one task, sorted and cut into front-coded pieces, one per range."""

    TAGS = (("t1", np.int64), ("t2", np.int64), ("place", np.int64), ("near", np.int32), ("far", np.int32), ("weight", np.int32))

    #: What a task sends: a run, or a range of bytes known to be repeated, or a window by its hash.
    SENT = {"range": pa.int32(), "run": pa.binary(), "t1": pa.int64(), "t2": pa.int64(), "low": pa.int64(), "high": pa.int64(), "w1": pa.int64(), "w2": pa.int64(), "weight": pa.int32()}

    def __init__(self, ranges: int):
        self.ranges, self.records = ranges, []
        self.windows: dict[bytes, tuple[int, int, int, int]] = {}
        self.again: list[tuple[int, int, int]] = []

    def add(self, key: int, right: bytes, left: bytes, *tags: int) -> None:
        """``left`` is read backwards; the key leads, so its top bits give the range."""
        self.records.append((key.to_bytes(8, "big") + right, left, tags))

    def add_window(self, window: bytes, t1: int, t2: int, start: int, weight: int) -> None:
        key = xxhash.xxh128_digest(window)
        first = self.windows.setdefault(key, (t1, t2, start, weight))
        if first[:3] != (t1, t2, start):
            self.again.append((t1, t2, start))
            if first[3] < 2:
                self.windows[key] = (*first[:3], 2)

    def flush_windows(self, length: int) -> pa.RecordBatch:
        """Each window once, with how often it came (two at most); where the others lie, in ranges."""
        rows = []
        for key, (t1, t2, start, weight) in self.windows.items():
            w1, w2 = int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)
            rows.append((w1 % self.ranges, None, t1, t2, start, start + length, w1, w2, weight))
        at = None
        for t1, t2, start in sorted(self.again):
            if at and at[:2] == (t1, t2) and start <= at[3]:
                at = (t1, t2, at[2], start + length)
                continue
            if at:
                rows.append(((at[0] ^ at[2]) % self.ranges, None, *at, None, None, None))
            at = (t1, t2, start, start + length)
        if at:
            rows.append(((at[0] ^ at[2]) % self.ranges, None, *at, None, None, None))
        self.windows, self.again = {}, []
        return self._rows(rows)

    def flush(self, length: int) -> pa.RecordBatch:
        self.records.sort(key=lambda r: (r[0], r[1], r[2][3:5]))
        out, decided = [], []
        kept: list[tuple] = []
        for record in self.records:
            # Equal surroundings of two places: both are repeated, and one of them is enough for the rest.
            if kept and kept[-1][0] == record[0] and kept[-1][1] == record[1] and kept[-1][2][3:5] == record[2][3:5]:
                last = kept[-1][2]
                if last[:3] != record[2][:3]:
                    kept[-1] = (*kept[-1][:2], (*last[:5], 2))
                t1, t2, place, near, far, _ = record[2]
                # Needs no range of the order, so these spread evenly.
                decided.append(((t1 ^ place) % self.ranges, t1, t2, place - far, place - near + length))
                continue
            kept.append(record)
        at = np.array([int.from_bytes(r[0][:4], "big") * self.ranges >> 32 for r in kept], dtype=np.int64)
        cuts = [*np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist(), len(at)] if len(at) else []
        for a, b in zip(cuts, cuts[1:]):
            out.append((int(at[a]), self._packed(kept[a:b])))
        self.records = []
        rows = [(r, x, None, None, None, None, None, None, None) for r, x in out] + [(d[0], None, *d[1:], None, None, None) for d in decided]
        return self._rows(rows)

    @staticmethod
    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_Run.SENT)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _Run.SENT.values(), strict=True)], names=list(_Run.SENT))

    def _packed(self, records: list[tuple]) -> bytes:
        shared, sizes, rests = front_coded([r[0] for r in records])
        left_shared, left_sizes, left_rests = front_coded([r[1] for r in records])
        head = np.array([len(records), len(rests), len(left_rests)], dtype=np.int64)
        tags = [np.array([r[2][k] for r in records], dtype=t).tobytes() for k, (_, t) in enumerate(self.TAGS)]
        small = [x.astype(np.uint16).tobytes() for x in (shared, sizes, left_shared, left_sizes)]
        return b"".join([head.tobytes(), *small, *tags, rests, left_rests])

    @classmethod
    def unpacked(cls, data: bytes) -> tuple[Iterator[tuple[bytes, int]], list[bytes], dict[str, np.ndarray]]:
        n, right, left = np.frombuffer(data, dtype=np.int64, count=3).tolist()
        at, small, tags = 24, [], {}
        for _ in range(4):
            small.append(np.frombuffer(data, dtype=np.uint16, count=n, offset=at))
            at += 2 * n
        for name, kind in cls.TAGS:
            tags[name] = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += n * np.dtype(kind).itemsize
        lefts = [s for s, _ in decoded_run(small[2], small[3], data[at + right : at + right + left])]
        return decoded_run(small[0], small[1], data[at : at + right]), lefts, tags


def _repeated(strings: np.ndarray, lefts: list[bytes], tags: dict[str, np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(record, low, high) byte ranges covered by repeated windows. ``strings``: shared lengths in merged order, with the 8 key bytes."""
    n = len(strings)
    order = sorted(range(n), key=lefts.__getitem__)
    left_shared = neighbour_prefixes([lefts[k] for k in order])
    place_in_left = np.empty(n, dtype=np.int64)
    place_in_left[order] = np.arange(n)
    near, far, weight = tags["near"], tags["far"], tags["weight"]
    for d in range(int(near.min()), int(far.max()) + 1):
        live = np.flatnonzero((near <= d) & (far >= d))
        if not len(live):
            continue
        # Numbers of the stretches that agree for long enough on each side.
        right_class = np.cumsum(strings < 8 + length - d)[live]
        left_class = np.cumsum(left_shared < 8 + d)[place_in_left[live]]
        _, inverse = np.unique(right_class * (n + 1) + left_class, return_inverse=True)
        hit = live[np.bincount(inverse, weight[live])[inverse] >= 2]
        if len(hit):
            yield hit, tags["place"][hit] - d, tags["place"][hit] - d + length


def _merged_ranges(covers: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(covers)
    if not parts:
        return (np.zeros(0, dtype=np.int64),) * 3
    record, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((low, record))
    record, low, high = record[order], low[order], high[order]
    # All windows are equally long, so ends ascend with starts.
    fresh = np.concatenate([[True], (record[1:] != record[:-1]) | (low[1:] > high[:-1])])
    first = np.flatnonzero(fresh)
    return record[first], low[first], high[np.concatenate([first[1:] - 1, [len(high) - 1]])]


def remove_repeated(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """Remove from every text all bytes in strings of ``length`` bytes that also start elsewhere.

    Texts are bytes in UTF-8, a null text is empty; strings do not cross texts, may
    lie in the same text, and are judged on the input. Returns one row per input
    row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs),
    ``kept_sha256`` and, if ``with_text``, ``spans`` (array of low, high) and
    ``kept`` (binary, as a cut may fall inside a character). Equal texts of at least
    ``length`` bytes go whole, in every row that has them. Ids may be null or
    repeated; columns other than id and text are not read. An empty table gives no
    rows.
    """
    if length <= GRAM or length > 255 + GRAM:
        raise ValueError(f"the length must lie between {GRAM + 1} and {255 + GRAM}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.cast("binary").alias("data"))
    long_texts = texts.where(F.octet_length("data") >= length)
    # Texts with so many copies that one task would feel it are dealt by id as well; by
    # their share of all rows there are at most SALTED times as many as tasks.
    many = max(SALTED, math.ceil(docs.count() / (SALTED * partitions(spark))))
    times = saved(long_texts.groupBy("t1", "t2").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    salted = times.groupBy("t1").agg(F.sum("n").alias("n")).where(F.col("n") > many).select("t1", F.ceil(F.col("n") / many).cast("int").alias("salts"))
    salted = F.broadcast(salted)
    texts = texts.join(salted, "t1", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"), F.lit(0))).drop("salts")

    def for_each_salt(df: DataFrame) -> DataFrame:
        """The rows, by ``k1`` and ``k2``, for every part that the copies of a text are dealt to."""
        df = df.join(salted, "t1", "left").withColumn("k2", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
        return df.drop("salts").withColumnRenamed("t1", "k1")


    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1 = batch["t1"].to_numpy()
            # Copies within a batch count as two at most.
            unique, first, copies = np.unique(np.stack([t1, batch["t2"].to_numpy()]), axis=1, return_index=True, return_counts=True)
            hashes, keys, packed, times = [], [], [], []
            for k, n in zip(first, copies, strict=True):
                h, place, near, far = anchors(np.frombuffer(batch["data"][int(k)].as_buffer(), dtype=np.uint8), length)
                hashes.append(h)
                keys.append(np.full(len(h), t1[k]))
                packed.append((place << 16) | (near << 8) | far)
                times.append(np.full(len(h), min(int(n), 2), dtype=np.int8))
            if hashes:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in ([h.view(np.int64) for h in hashes], keys, packed, times)], names=["h", "t1", "packed", "n"])

    found = saved(long_texts.select("t1", "t2", "data").mapInArrow(anchored, "h long, t1 long, packed long, n byte"), "anchors")
    # Saved, so that the join deals both sides anew and may split a hot hash.
    again = saved(found.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h", (F.col("n") > HOT).alias("hot")), "again")
    # As many as a text has anchors.
    hints = found.select("h", "t1", "packed").join(again, "h").groupBy("t1").agg(F.collect_set(F.struct("packed", "hot")).alias("hints"))
    copies = times.groupBy("t1").agg(F.collect_list("t2").alias("copied"))
    hints = for_each_salt(hints.join(copies, "t1", "left"))
    ranges = RANGES_PER_TASK * partitions(spark)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seen = _Run(ranges), set()
        for batch in batches:
            for t1, t2, data, marks, copied in zip(*(batch[c].to_pylist() for c in ("t1", "t2", "data", "hints", "copied")), strict=True):
                if (t1, t2) in seen:
                    continue
                weight = 1 + (t2 in (copied or ()))
                if weight > 1:  # only those come again
                    seen.add((t1, t2))
                for mark in marks:
                    place, near, far = mark["packed"] >> 16, (mark["packed"] >> 8) & 255, mark["packed"] & 255
                    if place - far < 0 or place - near + length > len(data):
                        continue  # of another text with an equal first key
                    gram = xxhash.xxh64_intdigest(data[place : place + GRAM])
                    if not mark["hot"]:
                        run.add(gram, data[place : place - near + length], data[place - far : place][::-1], t1, t2, place, near, far, weight)
                        continue
                    for d in range(near, far + 1):
                        run.add_window(data[place - d : place - d + length], t1, t2, place - d, weight)
                if len(run.records) >= RUN_RECORDS:
                    yield run.flush(length)
                if len(run.windows) + len(run.again) >= WINDOWS:
                    yield run.flush_windows(length)
        yield run.flush(length)
        yield run.flush_windows(length)

    # The same columns and key as in the last join, so the texts are shuffled once for both.
    runs = texts.join(hints, (texts["t1"] == hints["k1"]) & (texts["salt"] == hints["k2"])).select("id", "t1", "t2", "data", "hints", "copied")
    runs = runs.mapInArrow(sent, "range int, run binary, t1 long, t2 long, low long, high long, w1 long, w2 long, weight int")
    runs = runs.repartition(partitions(spark), "range").sortWithinPartitions("range")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t1", "t2", "low", "high"]
        for _, table in sorted_groups(batches, ["range"]):
            done = table.filter(pc.and_(table["run"].is_null(), table["w1"].is_null())).select(names)
            yield from done.to_batches()
            windows = table.filter(table["w1"].is_valid())
            if windows.num_rows:
                _, inverse = np.unique(np.stack([windows["w1"].to_numpy(), windows["w2"].to_numpy()]), axis=1, return_inverse=True)
                inverse = inverse.ravel()
                times = np.bincount(inverse, windows["weight"].to_numpy())[inverse]
                yield from windows.filter(pa.array(times >= 2)).select(names).to_batches()
            parts = [_Run.unpacked(x) for x in table["run"].to_pylist() if x is not None]
            if not parts:
                continue
            taken = [0] * len(parts)
            starts = np.cumsum([0, *(len(p[1]) for p in parts)]).tolist()
            shared, picked, keys = [], [], []
            for r, string, k in merged([p[0] for p in parts]):
                shared.append(k)
                picked.append(starts[r] + taken[r])
                keys.append(string[:8])
                taken[r] += 1
            all_lefts = [left for p in parts for left in p[1]]
            lefts = [key + all_lefts[k] for key, k in zip(keys, picked, strict=True)]
            tags = {name: np.concatenate([p[2][name] for p in parts])[picked] for name, _ in _Run.TAGS}
            record, low, high = _merged_ranges(_repeated(np.array(shared), lefts, tags, length))
            yield pa.record_batch([pa.array(tags["t1"][record]), pa.array(tags["t2"][record]), pa.array(low), pa.array(high)], names=names)

    covers = runs.mapInArrow(matched, "t1 long, t2 long, low long, high long")
    # Bounded by the text's own length.
    covers = for_each_salt(covers.groupBy("t1").agg(F.collect_set(F.struct("t2", "low", "high")).alias("covers")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t2, data, marks in zip(*(batch[c].to_pylist() for c in ("t2", "data", "covers")), strict=True):
                spans: list[list[int]] = []
                for low, high in sorted((m["low"], m["high"]) for m in marks or () if m["t2"] == t2):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                ends = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join([data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]) if spans else data
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept))
            n_bytes, removed, count, digest, spans, kept = zip(*rows, strict=True) if rows else ((),) * 6
            columns = [batch["id"], pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                kind = pa.struct([("low", pa.int64()), ("high", pa.int64())])
                columns += [pa.array([[{"low": a, "high": b} for a, b in s] for s in spans], pa.list_(kind)), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(columns)])

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<low: long, high: long>>, kept binary" * with_text
    out = texts.join(covers, (texts["t1"] == covers["k1"]) & (texts["salt"] == covers["k2"]), "left").select("id", "t1", "t2", "data", "covers").mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_column)
