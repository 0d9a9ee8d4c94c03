"""Ordinal regression of graded ratings on hashed text.

A cumulative-link model: all grades share one vector of weights over hashed
features, and ordered thresholds cut its score. P(grade > k) = s(w.x - t_k).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality_rules import CLASSES, class_counts

STRIP = ".,;:!?\"'()[]"
KNOWN_WORDS = 200_000
PREFIXES = (3, 4, 5, 6, 7)
MARKS = re.compile(r"[^\w\s]+$")


@dataclass(frozen=True)
class Fit:
    """Settings; ``rows`` bounds the labelled rows that are used for fitting."""

    rows: int = 10_000
    buckets: int = 2**18
    least_texts: int = 4
    least_deviation: float = 5.0
    penalty: float = 1e-5
    steps: int = 600
    rate: float = 0.2


@dataclass(frozen=True)
class Model:
    """Shared weights, ordered thresholds, and the tail probability from which a document is kept."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _bucket(share: float) -> int:
    return int(min(9, share * 10))


class Hasher:
    """Buckets of a text's features: its distinct words and their beginnings, endings of marks, and coarse shares."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def _at(self, word: str) -> int:
        return xxhash.xxh64_intdigest(word) % self.buckets

    def features(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        out = set()
        for w in set(words):
            at = known.get(w)
            if at is None:
                end = MARKS.search(w)
                plain = w.lower().strip(STRIP)
                starts = (self._at(f"p {plain[:n]}") for n in PREFIXES if n < len(plain))
                at = known[w] = (self._at("w " + plain), self._at("m " + end[0][-3:] if end else "m"), *starts)
            out.update(at)
        lines = [x for x in text.split("\n") if x.strip()]
        letters = class_counts(text)[CLASSES.index("upper")]
        shares = {
            "upper": letters / max(1, len(text)),
            "repeated lines": 1 - len(set(lines)) / max(1, len(lines)),
            "distinct words": len(set(words)) / max(1, len(words)),
            "marks": sum(text.count(c) for c in "#*$%&|<>!") / max(1, len(words)),
            "length": np.log2(1 + len(words)) / 20,
        }
        out.update(self._at(f"s {name} {_bucket(x)}") for name, x in shares.items())
        return np.array(sorted(out), dtype=np.int64)


def fit(features: list[np.ndarray], grades: np.ndarray, how: Fit = Fit()) -> Model:
    """Maximum likelihood with a penalty on weights, by Adam over all rows.

    Buckets of fewer than ``least_texts`` rows keep the weight 0, as do those whose
    rows' mean grade lies within ``least_deviation`` standard errors of the mean of
    all. Thresholds stay ordered, as each is the one before plus the exponential of
    a parameter.
    """
    levels = int(grades.max()) if len(grades) else 0
    weights = np.zeros(how.buckets)
    if len(np.unique(grades)) < 2:
        return Model(weights, np.zeros(0))
    times, sums = np.zeros(how.buckets), np.zeros(how.buckets)
    for f, g in zip(features, grades, strict=True):
        times[f] += 1
        sums[f] += g
    seen = np.maximum(times, 1)
    chosen = (times >= how.least_texts) & (np.abs(sums / seen - grades.mean()) * np.sqrt(seen) >= how.least_deviation * max(float(grades.std()), 1e-9))
    used = np.flatnonzero(chosen)
    kept = [f[chosen[f]] for f in features]
    row = np.repeat(np.arange(len(kept)), [len(f) for f in kept])
    column = np.searchsorted(used, np.concatenate(kept))
    free = np.concatenate([np.zeros(len(used)), [0.0], np.zeros(levels - 1)])
    scale = 1 / np.sqrt(max(1.0, len(row) / max(1, len(features))))
    first, second = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, how.steps + 1):
        w, cuts = free[: len(used)], np.cumsum(np.concatenate([free[len(used) : len(used) + 1], np.exp(free[len(used) + 1 :])]))
        score = np.bincount(row, w[column], len(features)) * scale
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
        edges = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
        k = np.arange(len(score))
        likely = np.maximum(edges[k, grades] - edges[k, grades + 1], 1e-9)
        slopes = edges * (1 - edges)
        by_cut = np.zeros_like(above)
        inner = grades >= 1
        by_cut[k[inner], grades[inner] - 1] += slopes[k[inner], grades[inner]] / likely[inner]
        inner = grades < levels
        by_cut[k[inner], grades[inner]] -= slopes[k[inner], grades[inner] + 1] / likely[inner]
        by_score = by_cut.sum(axis=1)
        to_cuts = by_cut.mean(axis=0)
        later = np.cumsum(to_cuts[::-1])[::-1]
        gradient = np.concatenate([
            -np.bincount(column, by_score[row], len(used)) * scale / len(features) + how.penalty * w,
            later[:1],
            later[1:] * np.exp(free[len(used) + 1 :]),
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        free = free - how.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[used] = free[: len(used)] * scale
    model = Model(weights, np.cumsum(np.concatenate([free[len(used) : len(used) + 1], np.exp(free[len(used) + 1 :])])))
    tail = model.above(np.array([weights[f].sum() for f in features]))[:, -1]
    return replace(model, cut=selection_cut(tail, grades == levels))


def selection_cut(tail: np.ndarray, best: np.ndarray) -> float:
    """The cut that keeps most of the best grade and rejects most others, keeping counting twice.

    Where no cut rejects more than it loses, nothing is rejected.
    """
    cuts = np.arange(0.0, 1.0, 0.05)
    gains = [2 * (tail[best] >= c).mean() + (tail[~best] < c).mean() for c in cuts]
    return float(cuts[int(np.argmax(gains))])


def rating(quality: str = "quality", toxic: str = "toxic"):
    """Grades of the label table: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2)


def graded_sample(docs: DataFrame, labels: DataFrame, how: Fit, id_column: str, text_column: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``how.rows`` labelled rows, those with the least hashes of their ids."""
    picked = labels.where(F.col(id_column).isNotNull() & F.col("grade").isNotNull()).select(F.col(id_column).alias("id"), F.col("grade").cast("int").alias("grade"))
    # Of several rows of an id the least counts, so that reruns learn the same model.
    picked = picked.groupBy("id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(how.rows)
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(how.buckets)
        for batch in batches:
            made = [hasher.features(t).astype(np.int32).tobytes() for t in batch["text"].to_pylist()]
            yield pa.record_batch([batch["id"], batch["grade"], pa.array(made, pa.binary())], names=["id", "grade", "features"])

    kind = texts.schema["id"].dataType.simpleString()
    # A sample of fixed size, so it may be broadcast.
    made = texts.join(F.broadcast(picked), "id").select("id", "grade", "text").mapInArrow(hashed, f"id {kind}, grade int, features binary")
    rows = made.groupBy("id").agg(F.min(F.struct("features", "grade")).alias("least")).select("id", "least.*").orderBy("id").collect()
    return [np.frombuffer(r.features, dtype=np.int32) for r in rows], np.array([r.grade for r in rows], dtype=np.int64)


def grade(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), least: float | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Expected grade and tail probability of every document.

    ``labels`` has the id and ``grade`` (0, 1, ..., higher is better; nulls are
    left out). Returns one row per input row: id, ``expected_grade``, ``tail``
    (probability of the highest grade) and ``kept`` (tail of at least ``least``, by
    default the cut that served the labelled rows best).
    Null and empty texts are graded by their length alone. Without labels of two
    grades there is nothing to learn: expected grade null, tail null, kept true.
    Of several texts or grades of one id the least features and the lowest grade are
    learnt from. Equal rows get equal grades; an empty table gives no rows.
    """
    model = fit(*graded_sample(docs, labels, how, id_column, text_column), how)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the buckets
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hasher = shared.value, Hasher(how.buckets)
        cut = known.cut if least is None else least
        for batch in batches:
            score = np.array([known.weights[hasher.features(t)].sum() for t in batch["text"].to_pylist()])
            if len(known.thresholds):
                above = known.above(score)
                columns = [pa.array(above.sum(axis=1)), pa.array(above[:, -1]), pa.array(above[:, -1] >= cut)]
            else:
                columns = [pa.nulls(len(score), pa.float64()), pa.nulls(len(score), pa.float64()), pa.array([True] * len(score), pa.bool_())]
            yield pa.record_batch([batch["id"], *columns], names=["id", "expected_grade", "tail", "kept"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(graded, f"id {kind}, expected_grade double, tail double, kept boolean").withColumnRenamed("id", id_column)
