"""Whitening of embeddings by the eigenvectors of their covariance.

Spark sums the covariance. Its eigenvectors come from spectral divide and conquer:
the polar factor of the shifted matrix, found by the dynamically weighted Halley
iteration (QDWH), gives projectors on the two spaces spanned by eigenvectors above
and below the shift; each space is split again until single components are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = float(np.finfo(float).eps)
SCALE, OFFSET = 64, 1_000_000
# Whole numbers below it are exact as doubles.
GREATEST = 2.0**52
ROWS_AT_ONCE = 8_192


@dataclass(frozen=True)
class Whitening:
    """What all rows share: number, sums, and the kept components (columns) with their eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = math.nan


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal factor of the polar decomposition of a symmetric matrix: its matrix sign."""
    size = len(a)
    x = a / np.linalg.norm(a)
    low, eye = _least_bound(x), np.eye(size)
    for _ in range(60):
        squared = low * low
        d = (4 * (1 - squared) / squared**2) ** (1 / 3) if squared < 1 else 0.0
        root = math.sqrt(1 + d)
        wa = root + 0.5 * math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - squared) / (squared * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([math.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / math.sqrt(wc) * q[:size] @ q[size:].T
        else:
            lower = np.linalg.cholesky(eye + wc * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * squared) / (1 + wc * squared))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= (10 * EPS) ** (1 / 3) and abs(1 - low) < 10 * EPS:
            break
    return x


def _least_bound(x: np.ndarray) -> float:
    """A lower bound of the least singular value, at least the rounding error."""
    triangle = np.linalg.qr(x, mode="r")
    if np.abs(np.diag(triangle)).min() < EPS:
        return EPS
    return max(EPS, 1.0 / (math.sqrt(len(x)) * np.linalg.norm(np.linalg.inv(triangle), 1)))


def _range_of(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal basis, first of the projector's range and then of the rest."""
    size = len(projector)
    start = projector @ rng.standard_normal((size, rank))
    for _ in range(2):
        start = projector @ np.linalg.qr(start)[0]
    first = np.linalg.qr(start)[0]
    rest = rng.standard_normal((size, size - rank))
    for _ in range(3):
        rest = np.linalg.qr(rest - first @ (first.T @ rest))[0]
    return np.hstack([first, rest])


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, by spectral divide and conquer."""
    a = (a + a.T) / 2
    size = len(a)
    norm = float(np.linalg.norm(a))
    values, vectors = np.zeros(size), np.eye(size)
    if norm == 0:
        return values, vectors
    rng, filled, stack = np.random.Generator(np.random.PCG64(3)), 0, [(a, np.eye(size))]
    while stack:
        part, basis = stack.pop()
        m = len(part)
        off = np.linalg.norm(part - np.diag(np.diag(part)))
        if m == 1 or off <= EPS * norm / 8:
            # Within rounding, the axes of this space are eigenvectors.
            values[filled : filled + m], vectors[:, filled : filled + m] = np.diag(part), basis
            filled += m
            continue
        if m == 2:
            angle = 0.5 * math.atan2(2 * part[0, 1], part[0, 0] - part[1, 1])
            turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
        else:
            turn = None
            centre, spread = float(np.trace(part)) / m, float(np.sqrt(max(0.0, np.linalg.norm(part - np.eye(m) * np.trace(part) / m) ** 2 / m)))
            for shift in (float(np.median(np.diag(part))), centre, centre + spread / 2, centre - spread / 2, centre + spread / 4, centre - spread / 4):
                sign = polar_factor(part - shift * np.eye(m))
                projector = (np.eye(m) + sign) / 2
                rank = int(round(float(np.trace(projector))))
                if not 0 < rank < m:
                    continue
                candidate = _range_of(projector, rank, rng)
                turned = candidate.T @ part @ candidate
                if np.linalg.norm(turned[:rank, rank:]) <= 100 * m * EPS * norm:
                    turn = candidate
                    break
            if turn is None:
                # Eigenvalues that no shift tells apart are equal within rounding.
                values[filled : filled + m], vectors[:, filled : filled + m] = np.diag(part), basis
                filled += m
                continue
        rank = 1 if m == 2 else rank
        turned = turn.T @ part @ turn
        turned = (turned + turned.T) / 2
        stack.append((turned[rank:, rank:], basis @ turn[:, rank:]))
        stack.append((turned[:rank, :rank], basis @ turn[:, :rank]))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the vectors without null or non-finite entries, where each begins, and its length; entries flat."""
    column = batch["vector"]
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * flat) + OFFSET
    odd = np.concatenate([[0], np.cumsum(~(np.abs(x) < GREATEST))])
    ends = np.cumsum(np.maximum(lengths, 0))
    starts = ends - np.maximum(lengths, 0)
    rows = np.flatnonzero((lengths > 0) & (odd[ends] == odd[starts]))
    return rows, np.stack([starts, lengths]), x


def _matrices(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch the numbers of the usable rows of this length, and their vectors as whole numbers."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_AT_ONCE):
            some = batch.slice(low, ROWS_AT_ONCE)
            rows, (starts, lengths), x = _lists(some)
            rows = rows[lengths[rows] == length]
            if len(rows):
                yield some, rows, x[starts[rows][:, None] + np.arange(length)].astype(np.int64)


def _summed(vectors: DataFrame, length: int, turn) -> np.ndarray:
    """Sum over all usable vectors of the array that ``turn`` makes of a matrix of them, added per task and then by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, x in _matrices(batches, length):
            made = turn(x)
            total = made if total is None else total + made
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel().astype(np.float64))], names=["at", "value"])

    rows = vectors.mapInArrow(partial, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    return np.array([r["value"] for r in rows])


def fit(vectors: DataFrame, keep: int = 32) -> Whitening | None:
    """Sums, covariance and components of a table with an array column ``vector``; None without usable vectors.

    The driver holds one matrix of the vectors' length squared, whatever the number of
    rows. Vectors whose length is not the most frequent one (of equally frequent: the
    longest) are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            rows, (starts, lengths), x = _lists(batch)
            for length in np.unique(lengths[rows]).tolist():
                own = rows[lengths[rows] == length]
                entry = totals.setdefault(length, [0, np.zeros(length, dtype=np.int64)])
                entry[0] += len(own)
                for low in range(0, len(own), ROWS_AT_ONCE):
                    entry[1] += x[starts[own[low : low + ROWS_AT_ONCE]][:, None] + np.arange(length)].astype(np.int64).sum(axis=0)
        for length, (n, sums) in totals.items():
            yield pa.record_batch([pa.array([length]), pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["length", "n", "sums"])

    partial = vectors.select("vector").mapInArrow(counted, "length long, n long, sums array<long>")
    lengths = partial.groupBy("length").agg(F.sum("n").alias("n"))
    chosen = lengths.orderBy(F.col("n").desc(), F.col("length").desc()).first()
    if chosen is None:
        return None
    length, n = chosen["length"], chosen["n"]
    entries = partial.where(F.col("length") == length).select(F.posexplode("sums").alias("at", "s"))
    sums = np.array([r["s"] for r in entries.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()], dtype=np.int64)
    mean = sums / n
    covariance = _summed(vectors.select("vector"), length, lambda x: (x - mean).T @ (x - mean)).reshape(length, length) / n
    values, columns = eigenvectors(covariance)
    # A direction without variance has no component.
    kept = min(keep, int((values > 10 * length * EPS * max(float(values[0]), 0.0)).sum()))
    values, columns = values[:kept], columns[:, :kept]
    trace = float(np.trace(covariance))
    if not kept:
        return Whitening(n, sums, columns, values, trace)
    scaled = columns / np.sqrt(values)

    def squares(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ scaled
        return np.vstack([white.sum(axis=0), white.T @ white])

    moments = _summed(vectors.select("vector"), length, squares).reshape(kept + 1, kept) / n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(kept)).max())
    return Whitening(n, sums, columns, values, trace, error)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sums of squares of n x - S; null beyond a long."""
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(sums).max(initial=0)) < 2.0**62:
        moved = n * x - sums
        if float(np.abs(moved).max(initial=0)) ** 2 * len(sums) < 2.0**62:
            return (moved * moved).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def whitened(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", keep: int = 32) -> DataFrame:
    """Every usable row on every component, scaled to variance 1.

    An entry c becomes the whole number floor(64 c) + 1000000. Rows whose vector is
    null, empty, or holds null or non-finite entries (or ones too large to be exact
    whole numbers) are left out, as are vectors of another length than most. Returns
    per row and component up to ``keep``: id, ``component`` (from 1, by falling
    eigenvalue), ``n``, ``deviation`` (null beyond a long), ``whitened``, ``explained``
    and ``identity_error``, how far the covariance of all whitened rows is from the
    identity. Directions without variance have no component, so equal vectors alone
    give no rows. Repeated rows count each; ids may be null. Other columns are not
    read. An empty table gives no rows.
    """
    vectors = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    kind = vectors.schema["id"].dataType.simpleString()
    model = fit(vectors, keep)
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    # The model is as large as one vector times the number of components.
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k, mean, scaled = len(own.eigenvalues), own.sums / own.n, own.components / np.sqrt(own.eigenvalues)
        explained = own.eigenvalues / own.trace
        for batch, at, x in _matrices(batches, len(own.sums)):
            m = len(at)
            ids = batch["id"].take(pa.array(np.repeat(at, k)))
            deviation = pa.array(_deviations(x, own.n, own.sums), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            white = ((x - mean) @ scaled).ravel()
            yield pa.record_batch(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, own.n)), deviation, pa.array(white), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, own.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(projected, schema).withColumnRenamed("id", id_column)
