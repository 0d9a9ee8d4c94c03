"""Spelling variants, SimHash copies and whitening against plain Python and numpy."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash, spelling, whitening
from tidemark.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Spelling variants.
def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def plain_variants(rows) -> list[tuple]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return plain_groups({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def plain_groups(words: dict[str, int]) -> list[tuple]:
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for size, own in by_length.items():
        for a, b in itertools.chain(itertools.combinations(own, 2), itertools.product(own, by_length.get(size + 1, []))):
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 10 * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def listed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


VARIANTS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants_of_documents(spark, docs, folder):
    want = plain_variants((r.doc_id, r.text) for r in docs.collect())
    assert listed(QUERIES["op11_spelling_variants"](spark, folder), *VARIANTS) == want
    assert sum(w[1] is not None for w in want) > 5 and sum(w[4] for w in want) > 10


@pytest.mark.parametrize("hot", [64, 1])
def test_variants_of_words_that_share_chunks(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rng = np.random.default_rng(5)
    words = {"abcdefg" + "".join(rng.choice(list("xyzé"), rng.integers(0, 7))): int(rng.integers(2, 900)) for _ in range(400)}
    words |= {"".join(rng.choice(list("ab"), rng.integers(7, 11))): int(rng.integers(2, 90)) for _ in range(300)}
    words |= {"chainedword": 2, "chainedwor": 20, "chainedwort": 200, "chainedwart": 2000, "x" * 3000: 3, "x" * 2999: 40, "aaaaaaaa": 5, "aaaaaaa": 50}
    got = spelling.group_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert listed(got, *VARIANTS) == plain_groups(words)


def test_hot_chunks_are_cut_finer(spark):
    # A third of all words share their first half: no key may compare them all.
    words = [(f"gemeinsamvorne{a}{b}{c}{d}hintenverschieden{d}{c}{b}{a}", 2) for a, b, c, d in itertools.product("abcdefgh", repeat=4)]
    pairs = spelling.near_pairs(spark.createDataFrame(words, "word string, n long"))
    assert pairs.count() == 0


def test_spelling_variants_of_odd_rows(odd, nothing):
    assert listed(spelling.spelling_variants(odd), *VARIANTS) == plain_variants((r.doc_id, r.text) for r in odd.collect())
    assert spelling.spelling_variants(nothing).count() == 0


# SimHash.
def plain_print(text) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + size]).encode(), 42) for k in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows) -> list[tuple]:
    prints = [(d, plain_print(t)) for d, t in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 3:
            root[top(a)] = top(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[top(p)] = min(least.get(top(p), d), d)
    return sorted(((d, f"{p:016x}", least.get(top(p))) for d, p in prints), key=repr)


PRINTS = ("doc_id", "fingerprint", "component_id")


def test_simhash_of_documents(spark, docs, folder):
    want = plain_components((r.doc_id, r.text) for r in docs.collect())
    assert listed(QUERIES["op12_bit_sliced_simhash"](spark, folder), *PRINTS) == want


def test_simhash_of_near_copies(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    rows += [(1000 + 10 * d + k, f"{t} {'and more ' * k}") for d, t in rows if t and len(t) > 2000 for k in range(3)]
    want = plain_components(rows)
    assert listed(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")), *PRINTS) == want
    assert len({w[2] for w in want}) < len({w[1] for w in want}) < len(want)


def test_simhash_of_odd_rows(odd, nothing):
    assert listed(simhash.near_copies(odd), *PRINTS) == plain_components((r.doc_id, r.text) for r in odd.collect())
    assert simhash.near_copies(nothing).count() == 0


@pytest.mark.parametrize("how", [simhash.Planes(), simhash.Planes(block_rows=16, rows_at_once=50, meetings_at_once=100), simhash.Planes(by_chance=0)])
def test_links_between_fingerprints(spark, how):
    rng = np.random.default_rng(8)
    values = set(rng.integers(0, 2**64, 300, dtype=np.uint64).tolist())
    for centre in list(values)[:40]:
        for flips in (1, 2, 3, 3, 4, 5):
            changed = centre
            for b in rng.choice(64, flips, replace=False).tolist():
                changed ^= 1 << b
            values.add(changed)
    # One group whose members share most keys.
    for _ in range(200):
        values.add(12345 ^ sum(1 << b for b in rng.choice(64, 2, replace=False).tolist()))
    values = sorted(values)
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            root[top(a)] = top(b)
    want = {frozenset(g) for _, g in itertools.groupby(sorted(values, key=top), key=top)}
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "print long")
    for r in simhash.near_links(frame, how).collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() >= 1
    got = {v: v for v in values}
    from tidemark.llm.components import components

    for r in components(simhash.near_links(frame, how)).collect():
        got[r.node & (2**64 - 1)] = r.root & (2**64 - 1)
    assert {frozenset(g) for _, g in itertools.groupby(sorted(values, key=got.get), key=got.get)} == want


def test_bit_sliced_comparison_finds_all_pairs():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**64, 150, dtype=np.uint64)
    values[100:] = values[:50] ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64))
    i, j = simhash.near_rows(values, np.arange(150) + 1, np.full(150, 150))
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist()) if a != b}
    assert got == {(a, b) for a, b in itertools.combinations(range(150), 2) if (int(values[a]) ^ int(values[b])).bit_count() <= 3}


def test_more_fingerprints_take_longer_keys():
    for rows in (0, 1_000, 10**8, 10**11, 10**14):
        keys = simhash.key_parts(rows, 64)
        assert all(rows <= 64 << sum(w for _, w in key) for key in keys)
        # Whatever three bits differ, one key holds none of them.
        for bits in ((0, 1, 2), (0, 31, 63), (5, 20, 40), (15, 16, 17)):
            assert any(not any(s <= b < s + w for b in bits for s, w in key) for key in keys)


# Whitening.
def plain_whitening(rows):
    used = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in used], dtype=float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in used], x, n, sums, values[::-1], vectors[:, ::-1], centred


def test_whitening_of_embeddings(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    ids, x, n, sums, values, vectors, centred = plain_whitening([(r.vec_id, r.embedding) for r in table.collect()])
    got = QUERIES["op13_qdwh_whitening"](spark, folder).toPandas().sort_values(["component", "vec_id"])
    order = np.argsort(ids, kind="stable")
    deviation = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x[order]]
    assert sorted(got.component.unique()) == list(range(1, 33)) and (got.n == n).all()
    for k in range(32):
        own = got[got.component == k + 1]
        assert own.vec_id.tolist() == sorted(ids) and own.deviation.tolist() == deviation
        want = (centred @ vectors[:, k] / np.sqrt(values[k]))[order]
        white = own.whitened.to_numpy()
        white = white if white @ want > 0 else -white
        assert np.abs(white - want).max() < 1e-6
        assert np.allclose(own.explained, values[k] / values.sum(), rtol=1e-9)
        assert (own.identity_error < 1e-9).all() and own.identity_error.nunique() == 1


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "clusters", "rank", "one", "two", "minus"])
def test_eigenvectors(kind):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    values = {
        "random": rng.standard_normal(40),
        "graded": 10.0 ** -np.arange(40, dtype=float),
        "equal": np.full(40, 3.0),
        "clusters": np.repeat([5.0, 5.0 + 1e-13, 2.0, -1.0], 10),
        "rank": np.concatenate([[4.0, 2.0], np.zeros(38)]),
        "minus": -np.arange(40.0),
    }.get(kind, np.arange(1.0, 41))
    a = (q * values) @ q.T
    if kind in ("one", "two"):
        a = a[: 1 + (kind == "two"), : 1 + (kind == "two")]
    got, vectors = whitening.eigenvectors(a)
    assert np.allclose(got, np.linalg.eigvalsh((a + a.T) / 2)[::-1], atol=1e-13 * max(1, np.abs(got).max()) * 40)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.abs(a @ vectors - vectors * got).max() < 1e-13 * max(1, np.abs(got).max()) * 10


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    values = np.concatenate([np.logspace(-8, 0, 15), -np.logspace(-8, 0, 15)])
    sign = whitening.polar_factor((q * values) @ q.T)
    assert np.abs(sign - (q * np.sign(values)) @ q.T).max() < 1e-6


ODD_VECTORS = [
    (1, [1.0, 2.0, 0.5]),
    (1, [1.0, 2.0, 0.5]),
    (2, None),
    (3, [1.0, None, 2.0]),
    (4, [float("nan"), 1.0, 1.0]),
    (5, [float("inf"), 1.0, 1.0]),
    (None, [0.25, -4.0, 1.0]),
    (6, []),
    (7, [3.0, 1.0, -2.0]),
    (8, [0.0, 0.0, 0.0]),
    (9, [1.0, 2.0]),
    (10, [3e38, 0.0, 0.0]),
]


def test_whitening_of_odd_rows(spark):
    table = spark.createDataFrame(ODD_VECTORS, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "'x' AS vector", "2 AS n", "3 AS component", "4 AS at")
    got = whitening.whitened(table).toPandas()
    used = [r for r in ODD_VECTORS if r[0] in (1, None, 7, 8)]
    _, x, n, sums, values, vectors, centred = plain_whitening(used)
    assert sorted(got.component) == sorted([1, 2, 3] * 5) and (got.n == 5).all()
    assert sorted(set(got.deviation)) == sorted({sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for row in x})
    assert np.allclose(sorted(got.explained.unique())[::-1], values / values.sum()) and (got.identity_error < 1e-9).all()


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [float("nan")])], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    flat = whitening.whitened(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(6)], schema)).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 6


def test_exact_deviations_beyond_a_long():
    sums = np.array([5, 7])
    x = np.array([[1, 2], [2**45, 3]])
    assert whitening._deviations(x, 3, sums) == [(3 - 5) ** 2 + (6 - 7) ** 2, None]
