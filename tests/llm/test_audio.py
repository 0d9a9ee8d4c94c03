"""Fingerprints of recordings, and searches against all offsets."""

from __future__ import annotations

import io
import wave

import numpy as np

from tidemark.llm import audio


def wav(samples, rate=audio.RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(rate)
        file.writeframes((np.clip(samples / 2, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def recording(seed):
    return audio.melody(np.random.default_rng(seed).normal(0, 0.15, 64).tolist())[0]


def plain_match(a, b, how):
    """Least share of differing bits over all offsets."""
    best = 1.0
    for offset in range(-len(a) + 1, len(b)):
        x, y = max(0, -offset), min(len(a), len(b) - offset)
        if y - x >= min(how.overlap, len(a)):
            best = min(best, float(np.bitwise_count(a[x:y] ^ b[x + offset : y + offset]).mean()) / 32)
    return best


def test_search_finds_shifted_and_noisy_recordings(spark):
    rng = np.random.default_rng(9)
    songs = {k: recording(k) for k in range(12)}
    for k in range(6):
        lead = recording(100 + k)[: audio.HOP * 10]
        songs[20 + k] = np.concatenate([lead, songs[k]]) + rng.normal(0, 0.1, len(lead) + len(songs[k]))
    rows = [(k, bytearray(wav(s))) for k, s in songs.items()] + [(50, None), (51, bytearray(wav(np.zeros(100)))), (0, bytearray(wav(songs[0])))]
    table = spark.createDataFrame(rows, "vec_id long, audio binary")
    prints = audio.saved_fingerprints(table, "vec_id", "audio")
    got = {(r.query_id, r.vec_id): r for r in audio.search(prints, prints.where("vec_id < 6"), "vec_id", audio.Alignment(block_queries=3, block_rows=5)).collect()}
    made = {k: np.array(r, dtype=np.uint32) for k, r in ((r.vec_id, r.fingerprint) for r in prints.collect())}
    how = audio.Alignment()
    want = {(q, k) for q in range(6) for k in made if len(made[k]) and plain_match(made[q], made[k], how) <= how.errors}
    assert {(q, 20 + q) for q in range(6)} <= want
    assert set(got) <= want and len(set(got) & want) >= 0.9 * len(want)
    assert all(got[q, 20 + q].offset == 10 for q in range(6) if (q, 20 + q) in got)
    assert all(got[q, q].errors == 0 for q in range(6))
    assert audio.search(prints.limit(0), prints.limit(0), "vec_id").count() == 0


def test_recall_up_to_the_error_bound(spark):
    """Errors spread evenly over the bits, without self pairs, against all offsets."""
    rng, how = np.random.default_rng(4), audio.Alignment()
    songs = {k: audio.fingerprint(recording(k)) for k in range(10)}
    made = dict(songs)
    for k in range(10):
        for n, share in enumerate((0.05, 0.08, 0.1, 0.12, 0.14)):
            bits = (rng.random((len(songs[k]), 32)) < share) @ (1 << np.arange(32, dtype=np.int64))
            made[100 * (n + 1) + k] = (songs[k] ^ bits.astype(np.uint32))[5 * n :]
    rows = [(k, p.astype(np.int64).tolist()) for k, p in made.items()]
    prints = spark.createDataFrame(rows, "vec_id long, fingerprint array<long>")
    got = {(r.query_id, r.vec_id): r for r in audio.search(prints, prints.where("vec_id < 10"), "vec_id").collect()}
    want = {(q, k) for q in range(10) for k in made if k != q and plain_match(made[q], made[k], how) <= how.errors}
    found = {x for x in got if x[0] != x[1]}
    assert len(want) >= 40 and found <= want and len(found) >= 0.98 * len(want)


def test_search_of_odd_rows(spark):
    """Ties, repeated rows, null ids, empty and null fingerprints, and columns with clashing names."""
    own = audio.fingerprint(recording(1)).astype(np.int64).tolist()
    rows = [(100, own), (100, own), (1, own), (None, own), (2, []), (3, None), (200, own[:9])]
    prints = spark.createDataFrame(rows, "vec_id long, fingerprint array<long>").selectExpr("*", *[f"'z' AS {c}" for c in ("id", "x", "y", "query", "offset", "errors", "mark", "query_id")])
    got = audio.search(prints, prints.where("vec_id % 100 = 0"), "vec_id", audio.Alignment(block_queries=1, block_rows=2)).collect()
    pairs = sorted(((r.query_id, r.vec_id) for r in got), key=repr)
    assert pairs == sorted([(q, k) for q in (100, 100, 200) for k in (100, 100, 1, None, 200)], key=repr)
    assert all(r.errors == 0 and r.overlap == (9 if 200 in (r.query_id, r.vec_id) else len(own)) for r in got)


def test_a_held_note_is_counted_in_parts(monkeypatch):
    held = np.full(60, 7, dtype=np.uint32)
    whole = audio._Queries([held, held[:30]]).aligned(held, audio.Alignment())
    monkeypatch.setattr(audio, "VOTES_AT_ONCE", 100)
    assert audio._Queries([held, held[:30]]).aligned(held, audio.Alignment()) == whole
    assert [(q, offset, errors) for q, offset, errors, _ in whole] == [(0, 0, 0.0), (1, 0, 0.0)]


def test_short_excerpts_align_both_ways():
    whole, how = audio.fingerprint(recording(3)), audio.Alignment()
    part = whole[20:29]
    assert [x[:3] for x in audio._Queries([whole]).aligned(part, how)] == [(0, -20, 0.0)]
    assert [x[:3] for x in audio._Queries([part]).aligned(whole, how)] == [(0, 20, 0.0)]


def test_fingerprint_of_silence_and_chroma():
    assert len(audio.fingerprint(np.zeros(10))) == 0
    assert len(set(audio.fingerprint(np.zeros(40_000)).tolist())) == 1
    tone = np.sin(2 * np.pi * 440 * np.arange(20_000) / audio.RATE)
    assert (audio.chroma(tone, audio.RATE).argmax(axis=1) == 0).all()  # A
    assert audio.chroma(tone, audio.RATE).shape[1] == 12
