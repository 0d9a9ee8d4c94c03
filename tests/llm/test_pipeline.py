"""Every stage on what the one before kept, and the whole run."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
from tidemark.llm import secrets
from tokenizers import Tokenizer

from test_texts import plain_base, plain_similar


def test_stages(spark, folder, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    quality, copies, hide, mix, encode = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, folder).cache()
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    for r in docs.collect():
        if plain_base(r.text)[5]:
            assert r.doc_id not in ids
        elif labels.get(r.doc_id) == 1:
            assert r.doc_id in ids
    single = copies(spark, kept, folder).cache()
    classes = {c for _, _, c, _ in plain_similar([(r.doc_id, r.text) for r in kept.collect()])}
    assert sorted(r.doc_id for r in single.collect()) == sorted(classes) and single.columns == docs.columns
    lead = "The service reads its settings once it starts and writes them down again. "
    planted = [(10_000 + k, f"{lead}token = \"{hashlib.sha1(bytes([k])).hexdigest()}\" and more of it.", "en", "web", 0) for k in range(3)]
    single = single.unionByName(spark.createDataFrame(planted, single.schema)).cache()
    classes |= {r[0] for r in planted}
    hidden = hide(spark, single, folder).cache()
    assert sorted(r.doc_id for r in hidden.collect()) == sorted(classes) and hidden.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in hidden.collect())
    # Only what the forest calls a secret is gone, and all of that.
    texts = {r.doc_id: r.text for r in single.collect()}
    spans = {}
    for r in secrets.scan(single, ["doc_id"]).where("secret").collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.finish))
    for r in hidden.collect():
        out, at = "", 0
        for low, high in sorted(spans.get(r.doc_id, [])):
            out, at = (out + texts[r.doc_id][at:low] + "[SECRET]" if low >= at else out), max(at, high)
        assert r.text == out + texts[r.doc_id][at:]
    assert spans
    mixed = mix(spark, hidden, folder).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= classes
    # Of the blocks of a text some may be left out, but none is taken twice in one row.
    words = {r.doc_id: Counter(r.text.split()) for r in hidden.collect()}
    assert all(r.text.split() and not Counter(r.text.split()) - words[r.doc_id] for r in mixed.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = encode(spark, mixed, folder).collect()
    want = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, library.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in out) == want


def test_run_and_odd_rows(spark, folder, odd, nothing):
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() > 0 and len(whole.columns) == 5
    for frame in (odd, nothing):
        step = frame
        for _, stage in corpus_pipeline.STAGES:
            step = stage(spark, step, folder)
            step = spark.createDataFrame(step.collect(), step.schema)
        assert step.count() >= 0
