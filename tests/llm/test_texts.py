"""Operators on texts against plain Python, the tokenizer library and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, grades, licenses, near_duplicates, quality_rules, repeated_strings, secrets
from tidemark.llm.queries import QUERIES


# Removal of repeated strings.
def plain_removal(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


EDGES = ["ab" * 400, "x" * 199, "x" * 200, "x" * 201, "\x00" * 300 + "q" * 10 + "\x00" * 250, "é" * 150, "z" * 100 + "w" * 300 + "z" * 100, "w" * 250]


@pytest.mark.parametrize("hot", [5000, 1])
def test_repeated_strings(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(repeated_strings, "HOT", hot)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(EDGES)]
    got = repeated_strings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, *x) for (d, _), x in zip(rows, plain_removal([t for _, t in rows]))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    texts = dict(rows)
    for r in got:
        assert sum(s.high - s.low for s in r.spans) == r.n_removed and len(r.kept) == len(texts[r.doc_id].encode()) - r.n_removed


@pytest.fixture
def uneven(spark):
    """Tasks stay as small, and as empty, as the rows are dealt."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("records, windows, hot, salted", [(40_000, 200_000, 5_000, 16), (1, 1, 20, 2), (3, 50, 1, 1)])
def test_repeated_strings_in_tasks_without_records(uneven, monkeypatch, records, windows, hot, salted):
    for name, value in (("RUN_RECORDS", records), ("WINDOWS", windows), ("HOT", hot), ("SALTED", salted)):
        monkeypatch.setattr(repeated_strings, name, value)
    rng = np.random.default_rng(7)

    def words(n):
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(n))

    # A third equal texts, and a passage that half of the rest share between texts of their own.
    equal, passage = words(60), words(70)
    rows = [(k, equal if k % 3 == 0 else words(20) + passage + words(20) if k % 2 else words(50)) for k in range(180)]
    got = repeated_strings.remove_repeated(uneven.createDataFrame(rows, "doc_id long, text string").repartition(6), with_text=False)
    want = [(d, *x) for (d, _), x in zip(rows, plain_removal([t for _, t in rows]))]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == sorted(want)


def test_copies_of_a_hot_text_are_dealt_out(uneven, monkeypatch):
    monkeypatch.setattr(repeated_strings, "SALTED", 4)
    equal = "one page that a third of a crawl repeats " * 20
    rows = [(k, equal if k % 3 == 0 else f"{k} " * 300) for k in range(3000)]
    out = repeated_strings.remove_repeated(uneven.createDataFrame(rows, "doc_id long, text string"), with_text=False)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 2 * 3000 / 8


def test_a_run_without_records_is_empty():
    run = repeated_strings._Run(8)
    assert run.flush(200).num_rows == 0 and run.flush_windows(200).num_rows == 0


def test_repeated_strings_of_odd_rows(odd, nothing):
    got = repeated_strings.remove_repeated(odd).collect()
    want = plain_removal([r.text for r in odd.collect()])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert repeated_strings.remove_repeated(nothing).count() == 0


def test_loser_tree_merges_and_knows_prefixes():
    rng = np.random.default_rng(3)
    for count in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(count)]
        coded = [repeated_strings.front_coded(r) for r in runs]
        assert [[s for s, _ in repeated_strings.decoded_run(*c)] for c in coded] == runs
        out = list(repeated_strings.merged([repeated_strings.decoded_run(*c) for c in coded]))
        assert [s for _, s, _ in out] == sorted(itertools.chain(*runs))
        for (_, a, _), (_, b, k) in zip(out, out[1:]):
            assert a[:k] == b[:k] and (k == min(len(a), len(b)) or a[k] != b[k])


# Near copies.
def shingles(text):
    words = (text or "").encode().split()
    return frozenset(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def plain_similar(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    out = []
    for k, (d, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        copies = [rows[m][0] for m in range(len(rows)) if sets[m] == sets[k] and rows[m][0] is not None]
        out.append((d, min(copies, default=None), min(ids, default=None), links[k]) if sets[k] else (d, d, d, 0))
    return sorted(out, key=repr)


def test_similar_documents(spark, docs):
    base = [(r.doc_id, r.text) for r in docs.limit(60).collect()]
    words = base[1][1].split()
    near = [(500 + k, " ".join([*words[:k], f"changed{k}", *words[k + 1 :]])) for k in range(0, len(words), 3)]
    rows = base + near + [(900, base[2][1]), (901, base[2][1]), (902, "just three words"), (903, "just three words")]
    how = near_duplicates.Similarity(block_rows=8)  # large groups in blocks
    got = near_duplicates.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), how)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_similar(rows)


def test_similar_documents_of_odd_rows(odd, nothing):
    got = near_duplicates.similar_documents(odd)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_similar([(r.doc_id, r.text) for r in odd.collect()])
    kept = near_duplicates.one_of_each(odd)
    assert kept.columns == odd.columns
    assert [r.doc_id for r in kept.collect() if r.doc_id in (5, 6, 7)] == [5]
    assert sum(r.doc_id == 4 for r in kept.collect()) == 1
    assert near_duplicates.similar_documents(nothing).count() == 0 and near_duplicates.one_of_each(nothing).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    how = near_duplicates.Similarity()
    needed = how.needed()
    rng = np.random.default_rng(5)
    values = np.zeros((2, how.hashes), dtype=np.uint8)
    lost = 0
    for _ in range(2000):
        values[1] = rng.random(how.hashes) >= 0.8
        lost += not len(near_duplicates.surviving(values, np.array([0]), np.array([1]), needed)[0])
    assert lost == 0
    values[1] = np.arange(how.hashes) % 10 >= 3  # a similarity of 0.3 goes
    assert not len(near_duplicates.surviving(values, np.array([0]), np.array([1]), needed)[0])


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (100, 101), (200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Quality rules.
def plain_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + x for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for x in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:k] for k, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), failed


def test_quality_rules(spark, folder, docs, odd, nothing):
    got = QUERIES["op10_language_distance"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    poor = [r for r in got if labels.get(r.doc_id) == 0 and r.n_words >= 100]
    assert sum(r.kept for r in good) == len(good) and sum(r.kept for r in poor) <= 0.1 * len(poor)
    odd_rows = quality_rules.judge(odd).collect()
    want = sorted(plain_base(r.text) for r in odd.collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in odd_rows) == want
    assert quality_rules.judge(nothing).count() == 0


def test_every_language_is_judged(spark):
    words = {k: [f"{c}{x}" for x in "abcdefghijkl"] for k, c in (("l0", "m"), ("l1", "n"), ("l2", "o"), (None, "p"))}
    rows = [(10 * k + n, " ".join(words[lang][(n + x * x) % 12] + ("," * (x % 3)) for x in range(150 + 20 * k)), lang) for k, lang in enumerate(words) for n in range(8)]
    rows += [(100 + k, " ".join(f"ZZ{x}9{k}" for x in range(120)), lang) for k, lang in enumerate(words)] + [(200, "short", "l9"), (201, None, "l8")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted(map(tuple, quality_rules.judge(table).collect()))
    for languages in (1, 2, 4):
        assert sorted(map(tuple, quality_rules.judge(table, quality_rules.Rules(languages=languages)).collect())) == want
    kept = {r[0]: r[-1] for r in want}
    assert not any(kept[100 + k] for k in range(4)) and all(r[7] > 0 and r[8] > 0 for r in want if r[0] < 200)


def test_distance():
    d = quality_rules.js_distance
    assert d(np.array([1, 2]), np.array([2, 4])) < 1e-7 and d(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1.0)
    p, q = np.array([3.0, 1.0]), np.array([1.0, 1.0])
    m = (p / 4 + q / 2) / 2
    want = (sum(x * np.log2(x / y) for x, y in zip(p / 4, m)) + sum(x * np.log2(x / y) for x, y in zip(q / 2, m))) / 2
    assert d(p, q) == pytest.approx(want**0.5) and d(np.zeros(2), q) == 0.0


# Encoding.
STRANGE = ["ΑΣ ΣΑΣ. İI", "don't we'll I'VE 'S '' x's", "<|startoftext|>Hi<|endoftext|> <|endoftext|", "a\x1cb\x85c\xa0d​e　f", "１２３ ½ ⅷ 中文字 é ẛ̣", "Ǆ ß ŉ ﬁ ΐ", "…—“q”", "ab" * 400, "ñandú ſ ª º ²"]


@pytest.mark.parametrize("lexicon", [0, 500])
def test_encoding(spark, docs, odd, nothing, lexicon):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + k, t) for k, t in enumerate(STRANGE)]
    for frame, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), [t for _, t in rows]), (odd, [r.text for r in odd.collect()])):
        got = bpe.encode(frame, path, lexicon_words=lexicon).collect()
        want = []
        for t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back, ids))
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded, list(r.ids)) for r in got) == sorted(want)
    assert bpe.encode(nothing, path).count() == 0


def test_transducer_shares_suffixes(tmp_path):
    words = [w.encode() for w in sorted(["walked", "talked", "walks", "talks", "talk", "é", "a"])]
    parts = bpe.compile_transducer(words)
    assert len(parts["final"]) < sum(map(len, words)) - 8  # "alked", "alks" are there once
    vocabulary = bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    bpe.Lexicon.write(str(tmp_path / "lexicon"), [w.decode() for w in words], vocabulary)
    lexicon = bpe.Lexicon(str(tmp_path / "lexicon"))
    found = lexicon.look_up(["walks", "walk", "é", "", "talkss", "a"])
    assert [None if x is None else list(x) for x in found] == [vocabulary.merge("walks"), None, vocabulary.merge("é"), None, None, vocabulary.merge("a")]


def test_long_words_merge_alike(monkeypatch):
    vocabulary = bpe.Vocabulary(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    words = ["internationalisation", "aaaaaaaaaaaaaaa", "zzxqthethethe", "über"]
    short = [vocabulary.merge(w) for w in words]
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    assert [vocabulary.merge(w) for w in words] == short


# Licenses.
def test_licenses():
    index = licenses.Index(licenses.TEMPLATES, licenses.Scan())
    header = licenses.TEMPLATES["apache-2.0/header"]
    edited = header.replace("obtain a copy", "get yourself one copy").replace("software distributed", "works distributed")
    text = f"Words before. {edited}\nSome words between.\nReleased under the MIT License.\nÜber licensed under CC BY-NC 4.0."
    found = {m[0]: m for m in licenses.matches(text, index)}
    assert set(found) == {"apache-2.0/header", "mit/line", "cc-by-nc-4.0/line"}
    name, coverage, n, start, finish = found["apache-2.0/header"]
    assert text[start:finish].startswith("Licensed under the Apache") and text[start:finish].endswith("under the License") and 0.9 < coverage < 1
    assert text[slice(*found["mit/line"][3:])] == "Released under the MIT License"
    assert licenses.matches("the license was released and the copyright holders were licensed", index) == []


def test_license_wordings():
    index = licenses.Index(licenses.TEMPLATES, licenses.Scan())

    def names(text):
        return [m[0] for m in licenses.matches(text, index)]

    assert names("Released under MIT License") == names("Released under an MIT License!") == ["mit/line"]
    assert names("Licensed under CC BY-NC-SA 4.0.") == ["cc-by-nc-sa-4.0/line"]
    assert names("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0/line"] and names("licensed under cc by 4.0") == ["cc-by-4.0/line"]
    # Neither another license nor another version passes for one of the templates.
    assert names("Released under the ABC License.") == names("Licensed under the Apache License, Version 1.1.") == []
    assert names("This work is licensed under the GNU Lesser General Public License, version 3.") == ["lgpl-3.0/line"]
    assert names("This work is licensed under the GNU General Public License, version 2.") == ["gpl-2.0/line"]
    extra = [m for m in licenses.matches("Licensed under the Apache License, Version dot 2.0", index)]
    assert [m[0] for m in extra] == ["apache-2.0/line"] and extra[0][1] < 1
    # Every one of many copies in a row counts.
    line = "Released under the MIT License. "
    assert names(line * 50) == ["mit/line"] * 50


def test_edited_licenses_against_all_places():
    """Candidates from fingerprints against alignments of all templates at all places."""
    index = licenses.Index(licenses.TEMPLATES, licenses.Scan())
    rng = np.random.default_rng(11)
    got, want, short_got, short_want = 0, 0, 0, 0
    for name in index.names:
        for _ in range(6):
            words = licenses.WORDS.findall(licenses.TEMPLATES[name].lower())
            for _ in range(int(rng.integers(1, max(2, len(words) // 8)))):
                at, kind = int(rng.integers(0, len(words))), rng.integers(0, 3)
                words[at : at + (kind != 0)] = [] if kind == 1 else ["other"]
            text = " ".join(["first", "words", "of", "the", "page", *words, "and", "under", "the", "last"])
            ids = np.array([index.vocabulary.get(w, -1) for w in text.split()])
            t = index.names.index(name)
            there = any(index.match(t, ids, shift) is not None for shift in range(-len(index.words[t]), len(ids)))
            found = any(index.match(t, ids, k - p) is not None for s, p, k in index.hits(ids) if s == t)
            assert found <= there
            got, want = got + found, want + there
            short_got, short_want = short_got + (found and index.is_short(t)), short_want + (there and index.is_short(t))
    assert short_got == short_want > 30 and got >= 0.9 * want and want > 80


def test_overlaps_take_time_in_proportion():
    index = licenses.Index(licenses.TEMPLATES, licenses.Scan())

    def seconds(copies):
        text, began = "Released under the MIT License.\n" * copies, time.perf_counter()
        assert len(licenses.matches(text, index)) == copies
        return time.perf_counter() - began

    seconds(100)
    assert seconds(4000) < 12 * seconds(1000)


def test_alignment_against_all_cells():
    rng = np.random.default_rng(7)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 14)
        score = np.zeros((13, 15), dtype=int)
        for i in range(1, 13):
            for j in range(1, 15):
                score[i, j] = max(0, score[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
        n, first, last = licenses.aligned(a, b, 0, 20)
        assert n >= score.max() and 0 <= first < last <= 14


def test_licenses_of_tables(spark, folder, docs, odd, nothing):
    got = QUERIES["op1_license_spans"](spark, folder).collect()
    lines = [t for n, t in licenses.TEMPLATES.items() if n.endswith("/line")]
    want = sorted(r.doc_id for r in docs.collect() for line in lines for _ in range(r.text.count(line)))
    assert sorted(r.doc_id for r in got) == want
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(nothing).count() == 0


# Secrets.
def test_secrets(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = secrets.scan(docs, ["doc_id"]).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((d, m.start()) for d, t in texts.items() for m in secrets.CANDIDATE.finditer(t))
    assert sorted((r.doc_id, r.start) for r in got) == want
    planted = {(r.doc_id, r.start) for r in got if texts[r.doc_id][max(0, r.start - 9) : r.start].lower().endswith('token = "')}
    assert {(r.doc_id, r.start) for r in got if r.secret} == planted and planted
    clean = secrets.redacted(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    hidden = {r.doc_id: r.text for r in clean.collect()}
    for r in got:
        assert (r.found in hidden[r.doc_id]) != r.secret
    assert [t for d, t in hidden.items() if d not in {d for d, _ in planted}] == [t for d, t in texts.items() if d not in {d for d, _ in planted}] or sorted(hidden) == sorted(texts)
    assert secrets.redacted(odd).select("doc_id", "text").exceptAll(odd.select("doc_id", "text")).count() == 0
    assert secrets.scan(nothing, ["doc_id"]).count() == 0


def found_in(text):
    return [m[0] for m in secrets.CANDIDATE.finditer(text)]


def test_values_end_where_the_next_begins():
    assert found_in("https://x.org/a?token=abc&key=def&x=1") == ["abc", "def"]
    assert found_in("password: one; secret=two, api_key=(three) token = [four]|pwd=five.") == ["one", "two", "five"]
    assert found_in("token=first:db_key=second") == ["first", "second"]
    assert found_in('auth: "token=abc def" key=`x y`') == ["token=abc def", "x y"]
    assert found_in("Authorization: Basic dXNlcjpwYXNz") == ["dXNlcjpwYXNz"]
    assert found_in("Authorization: Bearer shorttok1 passcode=84hd") == ["shorttok1", "84hd"]
    assert found_in("postgres://admin:hunter2@db/x and http://host:8080/y") == ["hunter2"]
    assert found_in("key:" * 100) == [] and found_in("key=") == [] and found_in("= : =:") == []
    assert found_in("api_key: dGVzdA==") == ["dGVzdA=="]


@pytest.mark.parametrize("unit", ["key:", "token=a1&", "key:'", 'x9Zk"', "secret=ab1:", "://a:b", "a1/b2-", "password: \\\"", "q7"])
def test_finding_takes_time_in_proportion(unit):
    def seconds(size):
        text, began = unit * (size // len(unit)), time.perf_counter()
        for m in secrets.CANDIDATE.finditer(text):
            secrets.features(text[max(0, m.start() - 60) : m.start()], m[0], text[m.end() : m.end() + 20], np.zeros((37, 37)), frozenset(["river"]))
        return time.perf_counter() - began

    seconds(10_000)
    assert seconds(400_000) < 30 * max(0.02, seconds(40_000))


def test_values_given_to_secret_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    secret = {1: 'password = "hunter2x9"', 2: 'pwd: "Tr0ub4dor&3!long"', 3: 'secret = "QwErTyUiOpAsDfGhJk"', 4: "db_password=k7#pQ2!z", 5: '"token": "x9Kq2Lm4",'}
    plain = {6: "The key: river", 7: "access = None", 8: "token: 42", 9: "password = get_word()"}
    lines = {-k: f"Some text stands here before. {t} and more of it after." for k, t in {**secret, **plain}.items()}
    table = docs.unionByName(spark.createDataFrame(list(lines.items()), "doc_id long, text string"))
    got = {r.doc_id: r for r in secrets.scan(table, ["doc_id"]).where("doc_id < 0").collect()}
    assert {-d: r.found for d, r in got.items()} == {1: "hunter2x9", 2: "Tr0ub4dor&3!long", 3: "QwErTyUiOpAsDfGhJk", 4: "k7#pQ2!z", 5: "x9Kq2Lm4", 6: "river", 7: "None", 8: "42", 9: "get_word"}
    assert {-d for d, r in got.items() if r.secret} == set(secret)
    hidden = {r.doc_id: r.text for r in secrets.redacted(table).where("doc_id < 0").collect()}
    assert all((r.found in hidden[d]) != r.secret for d, r in got.items()) and 'pwd: "[SECRET]" and' in hidden[-2]


def test_candidates_that_overlap():
    text = 'token = "a b1c2d3e4f5a6b7c8d9 e" url: x key_2 := \'\' monkey=="" pass: y'
    assert [m[0] for m in secrets.CANDIDATE.finditer(text)] == ["a b1c2d3e4f5a6b7c8d9 e", "b1c2d3e4f5a6b7c8d9"]


def test_dictionary_coverage_of_whole_candidates():
    k = secrets.FEATURES.index("dictionary")
    found = "q" * 600 + "river" * 120
    assert secrets.features("", found, "", np.zeros((37, 37)), frozenset(["river"]))[k] == 0.5


def test_forest_on_held_out_findings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    language = secrets.corpus_language(docs.select("text"))
    labelled = secrets.labelled_findings(docs, 400)
    train, test = labelled.where("`from` % 2 = 0 OR hash(text) % 3 <> 0"), labelled.where("hash(text) % 3 = 0")
    model = secrets.train(train.where("hash(text) % 3 <> 0"), language)
    rows = model.transform(secrets._vectors(secrets.candidates(test, language, ["from", "label"]).where("start >= `from`"))).select("label", "prediction").collect()
    assert len(rows) > 500 and sum(r.label == r.prediction for r in rows) >= 0.97 * len(rows)


# Grades.
def test_grades_of_held_out_labels(spark, odd, nothing):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", grades.rating().alias("grade"))
    got = grades.grade(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    by = {g: [r for r in got if r.grade == g] for g in (0, 1, 2)}
    assert sum(r.kept for r in by[0]) <= 0.05 * len(by[0])
    assert sum(r.kept for r in by[1]) <= 0.5 * len(by[1])
    assert sum(r.kept for r in by[2]) >= 0.95 * len(by[2])
    means = [np.mean([r.expected_grade for r in by[g]]) for g in (0, 1, 2)]
    assert means == sorted(means)
    assert grades.grade(odd, labels).count() == odd.count() and grades.grade(nothing, labels).count() == 0
    unlearned = grades.grade(odd, labels.where("grade = 2")).collect()
    assert {(r.expected_grade, r.tail, r.kept) for r in unlearned} == {(None, None, True)}


def test_rows_of_one_id_are_learnt_alike(spark):
    texts = [(k, f"words of page {k}") for k in range(40)] + [(k, f"another text {k} of it") for k in range(40)]
    marks = [(k, k % 3) for k in range(40)] + [(k, (k + 1) % 3) for k in range(40)]
    samples = []
    for turn in (1, -1):
        docs = spark.createDataFrame(texts[::turn], "doc_id long, text string").repartition(4 + turn)
        labels = spark.createDataFrame(marks[::turn], "doc_id long, grade int")
        features, given = grades.graded_sample(docs, labels, grades.Fit(), "doc_id", "text")
        samples.append(([f.tolist() for f in features], given.tolist()))
    assert samples[0] == samples[1] and samples[0][1] == [min(k % 3, (k + 1) % 3) for k in range(40)]


def test_selection_cut():
    best = np.array([True] * 8 + [False] * 4)
    assert grades.selection_cut(np.array([0.9] * 8 + [0.2] * 4), best) == pytest.approx(0.25)
    assert grades.selection_cut(np.array([0.4] * 12), best) == 0.0  # nothing was learned, so nothing goes


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(2)
    features, marks = [], []
    for _ in range(600):
        have = rng.random(3) < 0.5
        features.append(np.array([k for k in range(3) if have[k]] + [3], dtype=np.int32))
        marks.append(int(np.clip(round(1 + have[0] - have[1] + rng.normal(0, 0.3)), 0, 2)))
    model = grades.fit(features, np.array(marks), grades.Fit(buckets=8, least_deviation=0.0, steps=300))
    assert model.weights[0] > 0 > model.weights[1] and abs(model.weights[2]) < min(model.weights[0], -model.weights[1]) / 3
    assert list(model.thresholds) == sorted(model.thresholds)
    above = model.above(np.array([-1.0, 0.0, 1.0]))
    assert (above[:, 0] >= above[:, 1]).all() and (np.diff(above, axis=0) >= 0).all()
