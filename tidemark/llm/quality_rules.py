"""Quality rules: base counts of a text, and its distance from its language.

A document is compared with all documents of its language: the shares of classes
of characters, and the shares of the language's commonest words, by Jensen-Shannon
distance. Texts too short for a share to mean anything are not judged by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
# Classes of characters; anything else is counted by kind of letter or as other.
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "other")
STOPS, QUOTES = ".,;:!?", "\"'()[]{}-_/\\"
FLUSH = 300_000


@dataclass(frozen=True)
class Rules:
    """Limits. Distances lie between 0 (same shares) and 1 (nothing in common).

    ``languages`` bounds how many references tasks hold in memory, not how many
    languages are judged.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 64
    languages: int = 200
    class_min_chars: int = 250
    class_distance: float = 0.3
    word_min_words: int = 60
    word_distance: float = 0.43


def _class_table() -> np.ndarray:
    """Class of every code point below 0x3000; those above count as other."""
    out = np.full(0x3000, CLASSES.index("other"), dtype=np.uint8)
    for code in range(len(out)):
        c = chr(code)
        if c.isspace():
            kind = "space"
        elif c in SYMBOLS:
            kind = "symbol"
        elif c in STOPS:
            kind = "stop"
        elif c in QUOTES:
            kind = "quote"
        elif c.isdigit():
            kind = "digit"
        elif c.isalpha():
            kind = "upper" if c.isupper() else "lower"
        else:
            continue
        out[code] = CLASSES.index(kind)
    return out


_TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_TABLE[np.minimum(codes, len(_TABLE) - 1)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    if len(words) < 6:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    window = ids[:-4]
    for k in range(1, 5):
        # Numbered anew after each step, so the pairs stay exact integers.
        window = window * len(numbers) + ids[k : len(ids) - 4 + k]
        if len(numbers) ** (k + 1) * len(numbers) >= 2**62 and k < 4:
            window = np.unique(window, return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), dtype=bool)
    for k in range(5):
        covered[k : len(words) - 4 + k] |= twice
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated windows."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    kl = sum(float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q))
    return float(np.sqrt(max(0.0, kl / 2)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of classes and words by language: partial sums of a task."""
    classes: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, "c", name, int(n)) for lang, counts in classes.items() for name, n in zip(CLASSES, counts, strict=True)]
        rows += [(lang, "w", w.decode("utf-8", "replace"), n) for lang, counts in words.items() for w, n in counts.items()]
        rows += [(lang, "t", "", sum(counts.values())) for lang, counts in words.items()]
        classes.clear()
        words.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "key", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts = classes.get(lang)
            if counts is None:
                counts = classes[lang] = np.zeros(len(CLASSES), dtype=np.int64)
                words[lang] = Counter()
            counts += class_counts(text)
            words[lang].update(text.lower().encode("utf-8", "surrogatepass").split())
        if len(CLASSES) * len(classes) + sum(map(len, words.values())) > FLUSH:
            yield flush()
    yield flush()


def language_references(docs: DataFrame, rules: Rules) -> DataFrame:
    """One row per language: ``lang``, ``chars`` and ``reference``, over all documents.

    A reference lists (kind, rank, key, n): the counts of the classes, the commonest
    words and the number of words, so a row is bounded whatever the language holds.
    """
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_counted, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "key")
    top = counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= max(rules.common_words, len(CLASSES)))
    chars = F.sum(F.when(F.col("kind") == "c", F.col("n")).otherwise(0)).alias("chars")
    rows = top.groupBy("lang").agg(chars, F.collect_list(F.struct("kind", "rank", "key", "n")).alias("reference"))
    return saved(rows, "language")


def _parsed(reference: list[dict], rules: Rules) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    """Class counts, common words and their counts, the words beyond them last."""
    classes = {r["key"]: r["n"] for r in reference if r["kind"] == "c"}
    common = sorted((r["rank"], r["key"], r["n"]) for r in reference if r["kind"] == "w" and r["rank"] <= rules.common_words)
    words = {key.encode(): i for i, (_, key, _) in enumerate(common)}
    seen = np.array([n for _, _, n in common] + [0], dtype=np.int64)
    seen[-1] = next(r["n"] for r in reference if r["kind"] == "t") - seen.sum()
    return np.array([classes.get(c, 0) for c in CLASSES], dtype=np.int64), words, seen


def judge(docs: DataFrame, rules: Rules = Rules(), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document.

    Returns one row per input row: id, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words`` (words in windows of five words that occur
    twice or more in the text), ``base_failed`` (too few words, or too large a
    share of repeated ones), ``class_distance``, ``word_distance`` (0 where the
    text is too short to be judged) and ``kept``. The references of the
    ``languages`` largest languages are held by every task; documents of the others
    are joined to theirs, with equal results. A null or empty text has no words and fails; a null
    language is one of its own. Rows may repeat; other columns are not read. An
    empty table gives no rows.
    """
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    references = language_references(plain, rules)
    largest = references.orderBy(F.col("chars").desc(), "lang").limit(rules.languages).collect()
    beyond = len(largest) == rules.languages and references.count() > len(largest)
    # Bounded by the rules: ``languages`` times the classes and the common words.
    shared = docs.sparkSession.sparkContext.broadcast({r.lang: _parsed([x.asDict() for x in r.reference], rules) for r in largest})
    kind = plain.schema["id"].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, others = shared.value, {}
        for batch in batches:
            counts, classes, words = [], [], []
            own_references = batch["reference"] if "reference" in batch.schema.names else None
            for k, (lang, text) in enumerate(zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                base = base_counts(text)
                by_class = by_word = 0.0
                reference = known.get(lang)
                if reference is None and own_references is not None:
                    if lang not in others:
                        if len(others) >= rules.languages:
                            others.clear()
                        others[lang] = _parsed(own_references[k].as_py(), rules)
                    reference = others[lang]
                if reference is not None:
                    if len(text) >= rules.class_min_chars:
                        by_class = js_distance(class_counts(text), reference[0])
                    if base[0] >= rules.word_min_words:
                        common = reference[1]
                        own = text.lower().encode("utf-8", "surrogatepass").split()
                        found = np.fromiter(map(common.get, own, repeat(len(common))), dtype=np.int64, count=len(own))
                        by_word = js_distance(np.bincount(found, minlength=len(common) + 1), reference[2])
                counts.append(base)
                classes.append(by_class)
                words.append(by_word)
            n = np.array(counts, dtype=np.int64).reshape(-1, 5)
            failed = (n[:, 0] < rules.min_words) | (100 * n[:, 4] > rules.max_repeat_percent * n[:, 0])
            c, w = np.array(classes, dtype=float), np.array(words, dtype=float)
            kept = ~failed & (c <= rules.class_distance) & (w <= rules.word_distance)
            columns = [batch["id"], *(pa.array(n[:, k]) for k in range(5)), *map(pa.array, (failed, c, w, kept))]
            yield pa.record_batch(columns, names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"])

    texts = plain.select("id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    if not beyond:
        return texts.mapInArrow(judged, schema).withColumnRenamed("id", id_column)
    # Texts too short for either distance need no reference, so the join is not skewed by them.
    short = F.length("text") < min(rules.class_min_chars, 2 * rules.word_min_words - 1)
    near = short | F.col("lang").isin([r.lang for r in largest])
    joined = texts.where(~near).join(references.select("lang", "reference"), "lang").select("id", "lang", "text", "reference")
    return texts.where(near).mapInArrow(judged, schema).unionByName(joined.mapInArrow(judged, schema)).withColumnRenamed("id", id_column)
