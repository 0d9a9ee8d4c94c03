"""Secrets in texts: candidates by shape, false positives removed by a random forest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import most_frequent, saved

RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}")
ASSIGNMENT = re.compile("[=:]")
# What may stand between a name and its value, and a value: quoted on one line, or else bare.
LEAD = re.compile(r"=*+>?+[^\S\n]*(?:(?:bearer|basic)[^\S\n]+)?", re.IGNORECASE)
QUOTED = re.compile(r"""(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`([^`\n]+)`)""")
BARE = re.compile(r"""["'`]?([^\s"'`&;,|(){}\[\]<>]+)""")
BARE_END = ".:"
NAMED = re.compile(r"[A-Za-z][0-9_\-]*$")
LOGIN = re.compile(r"""://[^\s/:@"'`]*:([^\s/@"'`]+)@""")
DICTIONARY_WORD = re.compile("[a-z]{4,}")
# Names that people give to secrets, and marks of an assignment.
NAMES = frozenset("token secret key apikey password passwd pwd passphrase auth authorization bearer credential credentials access passcode private".split())
NAME_ENDS = ("key", "token", "secret", "password")
NAME_SIGNS = re.compile(r"[A-Za-z0-9_\-]+$")
BEFORE, AFTER = 60, 20
TRAINING_TEXTS = 2_000
DICTIONARY_WORDS = 5_000
FLUSH = 300_000
FEATURES = (
    "length", "entropy", "digits", "uppers", "distinct", "hex", "switches", "transitions", "dictionary",
    "slashes", "path_before", "extension", "name_before", "assigned", "quoted", "words_before", "signs", "login", "opens",
)
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Found:
    """A candidate and where it lies in its text."""

    text: str
    low: int
    high: int

    def start(self) -> int:
        return self.low

    def end(self) -> int:
        return self.high

    def __getitem__(self, group: int) -> str:
        return self.text[self.low : self.high]


def _is_name(word: str) -> bool:
    return word.lower() in NAMES or word.lower().endswith(NAME_ENDS)


class Candidates:
    """Runs of at least 16 letters, digits and ``+/_-`` with a digit, every value given to a secret name by = or :, and passwords in addresses.

    A value may be of any length. A quoted one ends at its quote, a bare one at white
    space, a quote, any of ``&;,|``, a bracket, or the next secret name with its = or
    :, so values do not overlap and the work grows with the length of the text. A value
    that is also a run is found once; where one lies in the other, both are found.
    """

    def finditer(self, text: str) -> Iterator[Found]:
        spans = {m.span() for m in RUN.finditer(text)}
        spans |= {m.span(1) for m in LOGIN.finditer(text)}
        named = list(self._assignments(text))
        done = 0
        for (_, at), (following, _) in zip(named, [*named[1:], (len(text), 0)]):
            if at < done:  # within the last quoted value
                continue
            at = LEAD.match(text, at).end()
            if value := QUOTED.match(text, at):
                spans.add(value.span(value.lastindex))
                done = value.end()
            elif value := BARE.match(text, at, max(at, following)):
                low, high = value.span(1)
                done = high
                # A stop at the end is no part of a value.
                while high > low and text[high - 1] in BARE_END:
                    high -= 1
                if high > low:
                    spans.add((low, high))
        return (Found(text, low, high) for low, high in sorted(spans))

    @staticmethod
    def _assignments(text: str) -> Iterator[tuple[int, int]]:
        """Where each secret name begins, and where its = or : ends."""
        for m in ASSIGNMENT.finditer(text):
            end = m.start()
            while end and text[end - 1] in " \t\"'`])":
                end -= 1
            window = text[max(0, end - BEFORE) : end]
            # A name may be followed by digits or underscores: key_2 = ...
            if NAMED.search(window) and _is_name(re.findall("[A-Za-z]+", window)[-1]):
                yield end - len(NAME_SIGNS.search(window)[0]), m.end()


CANDIDATE = Candidates()


def _symbol_table() -> np.ndarray:
    out = np.full(256, len(SYMBOLS), dtype=np.int64)
    for k, c in enumerate(SYMBOLS):
        out[[ord(c), ord(c.upper())]] = k
    return out


_SYMBOL, _SIZE = _symbol_table(), len(SYMBOLS) + 1


def corpus_language(docs: DataFrame, words: int = DICTIONARY_WORDS) -> tuple[np.ndarray, frozenset[str]]:
    """Log-probabilities of one letter or digit following another, and common words, over all documents.

    What reaches the driver is bounded: 37 by 37 sums and ``words`` words.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, seen = np.zeros(_SIZE * _SIZE, dtype=np.int64), Counter()

        def flush(last: bool) -> pa.RecordBatch:
            keys, n = [w for w in seen if DICTIONARY_WORD.fullmatch(w)], []
            n, kinds = [seen[w] for w in keys], [False] * len(keys)
            seen.clear()
            if last:
                used = np.flatnonzero(pairs)
                keys, n, kinds = keys + list(map(str, used)), n + pairs[used].tolist(), kinds + [True] * len(used)
            return pa.record_batch([pa.array(kinds, pa.bool_()), pa.array(keys, pa.string()), pa.array(n, pa.int64())], names=["pair", "key", "n"])

        for batch in batches:
            for text in batch["text"].to_pylist():
                data = _SYMBOL[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
                if len(data) > 1:
                    pairs += np.bincount(data[:-1] * _SIZE + data[1:], minlength=len(pairs))
                seen.update(text.lower().split())
            if len(seen) > FLUSH:
                yield flush(False)
        yield flush(True)

    sums = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "pair boolean, key string, n long").groupBy("pair", "key").agg(F.sum("n").alias("n"))
    sums = saved(sums, "language")
    pairs = np.ones(_SIZE * _SIZE)
    for r in sums.where("pair").collect():
        pairs[int(r.key)] += r.n
    pairs = pairs.reshape(_SIZE, _SIZE)
    common = [r.key for r in most_frequent(sums.where("NOT pair").select("key", "n"), words).collect()]
    return np.log2(pairs / pairs.sum(axis=1, keepdims=True)), frozenset(common)


def _covered(text: str, words: frozenset[str]) -> float:
    """Share of characters in dictionary words, the longest taken from the left."""
    text, at, hit = text.lower(), 0, 0
    while at < len(text):
        for n in range(min(16, len(text) - at), 3, -1):
            if text[at : at + n] in words:
                hit, at = hit + n, at + n
                break
        else:
            at += 1
    return hit / len(text)


def features(before: str, found: str, after: str, transitions: np.ndarray, words: frozenset[str]) -> list[float]:
    """Features of a candidate and of the text around it."""
    body = found.rstrip("=") or found
    counts = np.array(list(Counter(body).values()), dtype=float) / len(body)
    data = _SYMBOL[np.frombuffer(body.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    kinds = np.array([0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in body])
    near = re.findall(r"[A-Za-z]+", before)
    return [
        math.log2(len(found)),
        float(-(counts * np.log2(counts)).sum()),
        float((kinds == 0).mean()),
        float((kinds == 2).mean()),
        len(counts) / min(len(body), 64),
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body) is not None),
        float((kinds[1:] != kinds[:-1]).mean()) if len(kinds) > 1 else 0.0,
        float(transitions[data[:-1], data[1:]].mean()) if len(data) > 1 else 0.0,
        _covered(found, words),
        body.count("/") / len(body),
        float(before[-1:] in tuple("./:@#") if before else 0.0),
        float(re.match(r"\.[a-z]{2,4}\b", after) is not None),
        float(any(map(_is_name, near[-3:]))),
        float(re.search(r"[=:]\s*[\"'`]?$|->\s*$", before) is not None),
        float(before[-1:] in tuple("\"'`") and after[:1] in tuple("\"'`") if before and after else 0.0),
        float(len(near)),
        sum(not c.isalnum() and c not in "+/_-" for c in body) / len(body),
        float(after[:1] == "@" and re.search(r"://[^\s/:@]*:$", before) is not None),
        float(after[:1] in tuple("({[<")) if after else 0.0,
    ]


def candidates(docs: DataFrame, language: tuple[np.ndarray, frozenset[str]], key_columns: list[str], text_column: str = "text") -> DataFrame:
    """A row per candidate: the key columns, ``start``, ``finish``, ``found`` and its features.

    Whole texts are searched; a null text holds none. Keys are carried as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(language)  # bounded, see corpus_language
    taken = docs.select(*key_columns, F.coalesce(F.col(text_column), F.lit("")).alias("_text"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, words = shared.value
        for batch in batches:
            at, start, finish, found, rows = [], [], [], [], []
            for k, text in enumerate(batch["_text"].to_pylist()):
                for m in CANDIDATE.finditer(text):
                    at.append(k)
                    start.append(m.start())
                    finish.append(m.end())
                    found.append(m[0])
                    rows.append(features(text[max(0, m.start() - BEFORE) : m.start()], m[0], text[m.end() : m.end() + AFTER], transitions, words))
            keys = [batch[c].take(pa.array(at, pa.int64())) for c in key_columns]
            values = np.array(rows, dtype=float).reshape(-1, len(FEATURES))
            columns = [*keys, pa.array(start, pa.int64()), pa.array(finish, pa.int64()), pa.array(found, pa.string()), *(pa.array(values[:, k]) for k in range(len(FEATURES)))]
            yield pa.record_batch(columns, names=[*key_columns, "start", "finish", "found", *(f"f_{f}" for f in FEATURES)])

    kinds = [f"{c} {taken.schema[c].dataType.simpleString()}" for c in key_columns]
    return taken.mapInArrow(searched, ", ".join([*kinds, "start long", "finish long", "found string", *(f"f_{f} double" for f in FEATURES)]))


def labelled_findings(docs: DataFrame, texts: int = TRAINING_TEXTS, text_column: str = "text") -> DataFrame:
    """(``text``, ``label``): findings of known kind, set into passages of the corpus.

    Spark derives them from the ``texts`` documents with the least hashes, a bound
    that does not depend on the corpus. Digests of the passages serve as random
    strings. Secrets: hex, base 64 and prefixed strings given to a name, and so are
    short passwords, such with other signs, letters without digits and passphrases.
    Not secrets: digests of commits and files, numbers, joined words, parts of paths,
    and what else stands behind a name: words, short numbers, dates, calls, blanks.
    """
    picked = docs.where(F.length(text_column) >= 40).select(F.col(text_column).alias("t"), F.xxhash64(text_column).alias("h"))
    # The bound is found on hashes alone; then few texts are read, and copies are one.
    bound = picked.select("h").distinct().orderBy("h").limit(texts).agg(F.max("h")).first()[0]
    picked = picked.where(F.col("h") <= F.lit(bound).cast("long")).dropDuplicates(["h"])
    words = F.split(F.regexp_replace(F.lower(F.substring("t", 1, 600)), r"[^\p{L}\s]+", ""), r"\s+")
    picked = picked.select("h", F.substring("t", 1, 160).alias("lead"), F.substring("t", 161, 80).alias("tail"), F.sha1("t").alias("hex"), F.sha2("t", 256).alias("hex256"), F.md5("t").alias("hex128"), F.regexp_replace(F.base64(F.unhex(F.sha2("t", 256))), "[\r\n]", "").alias("b64"), words.alias("w"))
    name = F.element_at(F.array(*[F.lit(n) for n in ("token", "api_key", "SECRET", "password", "auth_token", "TOKEN", "private_key", "access_key")]), (F.pmod("h", F.lit(8)) + 1).cast("int"))
    quote = F.when(F.pmod("h", F.lit(3)) == 0, F.lit("'")).when(F.pmod("h", F.lit(3)) == 1, F.lit('"')).otherwise(F.lit('"'))
    bare_sign = F.element_at(F.array(*map(F.lit, "!#@$%*^~")), (F.pmod("h", F.lit(8)) + 1).cast("int"))
    digits = F.lpad(F.pmod(F.xxhash64("hex"), F.lit(10**16)).cast("string"), 16, "7")
    joined = F.concat_ws("-", F.slice(F.filter("w", lambda x: F.length(x) > 3), 1, 5), F.pmod("h", F.lit(100)).cast("string"))
    long = F.filter("w", lambda x: F.length(x) > 3)
    one, two, three, four = (F.coalesce(F.get(long, F.lit(k)), F.lit(w)) for k, w in enumerate(("river", "stone", "window", "garden")))
    sign = F.element_at(F.array(*map(F.lit, "&!#@$%*^")), (F.pmod("h", F.lit(8)) + 1).cast("int"))
    figure = F.pmod("h", F.lit(90)) + 10
    mixed = F.regexp_replace("b64", "[^A-Za-z]", "")
    kinds = [
        (F.concat(name, F.lit(" = "), quote, "hex", quote), 1),
        (F.concat(name, F.lit(": "), quote, "b64", quote), 1),
        (F.concat(F.upper(name), F.lit("="), "hex128"), 1),
        (F.concat(name, F.lit(" = "), quote, F.lit("sk_live_"), F.substring("hex256", 1, 28), quote), 1),
        (F.concat(F.lit("Authorization: Bearer "), "b64"), 1),
        (F.concat(F.lit("commit "), "hex"), 0),
        (F.concat(F.lit("sha256:"), "hex256"), 0),
        (F.concat(F.lit("/objects/"), F.substring("hex", 1, 2), F.lit("/"), F.substring("hex", 3, 38)), 0),
        (F.concat(F.lit("https://example.org/files/"), "hex128", F.lit(".html")), 0),
        (digits, 0),
        (F.concat(F.lit("card = "), digits), 0),
        (joined, 0),
        (F.concat(name, F.lit(" = "), quote, F.substring(one, 1, 6), F.pmod("h", F.lit(10)), F.substring("hex", 1, 2), quote), 1),
        (F.concat(name, F.lit(": "), F.substring("b64", 1, 10)), 1),
        (F.concat(F.lit("pwd: "), quote, F.initcap(F.substring(one, 1, 5)), figure, sign, F.pmod("h", F.lit(10)), F.lit("!"), F.substring(two, 1, 5), quote), 1),
        (F.concat(name, F.lit("="), F.substring("hex256", 1, 5), bare_sign, F.substring("b64", 5, 6)), 1),
        (F.concat(name, F.lit(" = "), quote, F.substring(mixed, 1, 18), quote), 1),
        (F.concat(name, F.lit(" = "), quote, F.translate(F.substring("hex256", 1, 18), "0123456789", "ghjkmnpqrs"), quote), 1),
        (F.concat(F.lit("passphrase = "), quote, F.concat_ws("-", one, two, three, four), quote), 1),
        (F.concat(F.lit("passphrase: "), quote, F.concat_ws(" ", one, two, three, four), quote), 1),
        (F.concat(F.lit("Authorization: Basic "), F.substring("b64", 3, 16)), 1),
        (F.concat(F.lit("Authorization: Bearer "), F.substring("hex", 1, 4), F.substring("b64", 1, 6)), 1),
        (F.concat(F.lit("passcode="), F.substring("hex256", 1, 4), F.pmod("h", F.lit(10))), 1),
        (F.concat(one, F.lit("://"), two, F.lit(":"), F.substring(three, 1, 6), figure, F.lit("@db.example.org/"), four), 1),
        (F.concat(F.lit("https://"), one, F.lit(":"), F.substring("b64", 1, 12), F.lit("@example.org/"), two), 1),
        (F.concat(F.lit("GET /"), one, F.lit("?token="), F.substring("hex128", 1, 20), F.lit("&page="), figure), 1),
        (F.concat(F.lit("https://"), one, F.lit(":${"), F.upper(two), F.lit("}@example.org/")), 0),
        (F.concat(F.lit("https://"), one, F.lit(":***@example.org/")), 0),
        (F.concat(F.lit("Authorization: "), F.element_at(F.array(*map(F.lit, ("none", "required", "optional", "granted"))), (F.pmod("h", F.lit(4)) + 1).cast("int"))), 0),
        (F.concat(F.lit("GET /"), one, F.lit("?key="), two, F.lit("&token="), three, F.lit("&page="), figure), 0),
        (F.concat(F.lit("passcode: "), two), 0),
        (F.concat(name, F.lit(": "), one), 0),
        (F.concat(name, F.lit(" = "), quote, two, quote), 0),
        (F.concat(F.lower(name), F.lit(" = "), F.element_at(F.array(*map(F.lit, ("None", "null", "true", "false", "str", "required", "***", "public"))), (F.pmod("h", F.lit(8)) + 1).cast("int"))), 0),
        (F.concat(name, F.lit(": "), figure), 0),
        (F.concat(name, F.lit(": 20"), figure, F.lit("-01-"), figure), 0),
        (F.concat(F.lower(name), F.lit(" = get_"), one, F.lit("()")), 0),
        (F.concat(name, F.lit("=${"), F.upper(two), F.lit("}")), 0),
        (F.concat(name, F.lit(" = "), quote, F.lit("<"), one, F.lit(">"), quote), 0),
    ]
    kind = F.explode(F.array(*[F.struct(text.alias("core"), F.lit(label).alias("label")) for text, label in kinds])).alias("k")
    return picked.select("lead", "tail", kind).select(F.concat_ws(" ", "lead", "k.core", "tail").alias("text"), F.length("lead").alias("from"), F.col("k.label").cast("double").alias("label"))


def _vectors(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{f}" for f in FEATURES], outputCol="_features").transform(df)


def train(findings: DataFrame, language: tuple[np.ndarray, frozenset[str]], trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """Random forest on the candidates of labelled findings that begin at or after ``from``."""
    rows = candidates(findings, language, ["from", "label"]).where(F.col("start") >= F.col("from"))
    # The forest reads its rows once per level of its trees.
    rows = saved(rows.select("label", *(f"f_{f}" for f in FEATURES)), "findings")
    return RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=5).fit(_vectors(rows))


def scan(docs: DataFrame, key_columns: list[str], threshold: float = 0.5, text_column: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """Candidates of all whole texts with the forest's verdict.

    Returns one row per candidate: the key columns, ``start``, ``finish``,
    ``found``, ``score`` (probability of a secret) and ``secret``. A candidate is a
    run of at least 16 letters, digits and ``+/_-`` with a digit among them, or a
    quoted or bare value, whatever its length, behind a secret name and = or : on the
    same line (see ``Candidates`` for where it ends), or the password in
    ``://user:password@``. Finding and features take time in proportion to the text.
    ``findings`` (``text``, ``from``, ``label``) replaces the ones derived from the
    documents. Null and empty texts have no candidates; equal rows are scanned as
    often as they come; keys may be null; a table without enough text to derive
    findings of both kinds, such as an empty one, has every candidate unproven:
    score null, ``secret`` false.
    """
    plain = docs.select(F.col(text_column).alias("text"))
    language = corpus_language(plain)
    if findings is None:
        findings = saved(labelled_findings(plain), "labelled")
    found = candidates(docs, language, key_columns, text_column)
    both = findings.agg(F.count_distinct("label")).first()[0] > 1
    names = [*key_columns, "start", "finish", "found"]
    if not both:
        return found.select(*names, F.lit(None).cast("double").alias("score"), F.lit(False).alias("secret"))
    model = train(findings, language)
    scored = model.setProbabilityCol("_probability").transform(_vectors(found))
    score = vector_to_array("_probability")[1]
    return scored.select(*names, score.alias("score"), (score >= threshold).alias("secret"))


def redacted(docs: DataFrame, mark: str = "[SECRET]", text_column: str = "text", **options) -> DataFrame:
    """The documents with every secret replaced; all rows and columns stay."""
    keys = {"_s1": F.xxhash64(text_column), "_s2": F.xxhash64(F.lit(1), F.col(text_column))}
    keyed = docs.withColumns(keys)
    found = scan(keyed, ["_s1", "_s2"], text_column=text_column, **options).where("secret")
    # As many as a text holds; copies of a text share them. Saved, so that the join may
    # split a text with very many copies.
    spans = saved(found.groupBy("_s1", "_s2").agg(F.sort_array(F.collect_set(F.struct("start", "finish"))).alias("_spans")), "secret-spans")
    joined = keyed.join(spans, ["_s1", "_s2"], "left")
    # Offsets are in code points, as substring counts them. Spans that overlap get one mark.
    def replaced(s, x):
        piece = F.concat(F.substring(F.col(text_column), s["at"].cast("int") + 1, (x["start"] - s["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(s["at"], x["finish"]).alias("at"), F.concat(s["out"], F.when(x["start"] < s["at"], F.lit("")).otherwise(piece)).alias("out"))

    parts = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        replaced,
        lambda s: F.concat(s["out"], F.substring(F.col(text_column), s["at"].cast("int") + 1, F.length(text_column))),
    )
    return joined.withColumn(text_column, F.when(F.col("_spans").isNull(), F.col(text_column)).otherwise(parts)).select(*docs.columns)
