"""Byte-pair encoding with a minimal acyclic transducer of frequent words.

The words that are most frequent in the corpus are compiled into an automaton
with shared suffixes whose transitions carry numbers; their sum along a word is
the word's place in a table of ids. It is written to one file, sent to the
executors by Spark and memory-mapped there, so that the Python workers of a
machine share its pages. All other words are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import most_frequent

LEXICON_WORDS = 131_072
FLUSH = 200_000
CACHED_WORDS = 100_000
CHUNK_CHARS = 1_000_000
LONG_WORD = 128
# The pattern that the vocabulary's file names; fixed, like the white space of Unicode below.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+"
NARROW = 0x180
BITS = 20
NEVER = 1 << 62


def narrow_piece() -> re.Pattern:
    """The same pattern with its classes spelled out, for texts of code points below ``NARROW`` only."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(NARROW) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{SPACE}{kinds['L']}{kinds['N']}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special strings of a word-end BPE file."""

    def __init__(self, text: str):
        data = json.loads(text)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        # Pairs and what they become as whole numbers: rank first, so the least number merges first.
        self.pairs = {self.ids[a] << BITS | self.ids[b]: k << BITS | self.ids[a + b] for k, (a, b) in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.piece, self.narrow = regex.compile(PIECE, regex.V0), narrow_piece()
        self.wide = re.compile(f"[^\0-{chr(NARROW - 1)}]")
        self.inner = [self.ids.get(x) for x in byte_symbols()]
        self.last = [self.ids.get(x + self.end) for x in byte_symbols()]

    def words(self, text: str) -> list[str]:
        """Normalised words of a text; special strings stand for themselves, marked by a leading NUL."""
        if self.split_special is None or "<|" not in text:
            return self._plain(text)
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append("\0" + part)
            else:
                out.extend(self._plain(part))
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            # Lower case goes letter by letter, so a final sigma is as any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (self.piece if self.wide.search(text) else self.narrow).findall(text)

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the lowest ranked pair is merged first, leftmost of equals."""
        if word[0] == "\0" and word[1:] in self.special:
            return [self.special[word[1:]]]
        data = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in data]
        parts[-1] = self.last[data[-1]]
        if None in parts:
            parts = [p for p in parts if p is not None]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        pairs = self.pairs.get
        ranks = [pairs(a << BITS | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NEVER:
            k = ranks.index(least)
            parts[k : k + 2] = [least & (1 << BITS) - 1]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = pairs(parts[k] << BITS | parts[k + 1], NEVER)
            if k:
                ranks[k - 1] = pairs(parts[k - 1] << BITS | parts[k], NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list, for words of any length."""
        pairs, n = self.pairs.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := pairs(parts[k] << BITS | parts[k + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if parts[k] is None or j >= n or pairs(parts[k] << BITS | parts[j], NEVER) != rank:
                continue  # one of the two has changed
            parts[k], parts[j] = rank & (1 << BITS) - 1, None
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < n and (r := pairs(parts[x] << BITS | parts[after[x]], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, x))
        return [p for p in parts if p is not None]


def compile_transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted, distinct words, numbered by their order.

    States are built along the sorted words; as soon as a state can change no more
    it is replaced by an equal one, if there is one. A transition's number is how
    many words sort before those that use it, from its state on.
    """
    states: list[list | None] = [[False, []]]  # is a word's end; (label, state) in order
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    last = b""

    def settle(depth: int) -> None:
        while len(path) - 1 > depth:
            child, parent = path.pop(), path[-1]
            key = (states[child][0], tuple(states[child][1]))
            known = register.setdefault(key, child)
            if known != child:
                states[parent][1][-1] = (states[parent][1][-1][0], known)
                states[child] = None

    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        settle(shared)
        for label in word[shared:]:
            states.append([False, []])
            states[path[-1]][1].append((label, len(states) - 1))
            path.append(len(states) - 1)
        states[path[-1]][0] = True
        last = word
    settle(0)

    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words below each state, children first
        at = stack[-1]
        todo = [s for _, s in states[at][1] if s not in below]
        if todo:
            stack.extend(todo)
        else:
            below[at] = int(states[at][0]) + sum(below[s] for _, s in states[at][1])
            stack.pop()
    number = {at: k for k, at in enumerate(sorted(below))}
    arcs = []
    for at in sorted(below):
        before = int(states[at][0])
        for label, to in states[at][1]:
            arcs.append((number[at] * 256 + label, number[to], before))
            before += below[to]
    columns = np.array(arcs, dtype=np.int64).reshape(-1, 3)
    return {"arc": columns[:, 0].copy(), "target": columns[:, 1].copy(), "output": columns[:, 2].copy(), "final": np.array([states[at][0] for at in sorted(below)], dtype=np.int64)}


class Lexicon:
    """Frequent words with their ids in one memory-mapped file."""

    PARTS = ("arc", "target", "output", "final", "offset", "ids")

    @staticmethod
    def write(path: str, words: list[str], vocabulary: Vocabulary) -> None:
        keys = sorted({w.encode("utf-8", "surrogatepass") for w in words})
        parts = compile_transducer(keys)
        ids = [vocabulary.merge(k.decode("utf-8", "surrogatepass")) for k in keys]
        parts["offset"] = np.cumsum([0, *map(len, ids)], dtype=np.int64)
        parts["ids"] = np.array([i for x in ids for i in x], dtype=np.int64)
        with open(path, "wb") as out:
            out.write(np.array([len(parts[p]) for p in Lexicon.PARTS], dtype=np.int64).tobytes())
            for p in Lexicon.PARTS:
                out.write(parts[p].tobytes())

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.int64, mode="r")
        ends = len(self.PARTS) + np.cumsum(data[: len(self.PARTS)])
        for name, end, size in zip(self.PARTS, ends, data[: len(self.PARTS)], strict=True):
            setattr(self, name, data[end - size : end])

    def look_up(self, words: list[str]) -> list[np.ndarray | None]:
        """Ids of each word, None where the lexicon lacks it. All words take a step at a time."""
        keys = [w.encode("utf-8", "surrogatepass") for w in words]
        if not keys or not len(self.arc):
            return [None] * len(keys)
        lengths = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(keys), dtype=np.uint8).astype(np.int64)
        state, place = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        live = np.flatnonzero(lengths > 0)
        depth = 0
        while len(live):
            wanted = state[live] * 256 + data[starts[live] + depth]
            at = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            hit = self.arc[at] == wanted
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            state[live], place[live] = self.target[at], place[live] + self.output[at]
            depth += 1
            live = live[lengths[live] > depth]
        found = (lengths > 0) & (state >= 0)
        found[found] = self.final[state[found]] == 1
        return [self.ids[self.offset[p] : self.offset[p + 1]] if ok else None for ok, p in zip(found, place, strict=True)]


class Encoder:
    """Words to ids and back, with a bounded memory of words met before."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.empty: set[str] = set()
        self.rare: list[str] = []

    def learn(self, words: set[str]) -> None:
        if len(self.rare) > CACHED_WORDS:  # words of the lexicon stay
            for word in self.rare:
                del self.ids[word], self.decoded[word]
            self.rare.clear()
        new = list(words - self.ids.keys())
        found = self.lexicon.look_up(new) if self.lexicon else [None] * len(new)
        tokens = self.vocabulary.tokens
        for word, ids in zip(new, found, strict=True):
            if ids is None:
                ids = self.vocabulary.merge(word)
                self.rare.append(word)
            else:
                ids = ids.tolist()
            self.ids[word] = " ".join(map(str, ids))
            self.decoded[word] = " ".join([tokens[i] for i in ids])
            if not ids:
                self.empty.add(word)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, ids in decimal and decoded tokens, both joined by spaces, of each text."""
        held, chars = [], 0
        for text in texts:
            held.append(self.vocabulary.words(text))
            chars += len(text)
            if chars > CHUNK_CHARS:
                yield from self._encoded(held)
                held, chars = [], 0
        yield from self._encoded(held)

    def _encoded(self, texts: list[list[str]]) -> Iterator[tuple[int, str, str]]:
        self.learn(set().union(*texts))
        for words in texts:
            if self.empty:
                words = [w for w in words if w not in self.empty]
            ids = " ".join(map(self.ids.__getitem__, words))
            yield ids.count(" ") + 1 if words else 0, ids, " ".join(map(self.decoded.__getitem__, words))


@lru_cache(maxsize=1)
def _vocabulary(text: str) -> Vocabulary:
    """Parsed once per Python worker, for all its tasks."""
    return Vocabulary(text)


@lru_cache(maxsize=1)
def _encoder(text: str, path: str) -> Encoder:
    return Encoder(_vocabulary(text), Lexicon(path))


def frequent_words(docs: DataFrame, vocabulary_text: str, words: int) -> list[str]:
    """The most frequent words of all documents; the parameter bounds what the driver gets."""
    if words < 1:
        return []
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text)  # a file of fixed size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = _vocabulary(shared.value), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(vocabulary.words(text))
            if len(counts) > FLUSH:
                yield flush()
        yield flush()

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sorted(r.word for r in most_frequent(found, words).collect() if r.word[0] != "\0")


def _sent_lexicon(spark: SparkSession, words: list[str], vocabulary: Vocabulary) -> str:
    """Write the lexicon on the driver and have Spark send it to every executor; returns its name there."""
    with tempfile.TemporaryDirectory() as folder:
        Lexicon.write(f"{folder}/lexicon", words, vocabulary)
        with open(f"{folder}/lexicon", "rb") as made:
            name = f"lexicon-{hashlib.sha256(made.read()).hexdigest()[:32]}"
        kept = f"{SparkFiles.getRootDirectory()}/sent"
        os.makedirs(kept, exist_ok=True)
        if not os.path.exists(f"{kept}/{name}"):
            os.replace(f"{folder}/lexicon", f"{kept}/{name}")
        spark.sparkContext.addFile(f"{kept}/{name}")
    return name


def encode(docs: DataFrame, vocabulary_path: str, lexicon_words: int = LEXICON_WORDS, id_column: str = "doc_id", text_column: str = "text", extra: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Encode every whole text and decode it again.

    ``vocabulary_path`` is a file that the driver reads and sends along; it must be
    a byte-level BPE with word ends, lower case, white space dropped. Returns one
    row per input row: id, ``n_tokens``, ``ids_sha256`` (of decimal ids joined by a
    space), ``decoded_sha256`` and the ``extra`` ones of ``ids`` and ``decoded``. The
    decoded text is the tokens joined by spaces, as the file names no decoder.
    Strings of special tokens in a text are those tokens. A null or empty text has
    no tokens. Rows may repeat; other columns are not read; an empty table gives no
    rows.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary_text = file.read()
    shared = spark.sparkContext.broadcast(vocabulary_text)  # a file of fixed size
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    name = _sent_lexicon(spark, frequent_words(texts, vocabulary_text, lexicon_words), Vocabulary(vocabulary_text))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    extra = tuple(c for c in ("ids", "decoded") if c in extra)
    schema += "".join({"ids": ", ids array<int>", "decoded": ", decoded string"}[c] for c in extra)

    def hashed(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, SparkFiles.get(name))
        for batch in batches:
            # Results leave a chunk at a time, so memory does not grow with a batch.
            sizes = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(sizes, np.arange(CHUNK_CHARS, sizes[-1] if len(sizes) else 0, CHUNK_CHARS))
            for low, high in pairwise(sorted({0, *cuts.tolist(), batch.num_rows})):
                part = batch.slice(low, high - low)
                made = list(encoder.encode(part["text"].to_pylist()))
                columns = [
                    part["id"],
                    pa.array([n for n, _, _ in made], pa.int64()),
                    pa.array([hashed(ids) for _, ids, _ in made], pa.string()),
                    pa.array([hashed(back) for _, _, back in made], pa.string()),
                ]
                if "ids" in extra:
                    flat = np.fromstring(" ".join(ids for _, ids, _ in made), dtype=np.int32, sep=" ")
                    offsets = np.cumsum([0, *(n for n, _, _ in made)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                if "decoded" in extra:
                    columns.append(pa.array([back for _, _, back in made], pa.string()))
                yield pa.record_batch(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256", *extra])

    return texts.mapInArrow(encoded, schema).withColumnRenamed("id", id_column)
