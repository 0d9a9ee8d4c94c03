"""Spelling variants: words one edit apart, each tied to its far more frequent neighbour.

Asymmetric chunks: a word is cut into two disjoint chunks, and one edit leaves one of
them whole. Its partner holds that chunk as a gram, at the same place or shifted by
the one code point that an insertion or a deletion moves it. Of a partner's grams
only those within this shift of a chunk's place can meet one, so only they are sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
# A run shorter than the least length cannot become a word, so it is not even read.
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"
# Chunked words of one key from which the key is cut finer.
HOT = 64


def damaged_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", every: int = 31) -> DataFrame:
    """(``word``) once per occurrence: runs of letters, one in ``every`` with a code point deleted.

    Which runs, and which code point, follows from the CRC-32 of ``<id>:<run>``.
    """
    runs = docs.select(F.col(id_column).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col(text_column), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, CAST(h % length(run) AS INT))"), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)


def _key(word: Column, shift: Column) -> Column:
    """Hash of a word but for the places ``low`` to ``high``, which are moved by ``shift`` in it."""
    rest = F.struct(word.substr(F.lit(1), F.col("low")), word.substr(F.col("high") + shift + 1, F.length(word)))
    return F.xxhash64("size", "low", "high", rest)


def near_pairs(words: DataFrame) -> DataFrame:
    """(``a``, ``a_n``, ``b``, ``b_n``) for all words that one edit turns into one another, each pair once.

    ``words`` holds distinct ``word`` and ``n``. The longer word (of equal length:
    the smaller one) is chunked, the other gives grams for words of its own length
    and for those one longer. ``low`` and ``high`` bound the chunk that the edit may
    have touched; the key is all the rest, so the whole chunk is compared.

    A key that more than ``HOT`` chunked words share is cut finer: the part not yet
    compared is halved, until one place is left, where all that meet are near. So
    no key gathers more than a bounded number of words, and none is dropped.
    """
    words = words.select("word", "n", F.length("word").alias("length"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("low"), (F.col("size") / 2).cast("int").alias("high")), F.struct((F.col("size") / 2).cast("int").alias("low"), F.col("size").alias("high")))).alias("part")
    chunks = words.withColumn("size", F.col("length")).select("word", "n", "size", halves).select("word", "n", "size", "part.*")
    grams = words.withColumn("size", F.explode(F.array(F.col("length"), F.col("length") + 1))).select("word", "n", "length", "size", halves)
    grams = grams.select("word", "n", "size", "part.*", (F.col("length") - F.col("size")).alias("shift"))
    found = None
    while True:
        chunks = saved(chunks.withColumn("key", _key(F.col("word"), F.lit(0))), "chunks")
        grams = saved(grams.withColumn("key", _key(F.col("word"), F.col("shift"))), "grams")
        counts = chunks.groupBy("key").agg(F.count("*").alias("n_chunks"), F.first("low").alias("low"), F.first("high").alias("high"))
        hot = saved(counts.where(f"n_chunks > {HOT} AND high - low > 1").select("key"), "hot-chunks")
        split = not hot.isEmpty()
        cold = chunks.join(hot, "key", "left_anti") if split else chunks
        a, b = (t.select("key", *[F.col(c).alias(f"{p}{c}") for c in ("word", "n", "size", "low", "high")]) for p, t in (("a_", cold), ("b_", grams)))
        met = a.join(b, "key").where("a_size = b_size AND a_low = b_low AND a_high = b_high")
        met = met.where("length(a_word) > length(b_word) OR a_word < b_word")
        # The part that holds the first difference reports the pair, so it comes once.
        met = met.where("substring(a_word, 1, a_high) <> substring(b_word, 1, a_high)")
        met = met.where(F.levenshtein("a_word", "b_word", 1) == 1).select(F.col("a_word").alias("a"), "a_n", F.col("b_word").alias("b"), "b_n")
        found = met if found is None else found.union(met)
        if not split:
            return found
        middle = (F.col("low") + (F.col("high") - F.col("low")) / 2).cast("int")
        finer = F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))).alias("part")
        chunks = chunks.join(hot, "key", "left_semi").select("word", "n", "size", finer).select("word", "n", "size", "part.*")
        grams = grams.join(hot, "key", "left_semi").select("word", "n", "size", "shift", finer).select("word", "n", "size", "part.*", "shift")


def last_forms(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``): the word at the end of each chain of ``word`` to ``form``.

    Every round doubles the step. Forms lead to ever larger counts, so there are no
    cycles, and chains are as long as counts have digits.
    """
    steps = saved(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if moved.where("moved").isEmpty():
            return steps
        steps = moved.select("word", "root")


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """Variants of each word, and the word that it stands for.

    ``words`` holds distinct ``word`` and its count ``n``. Returns ``word``, ``form``
    (the near word of largest ``n``, of equal ones the smallest, if it comes
    ``factor`` times as often; else null), ``root`` (the end of the chain of forms,
    the word itself without one), ``n``, ``n_near`` and ``form_n``.
    """
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.union(pairs.select(F.col("b"), F.col("a"), F.col("a_n")))
    best = both.groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.count("*").alias("n_near"))
    joined = words.join(best, "word", "left").withColumn("form_n", F.when(-F.col("best.less") >= factor * F.col("n"), -F.col("best.less")))
    joined = saved(joined.select("word", "n", F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")), "near-words")
    roots = last_forms(joined.where("form IS NOT NULL"))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_count: int = 2) -> DataFrame:
    """Spelling variants among the words of all documents (see ``group_variants``).

    Words are the distinct results of ``damaged_words`` with at least 7 code points
    that occur at least ``least_count`` times; counts are combined before the shuffle.
    A null text has no words; a null id counts as an empty one. Repeated rows count
    each. A word may be as long as its text. Columns other than id and text are not
    read. An empty table gives no rows.
    """
    words = damaged_words(docs, id_column, text_column).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return group_variants(saved(words, "words"))
