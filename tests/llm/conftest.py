from __future__ import annotations

import pytest

# Names that operators use inside; input columns of these names must not disturb them.
CLASHING = "id row part size start shard slot skey block words pass h t1 t2 packed hints rid n root label key own i j chars links start_ finish found score".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog and then runs home to eat some bread with honey".split()


def long_text(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + k * k) % len(WORDS)]}{(seed * 31 + k) % 97}" for k in range(n))


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (4, "one", "en", "b", 3),
    (4, "one", "en", "b", 3),
    (None, "two words", None, "b", None),
    (None, None, None, None, None),
    (5, long_text(1, 400), "en", "a", 1),
    (6, long_text(1, 400), "fr", None, 1),
    (7, long_text(1, 400) + " more", "en", "c", 1),
    (8, "été ß \x00 🙂 中文 " * 30, "de", "c", 1),
    (9, "x" * 3000, "en", "c", 1),
    (10, long_text(2, 6000), "en", "a", 1),
    (-3, "line\nline\nline\n" * 20, "en", "é", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
