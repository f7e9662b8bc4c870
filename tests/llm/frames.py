"""Small document tables for the corpus tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, "
    "node string, hash string"
)


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Documents of (doc_id, text[, lang, source]), with extra columns whose names clash with
    those that operators use."""
    full = []
    for row in rows:
        doc, text, lang, source = (*row, None, None)[:4]
        full.append((doc, text, lang, source, None if text is None else len(text), "x", "y", "z", "w"))
    return spark.createDataFrame(full, SCHEMA)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long_text = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [
        (None, None, None, None),
        (None, "a text without an id that is long enough for a window of ten words here", "en", None),
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \n\t ", None, "b"),
        (4, "one", "en", "b"),
        (5, "one", "en", "b"),
        (5, "one", "en", "b"),
        (6, long_text, "en", None),
        (7, long_text, "en", "c"),
        (8, "é́ 日本語 \U0001f600 ÀÉ ﬁ", "ja", "c"),
        (1 << 60, "an id beyond the exact doubles", "en", "c"),
    ]


def prose(seed: int, n: int) -> str:
    words = random.Random(seed)
    return " ".join("".join(words.choices("abcdefghij", k=words.randint(2, 8))) for _ in range(n))
