"""Quality rules with cross-document line frequency.

One pass turns every document into its base figures and the hashes of its normalised lines.
Lines are then counted per host: the number of distinct documents (copies of one text count
as one document) that hold the line. A line in more than ``limit`` documents of its host is
boilerplate and is removed from all documents but the first that holds it, so that one copy of
everything stays. A document that loses too much is depleted and rejected.

Counting combines on the map side, in two steps: (host, line, text) and then (host, line), so
a line that a third of all documents hold is never gathered. The list of frequent lines joins
back salted, since one of its keys can have any number of documents.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its
own; repeated rows get the same verdict each; lines without a word are never counted or
removed; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import map_batches, transposed, utf8, written

LIMIT = 20
MIN_WORDS = 50
MIN_SHARE = 0.5
SALTS = 16

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

FIGURES = (
    "row long, doc_id long, host string, text_hash long, n_words long, word_chars long, "
    "n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, "
    "line_words array<long>"
)
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def hash64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def figures(text: str | None) -> tuple:
    """Base figures, line hashes and words per line of one text."""
    data = utf8(text)
    words = data.split()
    spaces = len(data) - len(data.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    repeats, lines, sizes = 0, [], []
    for line in data.split(b"\n"):
        inside = line.lower().split()
        if inside:
            repeats += line in seen
            seen.add(line)
            lines.append(hash64(b" ".join(inside)))
            sizes.append(len(inside))
    n_chars = len(text) if text else 0
    return (
        hash64(data), len(words), n_chars - spaces, symbols, repeats, repeat_words(words),
        lines, sizes,
    )


def line_table(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    source = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.col(text).alias("text"),
    )
    names = ["text_hash", *BASE, "lines", "line_words"]

    def measure(batch: pa.RecordBatch) -> dict:
        rows = [figures(t) for t in batch.column("text").to_pylist()]
        same = {c: batch.column(c) for c in ("row", "doc_id", "host")}
        return transposed(rows, names) | same

    return written(map_batches(source, FIGURES, measure), "lines")


def frequent_lines(table: DataFrame, limit: int) -> DataFrame:
    """Lines above the limit in their host, with the document that keeps them: the first by
    (doc_id, text)."""
    lines = table.select(
        "host", "text_hash", "doc_id", F.explode(F.array_distinct("lines")).alias("line")
    )
    texts = lines.groupBy("host", "line", "text_hash").agg(F.min("doc_id").alias("doc_id"))
    return (
        texts.groupBy("host", "line")
        .agg(
            F.count("*").alias("n_docs"),
            F.min(F.struct("doc_id", "text_hash")).alias("keeper"),
        )
        .filter(F.col("n_docs") > limit)
    )


def line_quality(
    docs: DataFrame,
    limit: int = LIMIT,
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
) -> DataFrame:
    """Verdict of each document: base figures, ``n_removed_words``, ``removed`` (hashes of the
    lines removed from it) and ``kept``; ``text_hash`` tells rows with one id apart."""
    table = line_table(docs, doc_id, text, host)
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    lines = table.select(
        "row", "host", "doc_id", "text_hash", salt.alias("salt"),
        F.explode(F.arrays_zip("lines", "line_words")).alias("l"),
    ).select("row", "host", "doc_id", "text_hash", "salt", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))  # fmt: skip  # noqa: E501
    frequent = frequent_lines(table, limit).select(
        F.col("host").alias("f_host"),
        F.col("line").alias("f_line"),
        "keeper",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("f_salt"),
    )
    removed = (
        lines.join(
            frequent,
            lines.host.eqNullSafe(frequent.f_host)
            & (lines.line == frequent.f_line)
            & (lines.salt == frequent.f_salt),
        )
        .filter(
            ~(
                F.col("doc_id").eqNullSafe(F.col("keeper.doc_id"))
                & (F.col("text_hash") == F.col("keeper.text_hash"))
            )
        )
        .groupBy("row")
        .agg(F.sum("words").alias("n_removed_words"), F.collect_set("line").alias("removed"))
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & (
        (left < min_words) | (left < min_share * F.col("n_words"))
    )
    return (
        table.drop("lines", "line_words")
        .join(removed, "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & ~depleted)
        .select("doc_id", *BASE, "base_failed", "kept", "n_removed_words", "removed", "text_hash")
    )


def quality_filtered(docs: DataFrame, **rules) -> DataFrame:
    """The kept documents with their columns; ``text`` is without the lines removed and
    ``n_chars``, if there, counts what is left of a changed text."""
    verdict = line_quality(docs, **rules)
    kept = (
        verdict.filter("kept")
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("removed").alias("__removed"))  # noqa: E501
        .dropDuplicates(["__id", "__hash"])
    )
    keyed = with_text_hash(docs)
    kept = kept.hint("merge")  # grows with the documents
    joined = keyed.join(
        kept, keyed.doc_id.cast("long").eqNullSafe(kept["__id"]) & (keyed["__h"] == kept["__hash"])
    )
    hashes = F.col("__lines")
    lines = F.split("text", "\n", -1)
    keep_line: Column = F.filter(
        F.arrays_zip(lines.alias("line"), hashes.alias("hash")),
        lambda x: ~F.coalesce(F.array_contains(F.col("__removed"), x["hash"]), F.lit(False)),
    )
    changed = F.size(F.coalesce("__removed", F.array().cast("array<long>"))) > 0
    new_text = F.when(changed, F.array_join(F.transform(keep_line, lambda x: x["line"]), "\n")).otherwise(F.col("text"))  # noqa: E501
    out = joined.withColumn("__new", new_text)
    columns = [
        F.col("__new").alias(c) if c == "text"
        else F.when(changed, F.char_length("__new").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars"  # noqa: E501
        else F.col(c)
        for c in docs.columns
    ]
    return out.select(*columns)


def with_text_hash(docs: DataFrame) -> DataFrame:
    """Documents with the hash of the text and of each of its lines (null: no word)."""

    def line_hashes(text: bytes) -> list[int | None]:
        inside = (line.lower().split() for line in text.split(b"\n"))
        return [hash64(b" ".join(words)) if words else None for words in inside]

    def add(batch: pa.RecordBatch) -> dict:
        texts = [utf8(t) for t in batch.column("text").to_pylist()]
        same = {c: batch.column(i) for i, c in enumerate(docs_columns)}
        return same | {"__h": [hash64(t) for t in texts], "__lines": [line_hashes(t) for t in texts]}

    docs_columns = docs.columns
    more = [T.StructField("__h", T.LongType()), T.StructField("__lines", T.ArrayType(T.LongType()))]
    return map_batches(docs, T.StructType([*docs.schema.fields, *more]), add)
