"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents (the rows of one task batch) is turned into word numbers and a
suffix array: the word positions, sorted by the words that follow. Every suffix of the
benchmark is then looked up in the array by binary search, which gives the places where it
occurs word for word. Runs of neighbouring places give the longest verbatim match. Documents
never leave their task, so nothing is shuffled.

The benchmark is what each task holds. It is loaded in parts of at most ``PART_BYTES`` as built;
with one part (the usual case) a document is answered where it is read. With more parts each
part is searched by itself and the places found are united per document. Parts are cut by item,
whole, so the same windows are searched in both cases.

Defined cases: a null or wordless text has no words and is never hit; an item without words
has no window; an item without id marks words but is not listed; repeated rows are answered
each by itself; an empty benchmark hits nothing; other columns are kept out of the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbside.llm.common import map_batches, plain_words, split_runs, transposed, written

WINDOW = 10
#: Bytes of the arrays and words built of a benchmark part that one task may hold, an upper
#: estimate: the word numbers of a window, a place and its offset for each word, and each different word.
PART_BYTES = 128 << 20
PLACE_BYTES = 16
WORD_BYTES = 120
#: Words of a shard. Larger batches are cut into shards of whole documents.
SHARD_WORDS = 2_000_000

VERDICT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("longest_match", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


@dataclass
class Windows:
    """Distinct benchmark windows of one length, sorted, with the places they come from."""

    length: int
    keys: np.ndarray
    first: np.ndarray  # offsets into item and at, one more than keys
    item: np.ndarray
    at: np.ndarray


class Benchmark:
    """Suffixes of one part of a benchmark, ready to be searched."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        numbers = [
            np.array(
                [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(t)],
                dtype=np.int64,
            )
            for _, t in items
        ]
        sizes = np.array([len(n) for n in numbers], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        words = np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(">u4")
        self.tables = []
        for size in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            held = np.flatnonzero(sizes >= window if size == window else sizes == size)
            counts = sizes[held] - size + 1
            item, at = np.repeat(held, counts), split_runs(counts)
            rows = np.lib.stride_tricks.sliding_window_view(words, size)[starts[item] + at]
            keys, group = np.unique(as_keys(rows), return_inverse=True)
            order = np.argsort(group, kind="stable")
            first = np.searchsorted(group[order], np.arange(len(keys) + 1))
            self.tables.append(
                Windows(size, keys, first, item[order].astype(np.int32), at[order].astype(np.int32))
            )

    def search(self, tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Windows]]:
        """(length, word position, window number, table) of every occurrence in a shard.

        ``tokens``: word numbers, 0 for words that no item has and between documents.
        """
        if not self.tables:
            return
        n = len(tokens)
        stops = np.append(np.flatnonzero(tokens == 0), n)
        room = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        suffixes = np.flatnonzero(room >= self.tables[0].length)
        if not len(suffixes):
            return
        padded = np.concatenate([tokens, np.zeros(self.window, dtype=np.int64)])
        keys = as_keys(padded[suffixes[:, None] + np.arange(self.window)])
        order = np.argsort(keys, kind="stable")
        keys, suffixes = keys[order], suffixes[order]
        for table in self.tables:
            width = 4 * table.length
            prefix = keys if table.length == self.window else keys.astype(f"S{width}")
            low = np.searchsorted(prefix, table.keys, "left")
            count = np.searchsorted(prefix, table.keys, "right") - low
            place = suffixes[np.repeat(low, count) + split_runs(count)]
            yield table.length, place, np.repeat(np.arange(len(table.keys)), count), table


def as_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort as the rows do."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel()


def spans_of(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, alternating."""
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edges)


def longest_runs(n_docs: int, doc, item, at, place, length) -> np.ndarray:
    """Longest verbatim match in words of each document: occurrences that follow each other in
    both the document and the item."""
    best = np.zeros(n_docs, dtype=np.int64)
    if not len(doc):
        return best
    order = np.lexsort((place, place - at, item))
    doc, item, at, place, length = (x[order] for x in (doc, item, at, place, length))
    same = (np.diff(item) == 0) & (np.diff(place - at) == 0) & (np.diff(place) == 1)
    start = np.concatenate([[0], np.flatnonzero(~same) + 1])
    size = np.diff(np.append(start, len(doc))) - 1 + length[start]
    np.maximum.at(best, doc[start], size)
    return best


def search_shard(bench: Benchmark, words: list[list[bytes]]) -> list[tuple]:
    """(n_words, hit spans, longest match, item numbers) of each document."""
    get = bench.vocabulary.get
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    tokens = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    for s, w in zip(starts.tolist(), words, strict=True):
        tokens[s : s + len(w)] = [get(x, 0) for x in w]
    edge = np.zeros(len(tokens) + 1, dtype=np.int64)
    found = []
    for length, place, which, table in bench.search(tokens):
        np.add.at(edge, place, 1)
        np.add.at(edge, place + length, -1)
        count = np.diff(table.first)[which]
        source = np.repeat(table.first[which], count) + split_runs(count)
        place = np.repeat(place, count)
        found.append((place, table.item[source], table.at[source], np.full(len(place), length)))
    hit = np.cumsum(edge[:-1]) > 0
    empty = np.zeros(0, dtype=np.int64)
    place, item, at, length = (
        (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty,) * 4
    )
    doc = np.searchsorted(starts, place, "right") - 1
    longest = longest_runs(len(words), doc, item, at, place, length)
    pairs = np.unique(np.stack([doc, item]), axis=1)
    cut = np.searchsorted(pairs[0], np.arange(len(words) + 1))
    return [
        (n, spans_of(hit[s : s + n]), int(longest[d]), pairs[1][cut[d] : cut[d + 1]])
        for d, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True))
    ]


def searched(bench: Benchmark, texts: list) -> list[tuple]:
    out, shard, held = [], [], 0
    for text in texts:
        shard.append(plain_words(text))
        held += len(shard[-1])
        if held >= SHARD_WORDS:
            out += search_shard(bench, shard)
            shard, held = [], 0
    return out + search_shard(bench, shard) if shard else out


def verdict_row(n: int, spans: np.ndarray, longest: int, names: list[str]) -> tuple:
    hits = int((spans[1::2] - spans[::2]).sum())
    names = sorted(set(names))
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return n, hits, len(names), digest, hits > 0, longest, spans.tolist(), names


def benchmark_parts(benchmark: DataFrame, item: str, text: str, window: int, limit: int):
    """The benchmark in parts of at most ``limit`` bytes as built. One item above the limit is a
    part by itself. At most two parts at a time are on the driver."""
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t"))
    held, part, known = 0, [], set()
    for row in items.toLocalIterator():
        words = plain_words(row.t)
        new = set(words) - known
        size = (4 * window + PLACE_BYTES) * len(words) + sum(WORD_BYTES + len(w) for w in new)
        if part and held + size > limit:
            yield Benchmark(part, window)
            held, part, known = 0, [], set()
            size = (4 * window + PLACE_BYTES) * len(words) + sum(WORD_BYTES + len(w) for w in set(words))
            new = set(words)
        part.append((row.i, row.t))
        known |= new
        held += size
    yield Benchmark(part, window)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """What of each document occurs in the benchmark; see the module text. ``hit_spans`` holds
    word positions, start and end alternating; ``longest_match`` is in words."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = benchmark_parts(benchmark, item, item_text, window, part_bytes)
    bench, second = next(parts), next(parts, None)
    if second is None:

        def answer(batch: pa.RecordBatch) -> dict:
            rows = [
                verdict_row(n, spans, longest, [m for i in items if (m := bench.names[i])])
                for n, spans, longest, items in searched(bench, batch.column("text").to_pylist())
            ]
            return transposed(rows, VERDICT.names[1:]) | {"doc_id": batch.column("doc_id")}

        return map_batches(source, VERDICT, answer)
    return _united(source, chain((bench, second), parts))


def _united(source: DataFrame, parts: Iterator[Benchmark]) -> DataFrame:
    """Several parts: places found by each are written before the next is loaded, then united
    per document."""
    keyed = written(source.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    found_type = (
        "row long, doc_id long, n_words long, longest long, "
        "spans array<long>, item_ids array<string>"
    )

    def finder(bench: Benchmark):
        def find(batch: pa.RecordBatch) -> dict:
            rows = [
                (n, longest, spans.tolist(), [m for i in items if (m := bench.names[i])])
                for n, spans, longest, items in searched(bench, batch.column("text").to_pylist())
            ]
            return transposed(rows, ["n_words", "longest", "spans", "item_ids"]) | {
                "doc_id": batch.column("doc_id"),
                "row": batch.column("row"),
            }

        return find

    searches = (map_batches(keyed, found_type, finder(bench)) for bench in parts)
    found = reduce(DataFrame.unionAll, (written(search, "places") for search in searches))
    grouped = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.max("longest").alias("longest"),
        F.collect_list("spans").alias("spans"),
        F.flatten(F.collect_list("item_ids")).alias("item_ids"),
    )

    def unite(batch: pa.RecordBatch) -> dict:
        rows = []
        for r in batch.to_pylist():
            hit = np.zeros(r["n_words"], dtype=bool)
            for spans in r["spans"]:
                for start, end in zip(spans[::2], spans[1::2], strict=True):
                    hit[start:end] = True
            rows.append(verdict_row(len(hit), spans_of(hit), r["longest"], r["item_ids"]))
        return transposed(rows, VERDICT.names[1:]) | {"doc_id": batch.column("doc_id")}

    return map_batches(grouped, VERDICT, unite)


def decontaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns. Each part of
    the benchmark filters what the parts before it left, which is written in between; nothing is
    shuffled."""
    schema = docs.schema

    def free_of(docs: DataFrame, bench: Benchmark) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = searched(bench, batch.column(text).to_pylist())
                yield batch.filter(pa.array([len(x[1]) == 0 for x in found], type=pa.bool_()))

        return docs.mapInArrow(keep, schema)

    parts = benchmark_parts(benchmark, "item_id", "text", window, part_bytes)
    docs = free_of(docs, next(parts))
    for bench in parts:
        docs = free_of(written(docs, "decontaminate"), bench)
    return docs
