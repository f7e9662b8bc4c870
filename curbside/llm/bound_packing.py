"""Bound-certified packing of tokenised documents into as few sequences as possible.

1. Each task tokenises its documents, cuts those longer than a sequence and packs its pieces by
   best-fit decreasing, a part of at most ``PART_PIECES`` pieces at a time.
2. Dual-feasible functions give a lower bound of the number of sequences for each part's lengths.
   A part that meets its bound is certified: no packing of these pieces needs fewer.
3. A part with a gap releases its sequences that are not full; a certified one only its emptiest
   one, so that the rounding up of its bound is not paid for in every part. Released sequences of
   all parts are dealt to new parts by a hash of the sequence, and best-fit decreasing runs again
   over their pieces. A new packing is taken where it is smaller; so no exchange makes it worse.
4. After ``ROUNDS`` exchanges, or when one part held all that was released, the packing stands.

Only numbers move: a piece is its document, place and check sum. Parts are bounded, and their
number grows with the input; no part follows a key, so no key can make one large.

Defined cases: a null or empty text is its end id alone; repeated rows and null ids are packed
each by itself; a text longer than a sequence is cut into whole sequences after a first piece
that takes the remainder; equal lengths are placed in the order read; an empty table gives no
piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curbside.llm.bytecache import byte_tokenizer
from curbside.llm.common import written

CAPACITY = 2048
END = 0
PART_PIECES = 100_000
ROUNDS = 3
#: Staircase functions x -> floor((k + 1) x / C) / k for k up to this.
STAIRS = 100

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("released", T.BooleanType()),
    ]
)
OUT = PIECE.names[:-1]


def cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that ``counts[x]`` pieces of each length x can need, the largest value
    that two families of dual-feasible functions prove.

    Thresholds: for a up to C/2, lengths over C - a count as C and those under a as nothing.
    Stairs: for each k, a length counts as floor((k + 1) x / C) parts of k, or as itself where
    (k + 1) x / C is whole.
    """
    counts = counts.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    number = np.concatenate(([0], np.cumsum(counts)))  # of lengths below
    total = np.concatenate(([0], np.cumsum(counts * x)))
    a = np.arange(capacity // 2 + 1)
    large = number[capacity + 1] - number[capacity - a + 1]
    middle = total[capacity - a + 1] - total[a]
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    for k in range(1, STAIRS + 1):
        steps, rest = np.divmod((k + 1) * x, capacity)
        value = int((np.where(rest == 0, k * x, steps * capacity) * counts).sum())
        best = max(best, -(-value // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, each into the fullest bin with room."""
    at = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    open_ = 0  # bit f is set where a bin has f free
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fits = open_ >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = bins[free].pop()
            if not bins[free]:
                open_ ^= 1 << free
        else:
            free, b = capacity, n
            n += 1
        at[i], offset[i] = b, capacity - free
        left = free - length
        if left:
            if not bins[left]:
                open_ |= 1 << left
            bins[left].append(b)
    return at, offset


def released(at: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pieces that go on to the next exchange: see the module text."""
    load = np.bincount(at, weights=lengths).astype(np.int64)
    n = int((load > 0).sum())
    counts = np.bincount(lengths, minlength=capacity + 1)
    if n > lower_bound(counts, capacity):
        goes = load < capacity
    else:
        least = int(np.argmin(np.where(load > 0, load, capacity + 1)))
        goes = (np.arange(len(load)) == least) & (load < capacity)
    return goes[at]


def first_parts(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """Pieces of all documents, packed part by part."""
    arrow = to_arrow_schema(PIECE)
    stop = int(end).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(tokenizer).id_bytes
        task, part = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def packed_part() -> pa.RecordBatch:
            doc, piece, start, length, crc = zip(*held, strict=True) if held else ((),) * 5
            lengths = np.array(length, dtype=np.int64)
            at, offset = best_fit_decreasing(lengths, capacity)
            sequence = at + (task << 39 | part << 17)
            goes = released(at, lengths, capacity) if held else at.astype(bool)
            columns = (doc, piece, start, length, crc, sequence, offset, goes)
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                ids = memoryview((encode(text) if text else b"") + stop)
                start = 0
                for piece, length in enumerate(cuts(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    held.append((doc.as_py(), piece, start, length, crc))
                    start += length
                    if len(held) >= PART_PIECES:
                        yield packed_part()
                        held, part = [], part + 1
        yield packed_part()

    return docs.mapInArrow(pack, PIECE)


def exchanged(pieces: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Released sequences dealt to ``parts`` parts, each packed anew where that saves one."""

    def pack(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        lengths = table["length"].to_numpy()
        before = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)[1]
        at, offset = best_fit_decreasing(lengths, capacity)
        table = table.drop_columns(["part"])
        if at.max() < before.max():
            sequence = at + (turn << 61 | part << 24)
            columns = {"sequence_id": sequence, "offset": offset}
            for name, values in columns.items():
                table = table.set_column(table.column_names.index(name), name, pa.array(values))
        else:
            at = before
        goes = pa.array(released(at, lengths, capacity))
        return table.set_column(table.column_names.index("released"), "released", goes)

    part = F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(parts))
    dealt = pieces.withColumn("part", part)
    return dealt.groupBy("part").applyInArrow(pack, PIECE)


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; see the module text."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    now = written(first_parts(source, tokenizer, capacity, end), "bound-packing")
    stays = []
    for turn in range(1, ROUNDS + 1):
        stays.append(now.filter(~F.col("released")))
        goes = now.filter("released")
        parts = -(-goes.count() // PART_PIECES)
        if not parts:
            now = goes
            break
        now = written(exchanged(goes, parts, turn, capacity), "bound-packing")
        if parts == 1:
            break
    for more in stays:
        now = now.unionAll(more)
    return now.select(*OUT)


def certificate(pieces: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Sequences of a packing, and the fewest that its lengths can need. The driver gets one count
    for each length up to the capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    n = pieces.filter("offset = 0").count()
    return {"sequences": n, "bound": lower_bound(counts, capacity)}
