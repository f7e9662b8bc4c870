"""Harmonic packing of tokenised documents into sequences of fixed capacity.

Lengths fall into reciprocal-capacity classes: class k holds pieces longer than C/(k+1) and up
to C/k, and a bin of class k takes exactly k of them, whatever their lengths. A document is cut
into whole capacities and a rest; a rest that would leave its class's bins emptier than ``fill``
gives up a piece of the next exact reciprocal, C/(k+1), until what is left fits well.

1. Each task fills bins for its own rows; only the open bin of each class is left over.
2. Leftovers get a number within their class from the counts of the tasks before them, and fill
   bins again by that number.
3. What then remains is less than one bin of each class (at most 127 classes and about 21,000
   pieces, whatever the input). One task packs it by best fit.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each by
itself; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from curbside.llm.common import written
from curbside.llm.wordcache import word_tokenizer

CAPACITY = 4096
END = 2
FILL = 0.97
#: Rests shorter than capacity / FINE are never cut: their classes are full enough.
FINE = 64

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("class", T.IntegerType()),
        T.StructField("worker", T.IntegerType()),
        T.StructField("number", T.LongType()),
    ]
)
OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@lru_cache(maxsize=1 << 16)
def rest_lengths(rest: int, capacity: int, fill: float) -> tuple[int, ...]:
    """Lengths of the pieces of a rest shorter than the capacity."""
    out = []
    while rest:
        k = capacity // rest
        if rest * FINE <= capacity or k * rest >= fill * capacity:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return tuple(out)


def piece_lengths(n: int, capacity: int, fill: float) -> list[int]:
    whole, rest = divmod(n, capacity)
    return [capacity] * whole + list(rest_lengths(rest, capacity, fill))


def first_level(docs: DataFrame, tokenizer: str, capacity: int, fill: float, end: int) -> DataFrame:
    """Pieces of each document; those of filled bins have their sequence and offset."""
    arrow = to_arrow_schema(PIECE)
    stop = int(end).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, bins = TaskContext.get().partitionId(), 0
        encode = word_tokenizer(tokenizer).id_bytes
        waiting: dict[int, list[tuple]] = {}
        done: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + stop
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, capacity, fill):
                    k = capacity // length
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    held = waiting.setdefault(k, [])
                    held.append((doc, start, length, crc, n))
                    start += length
                    if len(held) == k:
                        at = 0
                        for piece in held:
                            done.append((*piece, ((worker + 1) << 36) + bins, at, k, worker, None))
                            at += piece[2]
                        bins += 1
                        held.clear()
            if done:
                yield as_batch(done, arrow)
                done = []
        left = [
            (*piece, None, None, k, worker, number)
            for k, held in waiting.items()
            for number, piece in enumerate(held)
        ]
        yield as_batch(left, arrow)

    return docs.mapInArrow(pack, PIECE)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def best_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sequence and offset of the bounded rest: longest first, each into the fullest bin that
    has room."""
    pieces = pieces.sort_values(
        ["length", "worker", "class", "number"], ascending=[False, True, True, True]
    ).reset_index(drop=True)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    level = np.zeros(capacity + 1, dtype=np.int64)
    used: list[int] = []
    sequence, offset = [], []
    for length in pieces["length"].tolist():
        fits = np.flatnonzero(level[length:])
        if len(fits):
            space = length + int(fits[0])
            b = room[space].pop()
            level[space] -= 1
        else:
            b = len(used)
            used.append(0)
        sequence.append(-(1 << 61) - b)
        offset.append(used[b])
        used[b] += length
        left = capacity - used[b]
        room[left].append(b)
        level[left] += left > 0
    return pieces.assign(sequence_id=sequence, offset=offset)


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    fill: float = FILL,
    end: int = END,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; see the module text."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = written(first_level(source, tokenizer, capacity, fill, end), "packing")
    left = first.filter(F.col("sequence_id").isNull())
    counts = left.groupBy("worker", "class").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("worker").alias("w"),
        F.col("class").alias("c"),
        (F.sum("n").over(W.partitionBy("class").orderBy("worker")) - F.col("n")).alias("before"),
        F.sum("n").over(W.partitionBy("class")).alias("total"),
    )
    k = F.col("class")
    numbered = (
        left.join(before, (F.col("worker") == F.col("w")) & (k == F.col("c")))
        .withColumn("index", F.col("before") + F.col("number"))
        .withColumn("bin", F.floor(F.col("index") / k))
    )
    full = F.col("bin") < F.floor(F.col("total") / k)
    in_bin = W.partitionBy("class", "bin").orderBy("index")
    second = numbered.filter(full).select(
        *OUT[:5],
        (-(F.shiftleft(k.cast("long"), 44) + F.col("bin")) - 1).alias("sequence_id"),
        (F.sum("length").over(in_bin) - F.col("length")).alias("offset"),
    )
    rest = numbered.filter(~full).select(*PIECE.names)

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = list(batches)
        if pieces:
            yield best_fit(pd.concat(pieces), capacity)[PIECE.names]

    third = rest.repartition(1).mapInPandas(pool, PIECE)
    return (
        first.filter(F.col("sequence_id").isNotNull())
        .select(*OUT)
        .unionAll(second.select(*OUT))
        .unionAll(third.select(*OUT))
    )
