"""Token files: one id array over all documents, with Elias-Fano document boundaries.

The documents are range-partitioned and sorted by id; each task encodes its range into segments
of bounded size. A segment is a self-contained binary image (layout below). Segments lie in a
Parquet table as binary values, so that Spark's commit protocol writes them, any shared store
can hold them, and a lost executor costs a task. The id width is 2 bytes if all ids of the
segment fit, else 4.

Segment, little-endian: magic ``EFT1``; id width (u8); documents, documents without id (they
come first), ids (u64 each); smallest document id (i64); Elias-Fano sequence of the document
ids less the smallest; Elias-Fano sequence of the boundaries (documents + 1 values from 0);
the ids.

Defined cases: a null or empty text is its end id alone; rows with one id are all written,
ordered by text; a very long text is a segment of its own; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from curbside.llm.common import map_batches
from curbside.llm.elias_fano import STEP, Sequence, encode
from curbside.llm.wordcache import word_tokenizer

END = 2
#: Ids of a segment; a longer document is a segment of its own.
SEGMENT = 1 << 20
MAGIC = b"EFT1"
HEAD = struct.Struct("<4sBQQQq")

FILES = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("number", T.IntegerType()),
        T.StructField("start_in_shard", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("segment", T.BinaryType()),
    ]
)


def segment_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """Documents (those without id first, then ascending) and their ids as one segment."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    base = int(known[0]) if len(known) else 0
    tokens = np.frombuffer(b"".join(ids), dtype="<u4")
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    width = 2 if not len(tokens) or int(tokens.max()) < 1 << 16 else 4
    head = HEAD.pack(MAGIC, width, len(ids), len(ids) - len(known), len(tokens), base)
    return b"".join([head, encode(known - base), encode(ends), tokens.astype(f"<u{width}").tobytes()])


class Segment:
    """Random access to the documents of a segment."""

    def __init__(self, data: bytes):
        magic, width, self.n_docs, self.n_unnamed, self.n_tokens, self.base = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        view = memoryview(data)
        self.names = Sequence(view[HEAD.size :])
        at = HEAD.size + self.names.size
        self.ends = Sequence(view[at:])
        self.tokens = np.frombuffer(data, f"<u{width}", self.n_tokens, at + self.ends.size)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_unnamed else self.base + self.names.select(i - self.n_unnamed)

    def ids(self, i: int) -> np.ndarray:
        """Ids of document number i, found with two select operations."""
        return self.tokens[self.ends.select(i) : self.ends.select(i + 1)]

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Ids of the documents and their boundaries (one more), by selects of a block of documents
        at a time: the boundaries of a segment are never expanded as a whole."""
        unnamed = repeat(None, self.n_unnamed)
        names = chain(unnamed, chain.from_iterable((self.base + b).tolist() for b in self.names.blocks()))
        for first in range(0, self.n_docs, STEP):
            ends = self.ends.block(first // STEP)
            after = first + len(ends)
            if after < len(self.ends):
                ends = np.append(ends, self.ends.select(after))
            yield list(islice(names, len(ends) - 1)), ends


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int = END,
    segment: int = SEGMENT,
    doc_id: str = "doc_id",
    text: str = "text",
) -> None:
    """Write the ids of all documents, in ascending order of their id, as token files."""
    arrow = to_arrow_schema(FILES)
    stop = int(end).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        encode_text = word_tokenizer(tokenizer).id_bytes
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal number, start, size
            row = (shard, number, start, len(held), size, segment_bytes(names, held))
            number, start, size = number + 1, start + size, 0
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow
            )

        for batch in batches:
            for name, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = (encode_text(t) if t else b"") + stop
                if held and size + len(ids) // 4 > segment:
                    yield full()
                names.append(name)
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield full()

    (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        # By the start of the text too, so that an id of very many rows is dealt to several tasks;
        # the sample that finds the ranges holds no more of the texts than that.
        .repartitionByRange("doc_id", F.substring("text", 1, 16))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(write, FILES)
        .write.parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Each document of token files: doc_id, start (ids of all documents before it), n_tokens
    and ids_crc32. Starts need only the totals of the shards, of which there are as many as
    tasks wrote."""
    files = spark.read.schema(FILES).parquet(path)

    def decode(batch: pa.RecordBatch) -> Iterator[dict]:
        for shard, start, data in zip(
            batch["shard"].to_pylist(), batch["start_in_shard"].to_pylist(), batch["segment"],
            strict=True,
        ):
            part = Segment(data.as_py())
            for names, ends in part.documents():
                wide = memoryview(part.tokens[ends[0] : ends[-1]].astype("<u4").tobytes())
                places = (4 * (ends - ends[0])).tolist()
                yield {
                    "shard": [shard] * len(names),
                    "doc_id": names,
                    "local": start + ends[:-1],
                    "n_tokens": np.diff(ends),
                    "ids_crc32": [zlib.crc32(wide[a:b]) for a, b in pairwise(places)],
                }

    decoded = map_batches(
        files.select("shard", "start_in_shard", "segment"),
        "shard int, doc_id long, local long, n_tokens long, ids_crc32 long",
        decode,
    )
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    starts = totals.select(
        F.col("shard").alias("s"),
        (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"),
    )
    return decoded.join(starts, F.col("shard") == F.col("s")).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
