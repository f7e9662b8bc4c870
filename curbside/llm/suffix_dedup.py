"""Removal of repeated passages with a distributed, difference-cover suffix sort.

Suffixes are compared by their first ``LENGTH`` bytes only, which is all that the result needs.
The cover {3, 6, 7, 12, 14} modulo 21 has the property that for any two places in any two
documents there is a shift below 21 that takes both to sampled places. So two equal strings of 50
bytes hold two aligned sampled tuples of 30 bytes.

1. Documents are put into blocks of a few megabytes, stored in a table bucketed by block, so that
   later steps bring what is known of a block to the block, not the other way round.
2. Copies of an earlier document are found by their digests. They go as a whole, and send no
   names: whatever they hold, the earlier document holds.
3. Sampled tuples get names (fingerprints). Each block sends its distinct names, sorted and
   delta-coded, to the name's range; there names of several blocks are found by comparing
   neighbours, and one bit a name goes back. Names of one document only drop out here.
4. The remaining suffixes are merged in: a suffix whose next 21 places hold a repeated sampled
   name gets a 64-bit name of its 50 bytes. Again each block sends its distinct names, now with
   the first document that holds each, and gets back one bit: whether an earlier document of
   another block has the same prefix.
5. Each block removes the bytes covered by a prefix that an earlier document holds.

Ranks are replaced by fingerprints, since only equality of 50-byte prefixes matters and the
names of a full recursion would pass every suffix through several shuffles. A false match needs
two different 50-byte strings with one 64-bit fingerprint.

No group grows with a passage's frequency: a block sends a name once, however often the block
holds it, and a range holds names of bounded share.

Defined cases: a null text is empty; texts shorter than the length lose nothing; rows with one
id are one document for "earlier" and are answered each by itself; a row without id neither
loses nor removes anything; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from curbside.llm.bytehash import fingerprints, prefix_sums
from curbside.llm.common import scratch, split_runs, text_bytes, utf8, written

LENGTH = 50
#: A perfect difference cover of the residues modulo 21.
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
TUPLE = LENGTH - PERIOD + 1

#: Text of a block, in bytes; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Text whose sampled names share a range, in bytes.
RANGE_BYTES = 12 << 20
#: Spark's default bound on the buckets of a table; a bucket then holds more blocks.
MAX_BUCKETS = 100_000
#: Bits of a sampled name beyond those that count the bytes: names only filter, so about one in
#: 2^10 unrepeated names may pass.
SPARE_BITS = 10

BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("known", T.BinaryType()),
        T.StructField("sizes", T.BinaryType()),
        T.StructField("digests", T.BinaryType()),
        T.StructField("bytes", T.BinaryType()),
    ]
)
NAMES = "block long, part int, names binary, docs binary"
REPLY = "block long, part int, level int, bits binary"
OUT = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
    "removed array<long>"
)


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte plane, compressed; high planes of small numbers are
    almost free."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.uint64(0))


def sums(delta: np.ndarray) -> np.ndarray:
    return np.cumsum(delta, dtype=np.uint64)


def bits_bytes(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def bytes_bits(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.unpackbits(np.frombuffer(raw, np.uint8))[:n].astype(bool)


class Block:
    """Documents of a block in ascending order of id, with prefix sums of their bytes."""

    def __init__(self, ids: bytes, known: bytes, sizes: bytes, digests: bytes, data: bytes = b""):
        self.ids = np.frombuffer(ids, "<i8")
        self.known = np.frombuffer(known, np.uint8).astype(bool)
        self.sizes = np.frombuffer(sizes, "<i8")
        self.digests = np.frombuffer(digests, "<u8")
        #: Documents that can lose or remove something.
        self.sources = self.known & (self.sizes >= LENGTH)
        self.data = np.frombuffer(data, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        #: Ids without repetition and each row's number among them: rows with one id are one document.
        self.named, self.number = np.unique(self.ids, return_inverse=True)
        self.sums = prefix_sums(self.data)

    def first_copies(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct digests and the first document that has each."""
        if not self.sources.any():
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        distinct, first, _, _ = first_of_each(self.digests[self.sources], self.number[self.sources])
        return distinct, self.named[first]

    def drop_copies(self, earlier: np.ndarray) -> np.ndarray:
        """Documents that are copies of earlier ones, here or (``earlier``, by distinct digest)
        in other blocks; they are no sources from now on."""
        distinct, first = self.first_copies()
        copies = np.zeros(len(self.ids), dtype=bool)
        if len(distinct):
            where = np.flatnonzero(self.sources)
            at = np.searchsorted(distinct, self.digests[where])
            copies[where] = earlier[at] | (self.ids[where] > first[at])
        self.sources = self.sources & ~copies
        return copies

    def sampled(self) -> np.ndarray:
        """Sampled places whose tuple lies in a document long enough and with an id."""
        sizes = self.sizes[self.sources]
        if not len(sizes):
            return np.zeros(0, np.int64)
        places = (np.arange(0, sizes.max(), PERIOD)[:, None] + np.array(COVER)).ravel()
        counts = np.searchsorted(places, sizes - TUPLE, "right")
        return places[split_runs(counts)] + np.repeat(self.starts[self.sources], counts)

    def tuple_names(self, places: np.ndarray, bits: int) -> np.ndarray:
        return fingerprints(self.sums, places, places + TUPLE) >> np.uint64(64 - bits)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of 50-byte strings with a repeated sampled place in their first 21 bytes."""
        edge = np.zeros(len(self.data) + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(repeated - PERIOD + 1, self.of_rows(self.starts, repeated)), 1)
        np.add.at(edge, repeated + 1, -1)
        places = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32) > 0)
        return places[places + LENGTH <= self.of_rows(self.ends, places)]

    def of_rows(self, values: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The values of the rows that hold the places, which are ascending."""
        return np.repeat(values, np.diff(np.searchsorted(places, self.ends), prepend=0))


def first_of_each(
    names: np.ndarray, docs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names ascending, the first document of each, whether a later one has it, and
    where among the distinct names each name is."""
    order = np.argsort(names)
    names, docs = names[order], docs[order]
    new = np.concatenate([[True], names[1:] != names[:-1]])
    at = np.flatnonzero(new)
    first = np.minimum.reduceat(docs, at)
    where = np.empty(len(names), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return names[at], first, np.maximum.reduceat(docs, at) != first, where


def distinct_sorted(names: np.ndarray) -> np.ndarray:
    names = np.sort(names)
    return names[np.concatenate([[True], names[1:] != names[:-1]])] if len(names) else names


def ranges(names: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Cuts of ascending names into equal ranges of the name space."""
    width = -(-(1 << bits) // parts)
    bounds = np.array([p * width for p in range(1, parts)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(names, bounds), [len(names)]])


def make_blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Blocks of consecutive rows. A block is named by its content, so a task that runs again
    gives the same blocks."""
    arrow = to_arrow_schema(BLOCKS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def full() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is not None, x[0] or 0))
            ids = np.array([i or 0 for i, _ in held], dtype="<i8").tobytes()
            known = np.array([i is not None for i, _ in held], dtype=np.uint8).tobytes()
            sizes = np.array([len(t) for _, t in held], dtype="<i8").tobytes()
            digests = b"".join(hashlib.blake2b(t, digest_size=8).digest() for _, t in held)
            data = b"".join(t for _, t in held)
            digest = hashlib.blake2b(ids + known + sizes + data, digest_size=8).digest()
            row = (int.from_bytes(digest, "little", signed=True), ids, known, sizes, digests, data)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow
            )

        for batch in batches:
            for name, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = utf8(t)
                if held and size + len(data) > BLOCK_BYTES:
                    yield full()
                    held, size = [], 0
                held.append((name, data))
                size += len(data)
        if held:
            yield full()

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(build, BLOCKS)


def store_blocks(spark: SparkSession, blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks as a table bucketed by block in the shared folder."""
    path = scratch(spark, "blocks")
    table = "blocks_" + path.rpartition("-")[2]
    (
        blocks.write.bucketBy(buckets, "block")
        .option("path", path)
        .option("compression", "zstd")
        .format("parquet")
        .saveAsTable(table)
    )
    return spark.table(table)


def pack_docs(docs: np.ndarray, ids: np.ndarray) -> bytes:
    """Document ids of names, given by number among ascending ``ids``: the distinct ids, then each
    name's number among them."""
    held = np.zeros(len(ids), dtype=bool)
    held[docs] = True
    head = squeeze(ids[held].view(np.uint64))
    index = (np.cumsum(held) - 1)[docs]
    return len(head).to_bytes(8, "little") + head + squeeze(index.astype(np.uint64))


def unpack_docs(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    distinct = unsqueeze(data[8 : 8 + n]).view(np.int64)
    return distinct[unsqueeze(data[8 + n :]).astype(np.int64)]


def sent(
    block: int,
    names: np.ndarray,
    docs: tuple[np.ndarray, np.ndarray] | None,
    bits: int,
    parts: int,
) -> pa.Table:
    """Rows of NAMES: the ascending names of a block by range, with their documents (numbers among
    ids, and the ids) if given."""
    cuts = ranges(names, bits, parts).tolist()
    full = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.table(
        {
            "block": pa.array([block] * len(full), pa.int64()),
            "part": pa.array([p for p, _, _ in full], pa.int32()),
            "names": pa.array([squeeze(deltas(names[a:b])) for _, a, b in full], pa.binary()),
            "docs": pa.array(
                [b"" if docs is None else pack_docs(docs[0][a:b], docs[1]) for _, a, b in full],
                pa.binary(),
            ),
        }
    )


def replied(replies: pa.Table, level: int, names: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The answers to a block's names of one level, in the order of the names."""
    cuts = ranges(names, bits, parts).tolist()
    out = np.zeros(len(names), dtype=bool)
    for p, of, data in zip(
        replies["part"].to_pylist(), replies["level"].to_pylist(), replies["bits"].to_pylist(),
        strict=True,
    ):
        if of == level:
            out[cuts[p] : cuts[p + 1]] = bytes_bits(data, cuts[p + 1] - cuts[p])
    return out


def matched(level: int):
    """Answers for one range of names: whether another block has the name (level 1), or has it
    in an earlier document (levels 0 and 2). Equal names are neighbours once sorted."""

    def match(group: pa.Table) -> pa.Table:
        lists = [sums(unsqueeze(x)) for x in group["names"].to_pylist()]
        sizes = np.array([len(x) for x in lists])
        names = np.concatenate(lists)
        order = np.argsort(names)
        ranked = names[order]
        start = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        run = np.diff(np.append(start, len(ranked)))
        if level == 1:
            sorted_flags = np.repeat(run > 1, run)
        else:
            docs = np.concatenate([unpack_docs(x) for x in group["docs"].to_pylist()])[order]
            sorted_flags = docs > np.repeat(np.minimum.reduceat(docs, start), run)
        flags = np.empty(len(names), dtype=bool)
        flags[order] = sorted_flags
        ends = np.cumsum(sizes)
        return pa.table(
            {
                "block": group["block"],
                "part": group["part"],
                "level": pa.array([level] * len(lists), pa.int32()),
                "bits": pa.array(
                    [bits_bytes(flags[e - n : e]) for e, n in zip(ends, sizes, strict=True)],
                    pa.binary(),
                ),
            }
        )

    return match


class Plan:
    """The work on one block at each step."""

    def __init__(self, total: int):
        self.bits = min(64, max(16, total.bit_length() + SPARE_BITS))
        self.parts = max(1, -(-total // RANGE_BYTES))

    def read(self, blocks: pa.Table, replies: pa.Table) -> tuple[Block, np.ndarray]:
        """The block without copies, and which documents are copies."""
        block = Block(*(blocks[c][0].as_py() for c in BLOCKS.names[1:]))
        earlier = replied(replies, 0, block.first_copies()[0], 64, self.parts)
        return block, block.drop_copies(earlier)

    def tuples(self, block: Block) -> tuple:
        """Sampled places, the distinct names, whether several documents here have them, and which
        name each place has."""
        places = block.sampled()
        names = block.tuple_names(places, self.bits)
        if not len(names):
            return places, names, np.zeros(0, dtype=bool), places
        distinct, _, several, where = first_of_each(names, block.of_rows(block.number, places))
        return places, distinct, several, where

    def prefixes(self, block: Block, replies: pa.Table) -> tuple:
        """Candidate starts, the distinct 64-bit names of their strings, the numbers of the first
        documents, and which name each start has and of which document it is."""
        places, distinct, several, where = self.tuples(block)
        known = several | replied(replies, 1, distinct, self.bits, self.parts)
        starts = block.candidates(places[known[where]])
        names = fingerprints(block.sums, starts, starts + LENGTH)
        docs = block.of_rows(block.number, starts)
        if not len(names):
            return starts, names, docs, docs, docs
        distinct, first, _, where = first_of_each(names, docs)
        return starts, distinct, first, where, docs

    def send_digests(self, blocks: pa.Table) -> pa.Table:
        block = Block(*(blocks[c][0].as_py() for c in BLOCKS.names[1:-1]))
        distinct, first = block.first_copies()
        docs = np.searchsorted(block.named, first), block.named
        return sent(blocks["block"][0].as_py(), distinct, docs, 64, self.parts)

    def send_tuples(self, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(blocks):
            return sent(0, np.zeros(0, np.uint64), None, 64, self.parts)
        block = self.read(blocks, replies)[0]
        distinct = distinct_sorted(block.tuple_names(block.sampled(), self.bits))
        return sent(blocks["block"][0].as_py(), distinct, None, self.bits, self.parts)

    def send_prefixes(self, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(blocks):
            return sent(0, np.zeros(0, np.uint64), None, 64, self.parts)
        block = self.read(blocks, replies)[0]
        _, distinct, first, _, _ = self.prefixes(block, replies)
        return sent(blocks["block"][0].as_py(), distinct, (first, block.named), 64, self.parts)

    def remove(self, blocks: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if len(blocks):
            block, copies = self.read(blocks, replies)
            starts, distinct, first, where, docs = self.prefixes(block, replies)
            earlier = replied(replies, 2, distinct, 64, self.parts)
            edge = np.zeros(len(block.data) + 1, dtype=np.int32)
            gone = starts[earlier[where] | (docs > first[where])]
            edge[gone] += 1
            edge[gone + LENGTH] -= 1
            removed = np.cumsum(edge[:-1], dtype=np.int32) > 0
            removed |= np.repeat(copies, block.sizes)
            rows = removed_rows(block, removed) * len(blocks)
        schema = OUT_ARROW
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.table(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def removed_rows(block: Block, removed: np.ndarray) -> list[tuple]:
    rows = []
    none = np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(np.flatnonzero(removed), block.ends), prepend=0).tolist()
    for i, (start, end, n) in enumerate(
        zip(block.starts.tolist(), block.ends.tolist(), counts, strict=True)
    ):
        data, spans, kept = block.data[start:end], none, block.data[start:end]
        if n:
            cut = removed[start:end]
            spans = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
            kept = data[~cut]
        rows.append(
            (
                int(block.ids[i]) if block.known[i] else None, len(data), n, len(spans) // 2,
                hashlib.sha256(kept).hexdigest(), spans.tolist(),
            )
        )
    return rows


OUT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("removed", pa.list_(pa.int64())),
    ]
)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its length, the bytes and runs removed, the digest of the bytes
    kept, and ``removed``, the runs themselves (start and end bytes alternating)."""
    spark = docs.sparkSession
    total = text_bytes(docs, text)
    plan = Plan(total)
    buckets = min(MAX_BUCKETS, max(1, -(-total // (2 * BLOCK_BYTES))))
    blocks = store_blocks(spark, make_blocks(docs, doc_id, text), buckets)
    grouped = blocks.groupBy("block")
    heads = blocks.drop("bytes").groupBy("block")
    digests = heads.applyInArrow(lambda blocks: plan.send_digests(blocks), NAMES)
    replies = written(digests.groupBy("part").applyInArrow(matched(0), REPLY), "replies")
    tuples = grouped.cogroup(replies.groupBy("block")).applyInArrow(
        lambda blocks, answers: plan.send_tuples(blocks, answers), NAMES
    )
    repeated = tuples.groupBy("part").applyInArrow(matched(1), REPLY)
    replies = replies.unionAll(written(repeated, "replies"))
    prefixes = grouped.cogroup(replies.groupBy("block")).applyInArrow(
        lambda blocks, answers: plan.send_prefixes(blocks, answers), NAMES
    )
    more = prefixes.groupBy("part").applyInArrow(matched(2), REPLY)
    replies = replies.unionAll(written(more, "replies"))
    return grouped.cogroup(replies.groupBy("block")).applyInArrow(
        lambda blocks, answers: plan.remove(blocks, answers), OUT
    )
