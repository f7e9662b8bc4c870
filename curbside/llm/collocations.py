"""Phrase collocations from a weighted de Bruijn graph of word three-grams, for each language.

Texts are split into pieces and those into words. Nodes of the graph are word pairs; a three-gram
is an edge from its first pair to its second, weighted by its occurrences.

1. Each task aggregates the edges of a block of words. A word whose piece ends after it, or after
   the next word, makes an edge into the end of the piece instead. The flow out of a pair (its
   edges, and the corrections for pieces that end with it) is the count of the pair, and the flow
   out of all pairs of a first word, with the pieces that end there, the count of the word.
2. Aggregated grams, with their counts, are dealt to parts by their hash as compressed runs of
   sorted text, summed there, and those of at least ``min_count`` kept. A gram occurs once in a
   block however frequent it is, so no gram and no language makes a part large.
3. Unary paths are compacted. Where one edge brings all of a node's flow and one takes all of it
   away, the two belong to one path; edges learn the head of their path by pointer doubling. No
   such path is a cycle: pieces are finite, so the flow of a cycle would enter it somewhere.
4. Candidates are read off the paths: inside a path every count is the path's weight, at its ends
   the count of the end node. The lowest score over all cuts into two parts ranks them.

Only grams of ``min_count`` are written; counts are exact sums over all texts. Scores are exact
in 38 digits, for counts up to 10^15.

Defined cases: a null text is empty and a null language ``und``; separators and white space alone
make no piece; repeated rows count each; ties of cuts go to the first cut, ties of scores to the
higher count and then to the phrase in byte order; a very long text is taken in blocks that carry
their last two words over; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.llm.common import map_batches, mixed, text_bytes, utf8, written

MIN_COUNT = 10
#: Percent of a candidate's count from which a longer candidate that holds it replaces it.
COVERED = 50
SCALE = 1_000_000
TOP = 2000
#: Parts of a language that are ranked by themselves first.
SHARES = 64

#: Separators of pieces; words are separated by space and tab.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
LINES = bytes.maketrans(SEPARATORS, b"\n" * len(SEPARATORS))
#: Between pieces in a list of words; no word is empty.
STOP = b""

#: Words aggregated at a time; their codes must fit into 21 bits.
BLOCK_WORDS = 1_000_000
#: Bytes of a text that are split at a time.
BLOCK_BYTES = 1 << 20
#: Bytes of text for each part of the counts.
PART_BYTES = 8 << 20

RUNS = "part long, lang string, size int, number long, grams binary, lengths binary, counts binary"
GRAMS = "lang string, size int, gram string, n long"


def split_text(text: str | None) -> Iterator[list[bytes]]:
    """Words of a text in blocks, with a stop after each piece; only A-Z are lower-cased."""
    data = utf8(text).lower().translate(LINES)
    start = 0
    while start < len(data):
        stop = min(start + BLOCK_BYTES, len(data))
        while stop < len(data) and data[stop] not in b" \t\n":
            stop += 1
        words: list[bytes] = []
        *whole, last = data[start:stop].split(b"\n")
        for piece in whole:
            words += piece.split()
            words.append(STOP)
        words += last.split()
        # What is left may be one blank only; the last piece ends here all the same.
        if stop >= len(data) - 1 or data[stop] == 0x0A:
            words.append(STOP)
        yield words
        start = stop + 1


def _runs_of(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts over equal neighbours."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def aggregated(words: list[bytes]) -> list[tuple[list[np.ndarray], np.ndarray, pa.Array]]:
    """Codes of the distinct grams of size 1 to 3 that start at a word but the last two of the
    list, with their counts and the words in byte order."""
    encoded = pa.array([STOP, *words], pa.binary()).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[encoded.indices.to_numpy()[1:]]  # the stop is 0
    one, two, three = codes[:-2], codes[1:-1], codes[2:]
    edge = one << 42 | two << 21 | np.where(two == 0, 0, three)
    keys, counts = np.unique(edge[one != 0], return_counts=True)
    out = []
    for size in (3, 2, 1):
        if not len(keys):
            break
        # What ends in a stop is a correction: it counts for the shorter grams only.
        full = keys & 0x1FFFFF != 0
        cut = [keys[full] >> 21 * k & 0x1FFFFF for k in reversed(range(size))]
        out.append((cut, counts[full]))
        keys, counts = _runs_of(keys >> 21, counts)
    table = encoded.dictionary.take(pa.array(order))
    return [(cut, n, table) for cut, n in out]


def runs(words: list[bytes], lang: str, parts: int) -> Iterator[tuple]:
    """Aggregated grams of a list of words as one row for each size and part."""
    press = zstandard.ZstdCompressor(level=1).compress
    seed = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))
    hashes = None
    for codes, counts, table in aggregated(words):
        if hashes is None:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in table.to_pylist()], dtype=np.uint64)
        where = np.full(len(counts), seed)
        for code in codes:
            where = mixed(where ^ hashes[code])
        where = (where % np.uint64(parts)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        columns = [table.take(pa.array(code[order])) for code in codes]
        grams = pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]
        offsets = np.frombuffer(grams.buffers()[1], dtype=np.int32)[: len(grams) + 1]
        data = memoryview(grams.buffers()[2]) if len(grams) else b""
        lengths = np.diff(offsets).astype("<u4")
        counts = counts[order].astype("<u4")
        ends = np.cumsum(np.bincount(where, minlength=0))
        start = 0
        for part, end in enumerate(ends.tolist()):
            if end > start:
                yield (
                    part, lang, len(codes), end - start, press(data[offsets[start] : offsets[end]]),
                    press(lengths[start:end]), press(counts[start:end]),
                )
            start = end


def blocks(
    texts: Iterable[tuple[str, str | None]], limit: int = BLOCK_WORDS
) -> Iterator[tuple[str, list[bytes]]]:
    """Words of (lang, text) rows in blocks of about ``limit`` words. Every gram of a language starts
    in one of its blocks, at a word but the last two."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for lang, text in texts:
        for words in split_text(text):
            held.setdefault(lang, []).extend(words)
            total += len(words)
            if total >= limit:
                # Only a piece that goes on needs its last two words again; it starts no gram yet.
                goes_on = held[lang][-1:] not in ([], [STOP])
                rest = held[lang][-2:] if goes_on else []
                for name, block in held.items():
                    yield name, block if goes_on and name == lang else [*block, STOP, STOP]
                held, total = {lang: rest}, len(rest)
    for name, block in held.items():
        yield name, [*block, STOP, STOP]


def gram_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Runs of grams of (lang, text) rows."""
    names = [c.split()[0] for c in RUNS.split(", ")]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str | None]]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                yield lang.as_py(), text.as_py()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for lang, block in blocks(texts(batches)):
            yield from runs(block, lang, parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in make(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], type=t) for v, t in zip(row, types, strict=True)], names=names
            )

    types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return docs.mapInArrow(rows, RUNS)


def summed(table: pa.Table, min_count: int) -> pa.Table:
    """Counts of one part; a gram of size 0 holds the number of words."""
    unpack = zstandard.ZstdDecompressor().decompress
    found: dict[tuple[str, int], list[tuple]] = {}
    for row in table.to_batches():
        for lang, size, number, grams, lengths, counts in zip(
            *(row[c] for c in ("lang", "size", "number", "grams", "lengths", "counts")), strict=True
        ):
            ends = np.cumsum(np.frombuffer(unpack(lengths.as_py()), dtype="<u4"), dtype=np.int32)
            offsets = np.concatenate((np.zeros(1, dtype=np.int32), ends))
            data = [None, pa.py_buffer(offsets), pa.py_buffer(unpack(grams.as_py()))]
            names = pa.Array.from_buffers(pa.binary(), number.as_py(), data)
            n = pa.array(np.frombuffer(unpack(counts.as_py()), dtype="<u4").astype(np.int64))
            found.setdefault((lang.as_py(), size.as_py()), []).append((names, n))
    columns: dict[str, list] = {"lang": [], "size": [], "gram": [], "n": []}
    while found:
        (lang, size), made = found.popitem()
        names, n = (pa.chunked_array(x) for x in zip(*made, strict=True))
        sums = pa.table({"gram": names, "n": n}).group_by("gram", use_threads=False).aggregate([("n", "sum")])
        if size == 1:
            columns["lang"].append(lang)
            columns["size"].append(0)
            columns["gram"].append("")
            columns["n"].append(pc.sum(sums["n_sum"]).as_py())
        kept = sums.filter(pc.greater_equal(sums["n_sum"], min_count))
        columns["lang"] += [lang] * len(kept)
        columns["size"] += [size] * len(kept)
        columns["gram"] += kept["gram"].cast(pa.string()).to_pylist()
        columns["n"] += kept["n_sum"].to_pylist()
    types = {"lang": pa.string(), "size": pa.int32(), "gram": pa.string(), "n": pa.int64()}
    return pa.table({c: pa.array(v, types[c]) for c, v in columns.items()})


def frequent_grams(
    docs: DataFrame, min_count: int = MIN_COUNT, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """Words, pairs and three-grams of at least ``min_count`` occurrences in a language, with
    their counts, and the number of words as gram of size 0. A written table."""
    source = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")
    )
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(usual, -(-text_bytes(source, "text") // PART_BYTES))
    dealt = gram_runs(source, parts).repartition(parts, "part")
    counted = dealt.groupBy("part").applyInArrow(lambda t: summed(t, min_count), GRAMS)
    grams = written(counted, "grams")
    total = grams.filter("size = 0").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    return grams.filter("size > 0").unionAll(total)


def edges(grams: DataFrame) -> DataFrame:
    """Edges with their words, end nodes (``u``, ``v``) and the flow of those."""
    nodes = grams.filter("size = 2")
    word = F.split("gram", " ")
    found = grams.filter("size = 3").select(
        "lang", "gram", F.col("n").alias("a"), word[0].alias("w1"), word[1].alias("w2"), word[2].alias("w3")
    )
    found = found.withColumns({"u": F.concat_ws(" ", "w1", "w2"), "v": F.concat_ws(" ", "w2", "w3")})
    for node, flow in (("u", "u_flow"), ("v", "v_flow")):
        flows = nodes.select("lang", F.col("gram").alias(node), F.col("n").alias(flow))
        found = found.join(flows, ["lang", node])
    return found


def compacted(grams: DataFrame) -> DataFrame:
    """Maximal unary paths: lang, words, weight, and the counts of the first and last pair. Every
    edge is in exactly one path."""
    all_edges = written(edges(grams), "edges")
    into = all_edges.filter("a = v_flow").select("lang", F.col("v").alias("u"), F.col("gram").alias("to"))
    out_of = all_edges.filter("a = u_flow").select("lang", "u", "gram")
    # Pointers to an earlier edge of the same path, and how many edges before it is.
    active = written(out_of.join(into, ["lang", "u"]).select("lang", "gram", "to", F.lit(1).alias("back")), "links")
    ended = active.limit(0)
    while not active.isEmpty():
        known = active.unionAll(ended).select(
            "lang", F.col("gram").alias("to"), F.col("to").alias("far"), F.col("back").alias("more")
        )
        jumped = written(active.join(known, ["lang", "to"], "left"), "links")
        at_head = jumped.filter(F.col("far").isNull()).select("lang", "gram", "to", "back")
        ended = ended.unionAll(at_head)
        active = jumped.filter(F.col("far").isNotNull()).select(
            "lang", "gram", F.col("far").alias("to"), (F.col("back") + F.col("more")).alias("back")
        )
    placed = all_edges.join(ended, ["lang", "gram"], "left").select(
        "lang",
        F.coalesce("to", "gram").alias("head"),
        F.coalesce("back", F.lit(0)).alias("at"),
        "a", "u", "w3", "u_flow", "v_flow",
    )
    # A path is no longer than the piece it comes from.
    paths = placed.groupBy("lang", "head").agg(
        F.max("a").alias("weight"),
        F.min_by("u", "at").alias("u"),
        F.min_by("u_flow", "at").alias("first_count"),
        F.max_by("v_flow", "at").alias("last_count"),
        F.sort_array(F.collect_list(F.struct("at", "w3"))).alias("tail"),
    )
    words = F.concat(F.split("u", " "), F.col("tail")["w3"])
    return paths.select("lang", words.alias("words"), "weight", "first_count", "last_count")


def candidates(grams: DataFrame, paths: DataFrame) -> DataFrame:
    """Phrases of two and three words with the counts of themselves and, for three, of their two
    pairs."""
    at = F.col("at")
    three = paths.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - 3))).select(
        "lang",
        F.slice("words", at + 1, F.lit(3)).alias("words"),
        F.col("weight").alias("a"),
        F.when(at == 0, F.col("first_count")).otherwise(F.col("weight")).alias("left_pair"),
        F.when(at == F.size("words") - 3, F.col("last_count")).otherwise(F.col("weight")).alias("right_pair"),
    )
    pairs = F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))
    longer = (
        three.select("lang", F.explode(pairs).alias("pair"), "a")
        .groupBy("lang", F.array_join("pair", " ").alias("gram"))
        .agg(F.max("a").alias("longest"))
    )
    none = F.lit(None).cast("long")
    two = (
        grams.filter("size = 2")
        .join(longer, ["lang", "gram"], "left")
        .filter(F.coalesce(100 * F.col("longest") < COVERED * F.col("n"), F.lit(True)))
        .select(
            "lang", F.split("gram", " ").alias("words"), F.col("n").alias("a"),
            none.alias("left_pair"), none.alias("right_pair"),
        )
    )
    return three.unionAll(two)


def _score(left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), in exact decimals."""
    a = "cast(a as decimal(15, 0))"
    parts = f"cast({left} as decimal(19, 0)) * cast({right} as decimal(19, 0))"
    return F.expr(f"(cast({SCALE} as decimal(7, 0)) * {a} * {a}) div ({parts})")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, its count ``a``, those of the two
    parts of its lowest-scoring cut (``l``, ``r``), the language's words ``n``, and the score."""
    grams = frequent_grams(docs, min_count, lang, text)
    found = candidates(grams, compacted(grams))
    counts = grams.filter("size = 1")
    found = found.withColumns({"first": F.get("words", F.lit(0)), "last": F.element_at("words", -1)})
    for word in ("first", "last"):
        renamed = counts.select("lang", F.col("gram").alias(word), F.col("n").alias(f"{word}_count"))
        found = found.join(renamed, ["lang", word])
    cut = (
        found.withColumn("right_1", F.coalesce("right_pair", "last_count"))
        .withColumn("score_1", _score("first_count", "right_1"))
        .withColumn("score_2", F.when(F.col("left_pair").isNotNull(), _score("left_pair", "last_count")))
    )
    second = F.coalesce(F.col("score_2") < F.col("score_1"), F.lit(False))
    scored = cut.select(
        "lang",
        F.array_join("words", " ").alias("phrase"),
        "a",
        F.when(second, F.col("left_pair")).otherwise(F.col("first_count")).alias("l"),
        F.when(second, F.col("last_count")).otherwise(F.col("right_1")).alias("r"),
        F.when(second, F.col("score_2")).otherwise(F.col("score_1")).alias("score"),
    )
    # The first of each share of a language, then of those: no task ranks a whole language.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    shares = W.partitionBy("lang", "share").orderBy(*order)
    first = scored.select("*", share).withColumn("rank", F.row_number().over(shares)).filter(F.col("rank") <= top)
    whole = W.partitionBy("lang").orderBy(*order)
    first = first.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= top)
    total = grams.filter("size = 0").select("lang", "n")
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
