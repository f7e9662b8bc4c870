"""Near-duplicates by ProbMinHash over weighted five-word shingles.

1. Texts with the same words are one class; only its first document goes on.
2. Every shingle of a text is a Poisson process whose rate is the shingle's count. Arrivals fall
   on random registers, and each register keeps the shingle that arrives first. A shingle stops
   as soon as its next arrival is later than the latest kept one. Two texts agree in a register
   with the probability Jaccard similarity of their shingle weights. Texts with repeated shingles
   have a second set of registers with every count taken as 1, which agree with the set Jaccard
   similarity. Without repeats both sets are the same.
3. Registers of both kinds are hashed in bands of one bucket space. In each bucket, texts are compared with the first one, then
   linked texts are joined to components; buckets that still hold texts of several components
   are compared in blocks, which yields links only, never pairs.
4. A link needs an exact set Jaccard similarity of 0.8, from texts. Counts rank candidates only: a
   line that two different texts repeat often makes them alike by weight, but no link.

With 24 bands of four registers a pair at 0.8 is missed with probability 3e-6.

Defined cases: fewer than five words are one shingle; a text without words (null, empty) is a
class by itself; repeated rows are one class; of a class the smallest doc_id stays (a null id
last); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curbside.llm.bytehash import word_fingerprints
from curbside.llm.common import map_batches, mixed, utf8, written

SHINGLE = 5
BANDS, ROWS = 24, 4
SIMILARITY = 0.8
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
#: Texts of a bucket that are compared with each other in one task.
BLOCK = 512

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEPS = mixed(np.arange(1, SHINGLE + 2, dtype=np.uint64)) | np.uint64(1)


def chunks(texts: list[bytes]) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield slice(start, i)
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, ascending, and their counts."""
    n = min(SHINGLE, len(words))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        sums += words[j : len(words) - n + 1 + j] * STEPS[j]
    return np.unique(mixed(sums + np.uint64(n)), return_counts=True)


def weighted_sets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, tuple]]:
    """Words and weighted shingles of each text."""
    data = [utf8(t).lower() for t in texts]
    for part in chunks(data):
        words, counts = word_fingerprints(data[part])
        ends = np.cumsum(counts)
        for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            yield words[start:end], shingles(words[start:end])


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """Registers of each weighted set, as a matrix of kept elements (0 for empty sets)."""
    sizes = np.array([len(s) for s, _ in sets], dtype=np.int64)
    kept = np.zeros(len(sets) * m, dtype=np.uint64)
    times = np.full(len(sets) * m, np.inf)
    if not sizes.sum():
        return kept.reshape(-1, m)
    doc = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate([s for s, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(float)
    state = mixed(element)
    at = np.zeros(len(element))
    while len(doc):
        state = mixed(state + GOLDEN)
        at = at - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        slot = doc * m + (mixed(state) % np.uint64(m)).astype(np.int64)
        better = np.flatnonzero(at < times[slot])
        better = better[np.argsort(-at[better], kind="stable")]
        times[slot[better]] = at[better]
        kept[slot[better]] = element[better]
        latest = times.reshape(-1, m).max(axis=1)
        going = at < latest[doc]
        doc, element, rate, state, at = (x[going] for x in (doc, element, rate, state, at))
    return kept.reshape(-1, m)


def bands_of(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket hash for each band."""
    parts = registers.reshape(-1, bands, rows)
    out = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(parts), 1))
    for j in range(rows):
        out = mixed(out * STEPS[0] + parts[:, :, j])
    return out


def buckets_of(sets: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> list[np.ndarray]:
    """Distinct buckets of each weighted set: those of its counts and, where a count is above 1,
    also those of the plain set: a link rests on set Jaccard, and unequal counts may hide such a
    pair from the bands of the counts."""
    out = list(bands_of(prob_minhash(sets, bands * rows), bands, rows).view(np.int64))
    repeated = [i for i, (_, w) in enumerate(sets) if len(w) and w.max() > 1]
    plain = [(sets[i][0], np.ones_like(sets[i][1])) for i in repeated]
    more = bands_of(prob_minhash(plain, bands * rows), bands, rows).view(np.int64)
    for i, b in zip(repeated, more, strict=True):
        out[i] = np.union1d(out[i], b)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Set Jaccard of the shingles of two weighted sets."""
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return common / (len(a[0]) + len(b[0]) - common) if common else 0.0


def signatures(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """node, doc_id, two content hashes (null for texts without words) and buckets of each
    document."""
    source = nodes_of(docs, doc_id, text)

    def sign(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch["text"].to_pylist()
        done: list[tuple] = []
        held, first = 0, 0

        def flush() -> dict:
            buckets = buckets_of([s for _, s in done], bands, rows)
            contents = [content(w) for w, _ in done]
            return {
                "node": batch["node"].slice(first, len(done)),
                "doc_id": batch["doc_id"].slice(first, len(done)),
                "h1": [c and c[0] for c in contents],
                "h2": [c and c[1] for c in contents],
                "buckets": [b if len(w) else [] for b, (w, _) in zip(buckets, done, strict=True)],
            }

        for item in weighted_sets(texts):
            done.append(item)
            held += len(item[0])
            if held > 1 << 18 or len(done) >= 4096:
                yield flush()
                first += len(done)
                done, held = [], 0
        if done:
            yield flush()

    return map_batches(source, "node long, doc_id long, h1 long, h2 long, buckets array<long>", sign)


def nodes_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    name = F.col(doc_id).cast("long")
    return docs.select(
        F.xxhash64(name, F.col(text)).alias("node"), name.alias("doc_id"), F.col(text).alias("text")
    )


def content(words: np.ndarray) -> tuple[int, int] | None:
    """128 bits of the word sequence."""
    if not len(words):
        return None
    place = np.arange(1, len(words) + 1, dtype=np.uint64)
    sums = np.array(
        [mixed(words + place * GOLDEN).sum(), mixed(words ^ (place * STEPS[1])).sum()], np.uint64
    )
    a, b = mixed(sums + np.uint64(len(words))).view(np.int64).tolist()
    return a, b


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar. The text of ``a`` travels with the pair, then meets
    that of ``b``."""
    left = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "a_text"}).hint("merge"), "a")
    both = left.join(texts.withColumnsRenamed({"node": "b", "text": "b_text"}).hint("merge"), "b")

    def test(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        a_text, b_text = batch["a_text"], batch["b_text"]
        recent: OrderedDict[int, tuple] = OrderedDict()
        for at in range(0, len(a), 256):
            here = range(at, min(at + 256, len(a)))
            known = {n: a_text[i].as_py() for i in here if (n := a[i]) not in recent}
            known |= {n: b_text[i].as_py() for i in here if (n := b[i]) not in recent}
            for n, (_, s) in zip(known, weighted_sets(list(known.values())), strict=True):
                recent[n] = s
            good = [i for i in here if similarity(recent[a[i]], recent[b[i]]) >= threshold]
            while len(recent) > 512:
                recent.popitem(last=False)
            yield {"a": [a[i] for i in good], "b": [b[i] for i in good]}

    return map_batches(both.select("a", "b", "a_text", "b_text"), "a long, b long", test)


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of all linked nodes. Labels spread
    along links and jump to the label's own label, so long chains take few rounds."""
    ends = written(
        links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "links",
    )
    labels = ends.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))  # noqa: E501
    labels = written(labels, "labels")
    while True:
        near = (
            ends.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = written(
            spread.join(jump, "next", "left").select(
                "node", "old", F.least("next", F.coalesce("far", "next")).alias("label")
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame,
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: node (of this row's id and text), doc_id, class_id (smallest doc_id
    of its class), class_node and ``kept`` (the document that stays of its class)."""
    signed = written(signatures(docs, doc_id, text, bands, rows), "signatures")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    first = F.min_by("node", order)
    same = (
        signed.filter(F.col("h1").isNotNull())
        .groupBy("h1", "h2")
        .agg(first.alias("rep"), F.min_by("buckets", order).alias("buckets"))
    )
    texts = written(same, "texts")
    rows_in = texts.select("rep", F.explode("buckets").alias("bucket"))
    leaders = rows_in.groupBy("bucket").agg(F.min("rep").alias("b"), F.count("*").alias("n")).filter("n > 1")  # noqa: E501
    leaders = written(leaders, "leaders")
    starred = (
        rows_in.join(leaders.select("bucket", "b"), "bucket")
        .filter(F.col("rep") != F.col("b"))
        .select(F.col("rep").alias("a"), "b")
        .distinct()
    )
    starred = written(starred, "pairs")
    wanted = starred.select(F.col("a").alias("node")).union(starred.select("b")).distinct()
    # Joins with texts are always shuffled: the lists they meet grow with the input.
    contents = written(
        nodes_of(docs, doc_id, text)
        .select("node", "text")
        .join(wanted.hint("merge"), "node", "left_semi")
        .dropDuplicates(["node"]),
        "contents",
    )
    links = written(verified(starred, contents, threshold), "verified")
    labels = components(links)
    more = residual_links(rows_in, leaders, labels, contents, threshold)
    if more is not None:
        labels = components(links.unionAll(more))
    return _membership(signed, texts, labels)


def _membership(signed: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    rep_of = texts.select("h1", "h2", "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    ).select("h1", "h2", F.coalesce("label", "rep").alias("class"))
    placed = signed.select("node", "doc_id", "h1", "h2").join(rep_of, ["h1", "h2"], "left")
    placed = placed.select("node", "doc_id", F.coalesce("class", "node").alias("class"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
    firsts = placed.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.min_by("node", order).alias("class_node")
    )
    return placed.join(firsts, "class").select(
        "node", "doc_id", "class_id", "class_node",
        (F.col("node") == F.col("class_node")).alias("kept"),
    )


def residual_links(
    rows_in: DataFrame, leaders: DataFrame, labels: DataFrame, contents: DataFrame, threshold: float
) -> DataFrame | None:
    """Links within buckets that still hold several components, none if there is no such bucket.

    A bucket's texts lie in blocks of ``BLOCK``, ordered by component. Each pair of blocks is one
    task's work, except where both hold the same single component. Only links that join
    components come out, so a block pair gives fewer links than it has texts."""
    members = (
        rows_in.join(leaders.filter("n > 2").select("bucket"), "bucket")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("bucket", F.col("rep").alias("node"), F.coalesce("label", "rep").alias("label"))
    )
    several = members.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")  # noqa: E501
    place = F.row_number().over(W.partitionBy("bucket").orderBy("label", "node")) - 1
    members = written(
        members.join(several.select("bucket"), "bucket", "left_semi").withColumn("block", F.floor(place / BLOCK)),  # noqa: E501
        "members",
    )
    if members.isEmpty():
        return None
    blocks = members.groupBy("bucket", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))  # noqa: E501
    i = blocks.select("bucket", F.col("block").alias("i"), F.col("lo").alias("i_lo"), F.col("hi").alias("i_hi"))  # noqa: E501
    j = blocks.select("bucket", F.col("block").alias("j"), F.col("lo").alias("j_lo"), F.col("hi").alias("j_hi"))  # noqa: E501
    work = i.join(j, "bucket").filter("i <= j AND NOT (i_lo = i_hi AND j_lo = j_hi AND i_lo = j_lo)")  # noqa: E501
    work = work.select("bucket", "i", "j")
    sides = (
        members.join(work.withColumn("block", F.col("i")), ["bucket", "block"])
        .unionAll(members.join(work.filter("i < j").withColumn("block", F.col("j")), ["bucket", "block"]))  # noqa: E501
        .join(contents.hint("merge"), "node")
        .select("bucket", "i", "j", "block", "node", "label", "text")
    )

    def compare(group: pa.Table) -> pa.Table:
        found = block_links(
            group["node"].to_pylist(), group["label"].to_pylist(),
            group["block"].to_numpy() == group["i"][0].as_py(),
            group["i"][0].as_py() == group["j"][0].as_py(),
            [s for _, s in weighted_sets(group["text"].to_pylist())], threshold,
        )
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = sides.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    return written(found.distinct(), "residual")


def block_links(
    nodes: list[int],
    labels: list[int],
    left: np.ndarray,
    one_block: bool,
    sets: list[tuple[np.ndarray, np.ndarray]],
    threshold: float,
) -> list[tuple[int, int]]:
    """Similar pairs of different components, enough of them to join what is similar."""
    sizes = np.array([len(s) for s, _ in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(
        np.concatenate([s for s, _ in sets]), return_inverse=True, return_counts=True
    )
    shared = times[column] > 1
    columns = np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, (8 << 20) // len(sets))
    order = np.argsort(columns, kind="stable")
    rows, columns = owner[shared][order], columns[order]
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [start, start + width])
        part = np.zeros((len(sets), min(width, int(columns[-1]) + 1 - start)), dtype=np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    label = np.array(labels)
    open_pair = label[:, None] != label[None, :]
    if not one_block:
        open_pair &= left[:, None] != left[None, :]
    likely = common >= (threshold - 1e-6) * union
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in np.argwhere(np.triu(open_pair & likely, 1)).tolist():
        p, q = root(labels[x]), root(labels[y])
        if p != q and similarity(sets[x], sets[y]) >= threshold:
            parent[p] = q
            out.append((nodes[x], nodes[y]))
    return out


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class, with its columns."""
    stay = near_duplicates(docs, **settings).filter("kept").select(F.col("node").alias("__node"))
    keyed = docs.withColumn("__node", F.xxhash64(docs.doc_id.cast("long"), docs.text))
    return keyed.join(stay.hint("merge"), "__node", "left_semi").dropDuplicates(["__node"]).select(*docs.columns)
