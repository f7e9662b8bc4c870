"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents without regard to their label are the
unlabelled rest. A linear classifier over the presence of words and word beginnings is trained
in numpy on the risk

    prior * R+(toxic) + max(0, R-(unlabelled) - prior * R-(toxic)),

with the logistic loss, over those words and beginnings that are clearly more frequent in toxic
documents. Where a batch's estimate of the negative part falls below zero, the step goes back up
it, which keeps the classifier from fitting the unlabelled toxic documents. The prior is the
share of toxic documents among the labelled ones.

Training rows are bounded (``POSITIVES``, ``UNLABELLED``), chosen by the hash of their id, and
turned into numbers where they are read. Rows of one id count once in training: the text with the
smallest hash stands for the id. Every whole text is scored where it is read, with the
weights alone sent to the tasks (``BINS`` doubles).

Defined cases: a null or empty text has the score of a text without known words; a null id is
never used for training; without positives or unlabelled rows every score is the prior (0 if
that is unknown); repeated rows are scored each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import map_batches, plain_words

POSITIVES = 4000
UNLABELLED = 10_000
BINS = 1 << 18
#: Lengths in bytes of the word beginnings that count besides whole words.
PREFIXES = (3, 4, 5, 6)
#: Words whose numbers a task keeps.
KEPT_WORDS = 400_000
#: Words and beginnings of fewer training documents have no weight.
MIN_DOCS = 5
#: Standard errors by which a share must be larger among toxic documents.
CLEARLY = 4.0
FOLDS, HELD_OUT = 5, 0
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 1600, 0.02, 1e-4, 7


_BINS: dict[bytes, bytes] = {}


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of an id as text, by remainder."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds))


def bins_of(word: bytes) -> bytes:
    """Numbers of a word and of its beginnings, as 32-bit integers."""
    known = _BINS.get(word)
    if known is None:
        parts = [word, *(b"^" + word[:n] for n in PREFIXES if len(word) > n)]
        known = array("i", [zlib.crc32(p) & (BINS - 1) for p in parts]).tobytes()
        if len(_BINS) >= KEPT_WORDS:
            _BINS.clear()
        _BINS[word] = known
    return known


def word_bins(text: str | None) -> np.ndarray:
    """Distinct numbers of the words and word beginnings of a text, ascending."""
    words = set(plain_words(text))
    return np.unique(np.frombuffer(b"".join(map(bins_of, words)), dtype=np.int32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """Sparse presence rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.columns = np.concatenate([np.zeros(0, np.int32), *rows])

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row number and column of each entry of some rows."""
        sizes = self.sizes[which]
        begin = np.repeat(self.ends[which] - sizes - (np.cumsum(sizes) - sizes), sizes)
        return np.repeat(np.arange(len(which)), sizes), self.columns[begin + np.arange(sizes.sum())]


def screened(positive: Rows, unlabelled: Rows) -> np.ndarray:
    """Numbers that toxic documents hold clearly more often than unlabelled ones. All others
    have no weight, so that chance finds among many rare words cannot be fitted."""
    in_p = np.bincount(positive.columns, minlength=BINS)
    in_u = np.bincount(unlabelled.columns, minlength=BINS)
    n_p, n_u = len(positive.sizes), len(unlabelled.sizes)
    share = (in_p + in_u + 1) / (n_p + n_u + 2)
    spread = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    return (in_p + in_u >= MIN_DOCS) & (in_p / n_p - in_u / n_u > CLEARLY * spread)


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float
) -> tuple[np.ndarray, float]:
    """Weights by word number, and the offset."""
    known = screened(Rows(positive), Rows(unlabelled))
    p, u = ([r[known[r]] for r in rows] for rows in (positive, unlabelled))
    p_rows, u_rows = Rows(p), Rows(u)
    random = np.random.default_rng(SEED)
    w, offset = np.zeros(BINS + 1), np.log(prior / (1 - prior))
    w[BINS] = offset
    mean, square, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, -(-len(u) // BATCH))
    p_size, u_size = max(1, -(-len(p) // steps)), max(1, -(-len(u) // steps))
    for _ in range(EPOCHS):
        p_order, u_order = random.permutation(len(p)), random.permutation(len(u))
        for s in range(steps):
            i = p_order[np.arange(s * p_size, (s + 1) * p_size) % len(p)]
            j = u_order[np.arange(s * u_size, (s + 1) * u_size) % len(u)]
            (pr, pc), (ur, uc) = p_rows.take(i), u_rows.take(j)
            g_p = np.bincount(pr, w[pc], len(i)) + w[BINS]
            g_u = np.bincount(ur, w[uc], len(j)) + w[BINS]
            negative = np.logaddexp(0, g_u).mean() - prior * np.logaddexp(0, g_p).mean()
            d_u = sigmoid(g_u) / len(j)
            if negative >= 0:
                # d/dg of prior * (log(1 + e^-g) - log(1 + e^g)) is -prior.
                d_p = np.full(len(i), -prior / len(i))
            else:
                d_p, d_u = prior * sigmoid(g_p) / len(i), -d_u
            slope = np.zeros(BINS + 1)
            slope += np.bincount(pc, d_p[pr], BINS + 1) + np.bincount(uc, d_u[ur], BINS + 1)
            slope[BINS] = d_p.sum() + d_u.sum()
            slope[:BINS] += DECAY * w[:BINS]
            t += 1
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope**2
            w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return w[:BINS].copy(), float(w[BINS])


def featurized(docs: DataFrame, text: str, doc_id: str = "doc_id") -> list[np.ndarray]:
    """Word numbers of a bounded sample, one text for each id, in ascending order of id. However
    often an id repeats, each task passes on one row of it."""

    def bins(batch: pa.RecordBatch) -> dict:
        return {
            "id": batch["id"],
            "hash": batch["hash"],
            "bins": [word_bins(t).tobytes() for t in batch["text"].to_pylist()],
        }

    source = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.xxhash64(text).alias("hash"),
        F.col(text).alias("text"),
    )
    rows = (
        map_batches(source, "id long, hash long, bins binary", bins)
        .groupBy("id")
        .agg(F.min_by("bins", F.struct("hash", "bins")).alias("bins"))
        .collect()
    )
    return [np.frombuffer(r.bins, dtype=np.int32) for r in sorted(rows, key=lambda r: r.id)]


def bounded_sample(ids: DataFrame, docs: DataFrame, n: int, doc_id: str) -> DataFrame:
    """The documents of the ``n`` ids with the smallest hash."""
    chosen = ids.distinct().orderBy(F.xxhash64("id"), "id").limit(n)
    return docs.join(F.broadcast(chosen), docs[doc_id].cast("long") == F.col("id"), "left_semi")


def toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> tuple[np.ndarray, float]:
    """Weights and offset learnt from the rows outside the held-out fold."""
    learn = fold(doc_id, FOLDS) != HELD_OUT
    known = labels.filter(learn & F.col(toxic).isNotNull())
    prior = known.agg(F.avg(F.col(toxic).cast("double"))).first()[0]
    confirmed = known.filter(F.col(toxic) == 1).select(F.col(doc_id).cast("long").alias("id"))
    every = docs.filter(learn).select(F.col(doc_id).cast("long").alias("id"))
    p = featurized(bounded_sample(confirmed, docs, positives, doc_id), text, doc_id)
    u = featurized(bounded_sample(every, docs, unlabelled, doc_id), text, doc_id)
    if not p or not u or not 0 < prior < 1:
        share = min(max(prior or 0.0, 1e-9), 1 - 1e-9)
        return np.zeros(BINS), float(np.log(share / (1 - share)))
    return train(p, u, prior)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights, offset = toxicity_model(docs, labels, doc_id, text, toxic)
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )

    def score(batch: pa.RecordBatch) -> dict:
        sums = np.array([weights[word_bins(t)].sum() for t in batch["text"].to_pylist()])
        scores = sigmoid(sums + offset) if len(sums) else sums
        return {
            "doc_id": batch["doc_id"],
            "held_out": batch["held_out"],
            "score": scores,
            "predicted": (scores >= 0.5).astype(np.int32),
        }

    return map_batches(source, "doc_id long, held_out boolean, score double, predicted int", score)
