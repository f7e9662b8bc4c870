"""Language identification with a string kernel.

A text is the set of its blended spectrum: the n-grams of one to three characters, lower case,
white space as one symbol, that occur at all. The kernel of two texts is the number of n-grams
they share over the geometric mean of their numbers. Landmarks of every language span the
Nyström approximation, and kernel ridge regression is fitted on it, one language against the
rest. Every code point is told apart: an n-gram is a 64-bit code, looked up among the sorted codes
of the landmarks, and those that no landmark has cannot be shared with one. So texts of any
length become a row of presences; kernels and scores of a batch are matrix products.

Training rows are bounded by ``PER_LANGUAGE`` rows and ``LANGUAGE_BYTES`` of text for each
language, whole texts in the order of the hash of their id (rows of one language and id count
once, by the text with the smallest hash). A first count by language keeps only ids whose hash is
below a limit, about ``SPARE`` times those wanted, so that no task orders all ids of a language.
Every whole text is scored where it is read.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if
there is no row to learn from; a null id is never used for training; repeated rows are scored
each by itself; a language whose first text passes the bound of bytes learns from that text
alone; a very long text is one row of presences; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curbside.llm.common import map_batches
from curbside.llm.toxicity import fold

PER_LANGUAGE = 250
LANDMARKS = 40
#: Bytes of text of a language that training may read, beyond its first text.
LANGUAGE_BYTES = 4_000_000
SPARE = 4
#: Bytes of presences that a task holds at a time.
ROW_BYTES = 256 << 20
RIDGE = 1e-3
FOLDS, HELD_OUT = 4, 2
#: Texts whose kernels are taken at a time.
BATCH = 128
SHARPNESS = 6.0


#: A code point takes 21 bits, and none is 0, so n-grams of different lengths have different codes.
BITS = np.int64(21)
SPACES = np.array([p for p in range(0x3001) if chr(p).isspace()], dtype=np.int64)


def gram_codes(text: str) -> np.ndarray:
    """Distinct one-, two- and three-character codes of a text, ascending."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    a = np.where(np.isin(points, SPACES), np.int64(0x20), points) + 1
    b = (a[:-1] << BITS) | a[1:]
    c = (b[:-1] << BITS) | a[2:]
    return np.unique(np.concatenate([a, b, c]))


@dataclass
class Spectrum:
    """Codes of the n-grams that the landmarks have, ascending."""

    grams: np.ndarray

    def rows(self, texts: list[str]) -> np.ndarray:
        """Presence of each known n-gram in each text, scaled to unit length."""
        out = np.zeros((len(texts), len(self.grams)), dtype=np.float32)
        for i, t in enumerate(texts):
            codes = gram_codes(t)
            places = np.searchsorted(self.grams, codes)
            places[places == len(self.grams)] = 0
            out[i, places[self.grams[places] == codes]] = 1
        return out / np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))

    def batch(self) -> int:
        """Texts whose rows are made at a time."""
        return max(1, min(BATCH, ROW_BYTES // (4 * max(1, len(self.grams)))))


def spectrum_of(landmarks: list[str]) -> Spectrum:
    return Spectrum(np.unique(np.concatenate([gram_codes(t) for t in landmarks])))


@dataclass
class LanguageModel:
    languages: list[str]
    spectrum: Spectrum
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """Regression values, one column for each language."""
        kernel = self.spectrum.rows(texts) @ self.landmarks.T
        return kernel @ self.weights


def fit(samples: list[tuple[str, str]], landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Learn from (language, text) rows, those of a language in their order of choice."""
    by: dict[str, list[str]] = {}
    for lang, text in samples:
        by.setdefault(lang, []).append(text)
    if not by:
        return None
    languages = sorted(by)
    chosen = [t for lang in languages for t in by[lang][:landmarks]]
    spectrum = spectrum_of(chosen)
    marks = spectrum.rows(chosen)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    texts = [t for lang in languages for t in by[lang]]
    truth = np.repeat(np.arange(len(languages)), [len(by[x]) for x in languages])
    target = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = (len(texts) / len(languages) / np.bincount(truth))[truth]
    step = spectrum.batch()
    features = np.concatenate(
        [spectrum.rows(texts[i : i + step]) @ marks.T for i in range(0, len(texts), step)]
    ).astype(np.float64)
    features = features @ root
    gram = (features * balance[:, None]).T @ features + RIDGE * len(texts) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, (features * balance[:, None]).T @ target)
    return LanguageModel(languages, spectrum, marks, (root @ solved).astype(np.float32))


def training_rows(
    docs: DataFrame, doc_id: str, text: str, lang: str, per_language: int
) -> list[tuple[str, str]]:
    """A bounded number of labelled rows of each language outside the held-out fold."""
    learn = fold(doc_id, FOLDS) != HELD_OUT
    source = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.col(lang).cast("string").alias("lang"),
        F.col(text).alias("text"),
    ).withColumn("hash", F.xxhash64("id"))
    # One row for each class of the model, which every task holds too: a proven small side. A join
    # by language would deal all rows of a language to one task.
    known = source.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"))
    share = F.col("hash") / F.lit(2.0**64) + 0.5
    order = W.partitionBy("lang").orderBy("hash", "id")
    chosen = (
        source.select("id", "lang", "hash", F.octet_length("text").alias("size"))
        .join(F.broadcast(known), "lang")
        .filter(share * F.col("ids") <= SPARE * per_language)
        .groupBy("id", "lang", "hash")
        .agg(F.max("size").alias("size"))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_language)
        .withColumn("size", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        .filter((F.col("size") <= LANGUAGE_BYTES) | (F.col("place") == 1))
        .select("id", "lang")
    )
    rows = (
        source.join(chosen, ["id", "lang"], "left_semi")
        .groupBy("id", "lang", "hash")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .orderBy("lang", "hash", "id")
        .select("lang", "text")
        .collect()
    )
    return [(r.lang, r.text) for r in rows if any(map(str.isalpha, r.text))]


def language_ids(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(training_rows(docs, doc_id, text, lang, per_language))
    source = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )

    def predict(batch: pa.RecordBatch) -> dict:
        texts = batch["text"].to_pylist()
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        found, score = ["und"] * len(texts), [0.0] * len(texts)
        step = model.spectrum.batch() if model else BATCH
        for at in range(0, len(lettered) if model else 0, step):
            here = lettered[at : at + step]
            values = SHARPNESS * model.scores([texts[i] for i in here]).astype(np.float64)
            share = np.exp(values - values.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for i, k, p in zip(here, share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
                found[i], score[i] = model.languages[k], p
        return {
            "doc_id": batch["doc_id"],
            "held_out": batch["held_out"],
            "lang_pred": found,
            "score": score,
        }

    return map_batches(source, "doc_id long, held_out boolean, lang_pred string, score double", predict)
