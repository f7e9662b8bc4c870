"""Token counts of a unigram vocabulary without making tokens.

Text is cut at spaces, each unit with a leading word mark. An Aho-Corasick automaton reports
every vocabulary piece that ends at a place, longest first; a Viterbi pass keeps the best score
and the number of pieces up to each place. Ties go as in the tokenizers library: of equal paths
to one place, the one whose last piece starts first stays. A character that is no piece costs
the lowest score of the vocabulary less 10; it counts its UTF-8 bytes where the vocabulary has
all byte pieces, and otherwise neighbouring ones count as one.

Units repeat, so each task keeps the results of the units it has met, up to a bound. Where all
scores are whole numbers, sums are exact in any order and a unit is cut at line ends too, if no
piece spans them.

Nothing is shuffled. Defined cases: a null or empty text has no tokens and score 0; repeated
rows are counted each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import map_batches

#: The word mark and the penalty of unknown characters.
MARK = "▁"
PENALTY = 10.0
KEPT_UNITS = 500_000
KEPT_LENGTH = 48


class CountingVocabulary:
    """Pieces with scores, ready to count."""

    def __init__(self, pieces: Iterable[tuple[str, float]]):
        import ahocorasick

        vocabulary = dict(pieces)
        if not vocabulary:
            raise ValueError("a vocabulary needs pieces")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary if len(p) == 1}
        self.unknown = min(vocabulary.values()) - PENALTY
        self.bytes = all(f"<0x{b:02X}>" in vocabulary for b in range(256))
        whole = all(float(s).is_integer() for s in vocabulary.values())
        self.by_line = whole and self.bytes and not any("\n" in p for p in vocabulary)
        self.units: dict[str, tuple[int, float]] = {}

    def unit(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path through one unit."""
        n = len(text)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        open_end = [False] * (n + 1)  # the last piece is an unknown character
        score[0] = 0.0
        done = 1  # places before this one are settled

        def settle(to: int) -> None:
            nonlocal done
            while done < to:
                c = text[done - 1]
                if c not in self.single:
                    value = score[done - 1] + self.unknown
                    if score[done] is None or value > score[done]:
                        score[done] = value
                        more = len(c.encode("utf-8", "surrogatepass")) if self.bytes else not open_end[done - 1]
                        count[done] = count[done - 1] + more
                        open_end[done] = True
                done += 1

        for last, (length, value) in self.automaton.iter(text):
            end = last + 1
            if done < end:
                settle(end)
            start = end - length
            value += score[start]
            if score[end] is None or value > score[end]:
                score[end] = value
                count[end] = count[start] + 1
                open_end[end] = False
        settle(n + 1)
        return count[n], score[n]

    def kept(self, text: str) -> tuple[int, float]:
        known = self.units.get(text)
        if known is None:
            known = self.unit(text)
            if len(text) <= KEPT_LENGTH:
                if len(self.units) >= KEPT_UNITS:
                    self.units.clear()
                self.units[text] = known
        return known

    def count(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a text."""
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        units = (text[1:] if text[0] == " " else text).split(" ")
        n, total = 0, 0.0
        for unit in units:
            if self.by_line and "\n" in unit:
                first, *lines = unit.split("\n")
                pieces, score = self.kept(MARK + first)
                for line in lines:
                    more, value = self.kept(line) if line else (0, 0.0)
                    pieces, score = pieces + 1 + more, score + self.unknown + value
            else:
                pieces, score = self.kept(MARK + unit)
            n, total = n + pieces, total + score
        return n, total


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with the scores that it gives them."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def loaded(path: str) -> CountingVocabulary:
    """The vocabulary of this Python worker."""
    return CountingVocabulary(sentencepiece_vocabulary(path))


def token_counts(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens and score (of the best path) of each document."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batch: pa.RecordBatch) -> dict:
        counter = loaded(vocabulary)
        found = [counter.count(t) for t in batch["text"].to_pylist()]
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": [n for n, _ in found],
            "score": [s for _, s in found],
        }

    return map_batches(source, "doc_id long, n_tokens long, score double", count)
