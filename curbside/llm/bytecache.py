"""Token ids of whole texts with a byte-level BPE file.

Where the file is plain byte-level BPE (no normaliser, cuts by the one public pattern, merges in
the order of their ids) its vocabulary is a table of ranks, and a rank-based encoder of the same
table gives the same ids several times faster than the tokenizers library. A text with a
character or mark on which the two could disagree, and every text under a file with other rules,
goes through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import public_tokenizers
import regex

from curbside.llm.wordcache import byte_alphabet

#: Characters outside these ranges may be classed differently by other Unicode versions;
#: U+001C to U+001F are white space for some libraries only.
UNSURE = regex.compile(r"[^\x00-\x1b\x20-ɏ‐-‧‰-⁞€]")


class ByteTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        self.marks = [t["content"] for t in rules["added_tokens"]]
        ranks = by_rank(rules)
        self.by_rank = ranks is not None
        if self.by_rank:
            import tiktoken

            self.ranks = tiktoken.Encoding(
                os.path.basename(path),
                pat_str=public_tokenizers.PATTERN,
                mergeable_ranks=ranks,
                special_tokens={},
            )

    def id_bytes(self, text: str) -> bytes:
        """The ids, without special tokens added, as little-endian unsigned 32-bit integers."""
        if not self.by_rank or UNSURE.search(text) or any(m in text for m in self.marks):
            return packed_ids(self.whole.encode(text, add_special_tokens=False).ids)
        return packed_ids(self.ranks.encode_ordinary(text))


def by_rank(rules: dict) -> dict[bytes, int] | None:
    """Bytes of each token of the file with its id as rank; None if the file has other rules."""
    model, before = rules["model"], rules["pre_tokenizer"] or {}
    plain = (
        rules["normalizer"] is None
        and before.get("type") == "ByteLevel"
        and before.get("use_regex") is True
        and before.get("add_prefix_space") is False
        and model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
    )
    if not plain:
        return None
    vocabulary = model["vocab"]
    joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocabulary.get(m) for m in joined] != list(range(256, 256 + len(joined))):
        return None
    marks = {t["content"] for t in rules["added_tokens"]}
    byte = {c: b for b, c in byte_alphabet().items()}
    return {bytes(map(byte.get, t)): i for t, i in vocabulary.items() if t not in marks}


def packed_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_LOADED: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of this Python worker, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = ByteTokenizer(path)
    return _LOADED[path]
