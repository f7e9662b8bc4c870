"""Token ids of whole texts with a vocabulary file, word by word.

Where a tokenizer's normaliser turns white space into single spaces and its pre-tokenizer drops
them (``RULES``), no token crosses white space and the ids of a text are those of its words in
turn. Texts go whole through a tokenizer with other rules.
Words repeat, so each task keeps the ids of the words it has met. The ids always come from the
tokenizers library: a word of plain letters goes to the file's model at once, in the byte
alphabet of that model; any other word goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: Words of a task kept with their ids; at the bound the store starts anew.
KEPT_WORDS = 400_000
#: Longer words are not kept.
KEPT_LENGTH = 48

PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Rules of the files whose texts can be taken word by word.
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {
                    "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
                },
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}
#: Information separators: white space for Python's split, not for the tokenizer.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def byte_alphabet() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable bytes of Latin-1
    stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def by_words(path: str) -> bool:
    """Whether a tokenizer file has the rules of this module; its added tokens must neither hold
    white space nor be plain words."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    added = [t["content"] for t in held.get("added_tokens") or []]
    stripped = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held.get("added_tokens") or [])
    return (
        all(held.get(name) == rule for name, rule in RULES.items())
        and held["model"].get("type", "BPE") == "BPE"
        and not stripped
        and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)
    )


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        self.model = self.whole.model
        self.by_words = by_words(path)
        self.alphabet = byte_alphabet()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, as the tokenizer gives them without special tokens added."""
        return np.frombuffer(self.id_bytes(text), dtype="<u4")

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_words or any(s in text for s in SEPARATORS):
            return self._whole(text)
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self._word(words[i])
        return b"".join(found)

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        known = self.words.get(word)
        if known is not None:
            return known
        plain = PLAIN.fullmatch(word)
        if plain:
            out = self._part(plain[1].lower())
            if plain[2]:
                out += self._part(plain[2])
        else:
            out = self._whole(word)
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = out
        return out

    def _part(self, part: str) -> bytes:
        known = self.parts.get(part)
        if known is None:
            spelled = part if part.isascii() else "".join(map(self.alphabet.get, part.encode()))
            ids = array("I", [t.id for t in self.model.tokenize(spelled)])
            if sys.byteorder == "big":
                ids.byteswap()
            known = ids.tobytes()
            if len(self.parts) >= KEPT_WORDS:
                self.parts.clear()
            if len(part) <= KEPT_LENGTH:
                self.parts[part] = known
        return known


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
