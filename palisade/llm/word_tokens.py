"""Token ids of the lower-casing word-end BPE vocabulary, from a cache of white-space words.

The library's pipeline is: special strings apart, NFC, white space, lower case, split, bytes, merges
with a word-end mark. No piece crosses white space, so a text's ids are the joined ids of its
white-space words; each worker keeps those of the words that it has met. Merging itself runs in a
rank-based encoder that has the word-end mark as byte 0xFF, which UTF-8 never holds. Texts with
characters on whose class or case the libraries may differ go the tokenizer's own way.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
from tiktoken._tiktoken import CoreBPE
from tokenizers import Tokenizer

from palisade.llm.token_counts import byte_alphabet

#: Words kept by a worker; then its memory starts anew. Longer words are never kept.
KEPT_WORDS, KEPT_LENGTH = 120_000, 48
#: The vocabulary's splitter (fixed value).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters beyond those that all versions of Unicode treat alike; final sigma; separators that
#: only str.split() takes for white space.
_odd = regex.compile("[^\\x00-՗]|Σ|[\\x1c-\\x1f\\x85]")


class WordEncoder(dict):
    """White-space word, lower-cased and composed -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path))
        letters = byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        end = spec["model"]["end_of_word_suffix"]
        raw = lambda s: bytes(letters[c] for c in s.removesuffix(end)) + b"\xff" * s.endswith(end)
        ranks = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.core = CoreBPE(ranks, {}, r"(?s:.)+")

    def __missing__(self, word: str) -> bytes:
        one = self.core.encode_single_piece
        ids = [i for p in PIECES.findall(word) for i in one(p.encode() + b"\xff")]
        out = np.array(ids, "<u4").tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        """The whole text's ids as little-endian uint32 bytes."""
        if "<|" in text and any(s in text for s in self.special) or _odd.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.__getitem__, text.lower().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
