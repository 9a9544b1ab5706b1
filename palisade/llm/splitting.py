"""Character classes as the tokenizer library has them.

The ``regex`` module may know another version of Unicode than the library. Texts with a character
on whose class the two differ are split after putting a stand-in of the right class in its place;
lengths in characters do not change, so spans carry over to the text itself.
"""

from __future__ import annotations

import regex
from tokenizers import Tokenizer

#: All characters up to here are classed alike by every version of Unicode in question.
SETTLED = "՗"
_beyond = regex.compile(f"[^\\x00-{SETTLED}]")
_classes = {"L": regex.compile(r"\p{L}"), "N": regex.compile(r"\p{N}"), "S": regex.compile(r"\s")}
STAND_IN = {"L": "ê", "N": "²", "O": "¶"}


class Settler(dict):
    """Character -> its stand-in, or None if the versions agree."""

    def __init__(self, tokenizer: Tokenizer):
        self.pieces = lambda s: len(tokenizer.pre_tokenizer.pre_tokenize_str(s))

    def __missing__(self, ch: str) -> str | None:
        ours = next((k for k, p in _classes.items() if p.match(ch)), "O")
        theirs = "L" if self.pieces("a" + ch) == 1 else "O" if self.pieces("!" + ch) == 1 else ours if ours == "S" else "N"
        self[ch] = out = STAND_IN[theirs] if ours != theirs else None
        return out

    def spans(self, pattern: regex.Pattern, text: str) -> list[str]:
        """The matches of ``pattern`` in ``text``, characters classed as the library does."""
        if text.isascii() or not _beyond.search(text):
            return pattern.findall(text)
        swap = {ord(c): s for c in set(_beyond.findall(text)) if (s := self[c])}
        if not swap:
            return pattern.findall(text)
        return [text[m.start() : m.end()] for m in pattern.finditer(text.translate(swap))]
