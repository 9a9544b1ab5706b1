"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair merges.

For a byte-level BPE vocabulary the encoding of every prefix of a piece follows from shorter ones:
the last token of prefix i is the one vocabulary entry t that ends there and may stand after the
last token of prefix i - len(t); two tokens may be neighbours if encoding their joined bytes gives
the two back. So one pass over a piece counts the tokens of all its prefixes. A document's table is
the joined int8 differences of those counts, a byte for each character: its sum is the whole text's
count, its running sum answers any truncation or budget question without encoding again.

What the splitter does at a cut is part of the table: white-space runs of two or more are kept
together with the piece after them, since a cut text's last run is one piece while a run before a
word gives its last character away. Special strings inside texts become one token, as the library's
default has it; a cut inside one counts its characters as ordinary text.

Defined cases: null counts as the empty text, with no tokens and an empty table. Texts of any length
are read whole. Repeated rows each get a row; other columns are carried by :func:`with_counts`, and
columns named like an output are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tiktoken._tiktoken import CoreBPE
from tokenizers import Tokenizer

from palisade.llm.common import arrow_map
from palisade.llm.splitting import Settler

#: Pieces kept by a worker; then its memory starts anew. Longer pieces are never kept.
KEPT_PIECES, KEPT_LENGTH = 600_000, 48
#: Neighbour tests kept by a worker.
KEPT_TESTS = 2_000_000
#: Rows that go back to Spark at once.
SLICE = 500

_END = r"'s|'t|'re|'ve|'m|'ll|'d"
_RUN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
#: The byte-level splitter (fixed values).
PLAIN = regex.compile(rf"{_END}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
#: The same, with a run of two or more white-space characters and the piece after it as one match.
JOINED = regex.compile(rf"{_END}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s{{2,}}+(?:(?<= )(?:{_RUN})|(?<! )(?:{_END}|{_RUN}))|\s+")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the
    other bytes in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Followers(dict):
    """Next token -> whether it may follow ``token``."""

    __slots__ = ("token",)


class Tokens(dict):
    """Token -> its followers, the empty one for the start of a piece."""

    def __missing__(self, token: bytes) -> Followers:
        self[token] = f = Followers()
        f.token = token
        return f


class PrefixCounter(dict):
    """Piece -> int8 differences of the token counts of its prefixes, as bytes. One for each worker."""

    def __init__(self, path: str):
        spec = json.load(open(path))
        letters = byte_alphabet()
        raw = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.core = CoreBPE(self.vocab, {}, r"(?s:.)+")
        self.longest = max(map(len, self.vocab))
        self.after = Tokens()
        self.tests = 0
        self.special = special
        self.settler = Settler(Tokenizer.from_file(path))
        self.split = lambda text: self.settler.spans(JOINED, text)
        self.lead = regex.compile(r"\s{2,}")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of one piece, in characters, the empty one first."""
        data = piece.encode()
        vocab, longest, after = self.vocab, self.longest, self.after
        last, n = [after[b""]], [0]
        for i in range(1, len(data) + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = data[j:i]
                if t in vocab:
                    may = last[j].get(t)
                    if may is None:
                        may = self.may_follow(last[j], t)
                    if may:
                        last.append(after[t])
                        n.append(n[j] + 1)
                        break
            else:
                raise ValueError(f"no encoding of {data[:i]!r}")
        if len(data) == len(piece):
            return n
        return [0, *(n[i + 1] for i, b in enumerate(data) if i + 1 == len(data) or data[i + 1] & 0xC0 != 0x80)]

    def may_follow(self, a: "Followers", b: bytes) -> bool:
        """Whether token b may stand after the token of a: encoding both gives both back."""
        self.tests += 1
        if self.tests > KEPT_TESTS:
            self.tests = 0
            for f in self.after.values():
                f.clear()
        alone = [self.vocab[b]]
        may = a[b] = self.core.encode_single_piece(a.token + b) == ([self.vocab[a.token], *alone] if a.token else alone)
        return may

    def prefixes(self, piece: str) -> list[int]:
        """The same for a match of :data:`JOINED`, as the splitter cuts its prefixes."""
        if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
            return [0, 1, 2, self.counts(piece)[3]]  # a cut contraction is two pieces
        lead = self.lead.match(piece)
        if not lead:
            return self.counts(piece)
        k = lead.end()
        run = self.counts(piece[:k])
        if k == len(piece):
            return run
        if piece[k - 1] == " ":
            base, tail = run[k - 1], self.counts(piece[k - 1 :])[2:]
        else:
            base, tail = run[k - 1] + self.counts(piece[k - 1])[1], self.prefixes(piece[k:])[1:]
        return run + [base + x for x in tail]

    def __missing__(self, piece: str) -> bytes:
        n = self.prefixes(piece)
        out = bytes([(b - a) & 255 for a, b in zip(n, n[1:])])
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = out
        return out

    def table(self, text: str) -> bytes:
        if not self.special or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.split(text)))
        out, parts = [], self.cut.split(text)
        for segment, mark in zip(parts[::2], [*parts[1::2], ""]):
            pieces = self.split(segment)
            table = b"".join(map(self.__getitem__, pieces))
            out.append(table)
            if mark:  # ordinary text up to its last character
                tail = pieces[-1] if pieces else ""
                deltas = lambda s: np.frombuffer(b"".join(map(self.__getitem__, self.split(s))), np.int8)
                whole = int(deltas(tail).astype(int).sum())
                seen = [int(deltas(tail + mark[:k]).astype(int).sum()) - whole for k in range(1, len(mark))]
                out.append(np.diff([0, *seen, 1]).astype(np.int8).tobytes())
        return b"".join(out)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def n_tokens(table: bytes) -> int:
    return int(np.frombuffer(table, np.int8).sum(dtype=np.int64))


def tokens_at(table: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` characters."""
    return n_tokens(table[: max(0, n_chars)])


def longest_within(table: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_counts(df: DataFrame, text: str = "text", path: str | None = None, table: bool = True) -> DataFrame:
    """``df`` with n_tokens long and, if ``table``, prefix_deltas binary. No shuffle; a worker holds a
    slice of rows and at most :data:`KEPT_PIECES` pieces. Without ``table`` the tables are made and
    summed but not sent back."""
    path = path or default_path()
    df = df.drop("n_tokens", "prefix_deltas")
    outputs = [("n_tokens", T.LongType(), pa.int64())] + [("prefix_deltas", T.BinaryType(), pa.binary())] * table
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t, _ in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = counter(path).table
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                tables = [make(t.as_py() or "") for t in batch.column(text)]
                made = [pa.array([n_tokens(t) for t in tables], pa.int64())] + [pa.array(tables, pa.binary())] * table
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(n for n, _, _ in outputs)])

    return arrow_map(df, run, schema)


def truncated(df: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """``df`` of :func:`with_counts` with the text cut to the longest prefix within ``budget`` tokens,
    from the stored tables alone."""
    limit = F.pandas_udf(lambda s: s.map(lambda t: longest_within(t, budget)).astype("int32"), T.IntegerType())
    return df.withColumn(text, F.substr(F.col(text), F.lit(1), limit("prefix_deltas")))
