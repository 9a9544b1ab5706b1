"""Hashes of all words of many texts at once, in numpy.

Texts are joined by newlines into one buffer. A byte table says which bytes belong to words (and
lower-cases); a running sum of byte times power gives each word's polynomial hash modulo 2**64,
whose base is odd and so invertible, and a final mix spreads it over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of a buffer hashed at once; a block ends at a byte outside words.
BLOCK = 1 << 19
#: Characters of texts gathered into one buffer.
GATHER = 1 << 19


def table(outside: bytes, lower: bool) -> np.ndarray:
    """Byte -> its value in a hash, 0 for bytes outside words."""
    t = np.arange(1, 257, dtype=np.uint16)
    if lower:
        t[65:91] += 32
    t[np.frombuffer(outside, np.uint8)] = 0
    return t


#: Words as maximal runs of anything but space and the controls from tab to carriage return.
SPACE_SPLIT = table(b" \t\n\x0b\x0c\r", lower=True)
#: Words as runs of ASCII letters and digits and all bytes of other characters.
ALNUM_SPLIT = table(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base and of its inverse, or more. The longest so far serve all shorter texts."""
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size > 4 * BLOCK:
        return _powers(BASE, n), _powers(INVERSE, n)
    known = max(_cache, default=0)
    if known < size:
        _cache.clear()
        known = size
        _cache[size] = _powers(BASE, size), _powers(INVERSE, size)
    return _cache[known]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that lets every bit bear on every other."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _hashed(data: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = lut[data]
    inside = values > 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=total[1:])
    return starts, mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(data: bytes, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start offsets, hashes) of the words of a buffer."""
    whole = np.frombuffer(data, np.uint8)
    if len(whole) <= BLOCK:
        return _hashed(whole, lut) if len(whole) else (np.empty(0, np.int64), np.empty(0, np.uint64))
    found, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + BLOCK)
        while end < len(whole) and lut[whole[end]]:
            step = np.flatnonzero(lut[whole[end : end + 65536]] == 0)
            end = end + int(step[0]) if len(step) else min(len(whole), end + 65536)
        starts, hashes = _hashed(whole[at:end], lut)
        found.append((starts + at, hashes))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def words_of(texts: list[str], lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets): text i has the words offsets[i] to offsets[i + 1]."""
    parts = [t.encode() for t in texts]
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    starts, hashes = hash_words(b"\n".join(parts), lut)
    return hashes, np.searchsorted(starts, begin)


def gathered(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in groups of about :data:`GATHER` characters; null is empty."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t or "")
        size += len(group[-1])
        if size >= GATHER:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def window_hash(words: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash for each position i of words[i + o] for o in offsets, in order; shorter by the last offset."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, 0x2545F4914F6CDD1D ^ len(offsets), np.uint64)
    for o in offsets:
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[o : o + n]
        h ^= h >> np.uint64(32)
    return mixed(h)
