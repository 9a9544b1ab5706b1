"""Hashes of many sets at once equal those of each set alone, and powers are kept from one buffer to the next."""

import numpy as np

from palisade.llm import jaccard_join as J
from palisade.llm import wordhash


def test_many_sets_at_once():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for n in (0, 1, 5, 0, 0, 700, 2, 0)]
    mix = lambda x: int(wordhash.mixed(np.array([x & (1 << 64) - 1], np.uint64))[0])
    signed = lambda x: x - (1 << 64) * (x >> 63)
    assert J.digests(sets) == [signed(mix(sum(mix(int(g)) for g in s) + len(s))) for s in sets] == [J.digest(s) for s in sets]
    assert J.least_hashes(sets) == [[signed(min(mix(int(g) ^ 0x9E3779B97F4A7C15 * (b + 1) & (1 << 64) - 1) for g in s)) for b in range(J.BANDS)] if len(s) else [] for s in sets]
    assert J.digests([]) == [] and J.least_hashes([]) == []


def test_powers_of_a_long_buffer_serve_short_ones():
    up, down = wordhash.powers(wordhash.BLOCK + 1)
    assert wordhash.powers(10)[0] is up and wordhash.powers(10)[1] is down
    assert int(up[3]) == wordhash.BASE**3 % (1 << 64) and int(up[3]) * int(down[3]) % (1 << 64) == 1
