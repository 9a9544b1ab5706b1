import math
import random

import pytest

from palisade.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, every):
    live = [(i, g, [math.floor(256 * x) for x in v]) for i, g, v in rows if None not in (i, g, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in (x for x in live if x[0] % every == 0):
        scored = [(-sum(p * q for p, q in zip(a[2], c[2])), c[0], c[1] == a[1]) for c in live if c[0] != a[0] and len(c[2]) == len(a[2])]
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            fits = sorted((t, n) for t, n, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(a[0], p, k + 1, n, -s, -t) for k, (t, n) in enumerate(fits)]
    return sorted(out)


def got(spark, rows, every, schema=SCHEMA):
    return sorted(tuple(x) for x in H.mined(spark.createDataFrame(rows, schema), every=every).collect())


def vectors(n, dim, seed, ids=None):
    import struct

    r = random.Random(seed)
    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    return [(ids[i] if ids else i, r.randrange(3), [f32(r.choice([r.gauss(0, 0.3), 0.5, -0.25])) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(H, "BLOCK_BYTES", block_bytes)
    rows = vectors(260, 8, 1)
    want = brute(rows, 10)
    assert want and got(spark, rows, 10) == want


def test_ties_copies_and_one_hot_label(spark):
    rows = [(i, 0 if i % 3 else 1, [0.5, 0.25]) for i in range(60)] + [(60 + i, i % 4, [0.25, 0.25]) for i in range(60)]
    assert got(spark, rows, 10) == brute(rows, 10) != []


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(80, 4, 2) + [(100, None, [1.0] * 4), (110, 1, None), (120, 1, [1.0, None, 1.0, 1.0]), (None, 1, [1.0] * 4), (130, 1, [nan, 1.0, 1.0, 1.0]), (141, 2, [1.0, inf, 1.0, 1.0]), (150, 1, []), (160, 2, []), (170, 1, [1.0, 1.0])]
    assert got(spark, rows, 10) == brute(rows, 10)


def test_products_beyond_float64_are_exact(spark):
    r = random.Random(3)
    rows = [(i, i % 2, [float(2**r.randrange(18, 22) + r.randrange(9)) for _ in range(3)]) for i in range(40)]
    assert got(spark, rows, 5) == brute(rows, 5) != []


def test_empty_table_few_rows_and_clashing_columns(spark):
    assert got(spark, [], 5) == [] and got(spark, [(0, 1, [1.0])], 5) == []
    rows = [(*x, i, "b") for i, x in enumerate(vectors(50, 4, 5))]
    assert got(spark, rows, 10, SCHEMA + ", id int, label2 string") == brute([x[:3] for x in rows], 10)


def test_repeated_ids_count_each_and_are_no_partners(spark):
    rows = [(0, 1, [1.0, 0.5])] * 2 + [(1, 1, [1.0, 0.25])] * 2 + [(2, 2, [0.75, 0.25])] * 4
    found = got(spark, rows, 5)
    assert len(found) == 2 * 2 * 3 and all(x[0] == 0 and x[1] == 1 and x[3] == 2 for x in found)
