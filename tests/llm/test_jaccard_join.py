import random
import re
from contextlib import contextmanager

import numpy as np

from palisade.llm import jaccard_join as J


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 4 * k >= 3 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [[r.choice(vocab) for _ in range(60)] for _ in range(3)]
    docs, base = [], [[r.choice(vocab) for _ in range(r.choice([6, 20, 60, 200, 700]))] for _ in range(25)]
    for d in range(n):
        w = list(r.choice(base)) if r.random() < 0.6 else [r.choice(vocab) for _ in range(r.choice([0, 2, 3, 30, 90]))]
        for _ in range(r.choice([0, 0, 1, 2, len(w) // 25, len(w) // 12])):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            i = r.randrange(len(w) + 1)
            w[i:i] = r.choice(passage)
        if r.random() < 0.2:
            w += [r.choice(vocab) for _ in range(len(w) // 8)]
        docs.append((d, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return docs


def test_equals_brute_force(spark):
    docs = corpus(1, 420)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert got == brute(docs)
    assert len({c for _, c in got.values()}) < 380


def test_contraction(spark, monkeypatch):
    """Links beyond one task's share are contracted in rounds; a pivot's members are dealt over several copies of it."""
    docs = corpus(3, 200)
    monkeypatch.setattr(J, "SPOKES", 3)
    monkeypatch.setattr("palisade.llm.components.ONE_TASK", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_recursion_alone(spark, monkeypatch):
    """Without the first pivots, and with few pivots a region whose number grows slowly, the recursion gives the same."""
    docs = corpus(2, 160)
    monkeypatch.setattr(J, "BANDS", 0)
    monkeypatch.setattr(J, "PIVOTS", 2)
    monkeypatch.setattr(J, "GROWTH", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def hard_group(seed, n):
    """Near copies of one text at all distances from it: no component holds them, all share leading n-grams."""
    r = random.Random(seed)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    docs = []
    for d in range(n):
        w = list(base)
        for i in r.sample(range(len(w)), r.choice([1, 3, 5, 8, 10, 12])):
            w[i] = f"w{r.randrange(3000)}"
        docs.append((d, " ".join(w)))
    return docs


def test_pivots_cells_and_few_pairs(spark, monkeypatch):
    """The default path draws pivots, cells and second regions, and measures a number of pairs near the number of documents."""
    docs = hard_group(4, 300)
    pivots, pairs, rounds = [], [], []
    real_pivots, real_measured = J.with_pivots, J.measured

    def with_pivots(regions, *rest):
        out = real_pivots(regions, *rest)
        pivots.append(out.selectExpr("explode(ps.p)").distinct().count())
        rounds.append(regions.count())
        return out

    def measured(found, *rest):
        pairs.append(found.count())
        return real_measured(found, *rest)

    monkeypatch.setattr(J, "with_pivots", with_pivots)
    monkeypatch.setattr(J, "measured", measured)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert len(rounds) >= 2 and all(pivots)
    assert sum(pairs) < 300 * 299 // 2 // 8


def test_defined_cases(spark):
    same = "a b c d e f g h"
    rows = [(5, None), (6, ""), (7, same), (3, same.upper()), (3, same.upper()), (None, same), (9, "a b"), (8, "A b"), (2, "\n\t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n", "1 AS set")
    got = sorted((tuple(r) for r in J.linked(df).collect()), key=repr)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 4, 3), (3, 4, 3), (3, 4, 3), (None, 4, None), (9, 1, 8), (8, 1, 8), (2, 0, 2)], key=repr)
    assert J.linked(df.limit(0)).count() == 0


def test_sets_move_only_to_their_pivots(spark, monkeypatch):
    """Sets are written where they are read; rows of equal id give a set more than once, and each pair is measured once."""
    plans, pairs = {}, []
    staged = J.staged

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        out = staged(df, name)
        if name == "pivot-distances":
            pairs.extend(out.select("x", "p").collect())
            assert out.select("x", "p").distinct().count() == out.count()
        return out

    monkeypatch.setattr(J, "staged", seen)
    docs = corpus(5, 60)
    rows = [r for r in docs for _ in range(3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(docs) and pairs
    assert not any("Aggregate" in p or "Deduplicate" in p for p in plans["set-grams"])


def test_first_pivots_share_two_least_hashes(spark, monkeypatch):
    """Sets that have one least hash of a pivot, as those with a common passage, do not meet it before the rounds."""
    tried, staged = [], J.staged
    monkeypatch.setattr(J, "staged", lambda df, name: tried.append(staged(df, name)) or tried[-1] if name == "band-pairs" else staged(df, name))
    monkeypatch.setattr(J, "scratch", _kept)
    docs = corpus(6, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    bands = {J.digest(g): J.least_hashes(g) for g in J.sets_of([t for _, t in docs])}
    met = tried[0].collect()
    assert met and all(sum(a == b for a, b in zip(bands[r.x], bands[r.p])) >= 2 for r in met)


@contextmanager
def _kept(spark):
    yield lambda df: df


def test_a_leaf_is_compared_as_all_pairs():
    """The links of a leaf and those to its pivot join its members as all pairs of them do."""
    for seed, cells in ((1, 1 << 22), (2, 1 << 12), (3, 1 << 8)):
        docs = hard_group(seed, 120) + [(d + 120, t) for d, t in corpus(seed, 60) if t.strip()]
        hub, *sets = list(J.sets_of([t for _, t in docs]))
        inside = [np.isin(g, hub) for g in sets]
        extras, lacks = [g[~i] for g, i in zip(sets, inside)], [hub[~np.isin(hub, g)] for g in sets]
        old, J.LEAF_CELLS = J.LEAF_CELLS, cells
        try:
            met = J.met_in_leaf(extras, lacks, len(hub))
        finally:
            J.LEAF_CELLS = old
        links = lambda a, b: 7 * len(np.intersect1d(a, b)) >= 3 * (len(a) + len(b))
        every = [(i, j) for i in range(len(sets)) for j in range(i) if links(sets[i], sets[j])]
        to_hub = [(i, len(sets)) for i in range(len(sets)) if links(sets[i], hub)]
        assert met and len(met) < len(sets) and all(links(sets[i], sets[j]) for i, j in met)

        def parts(pairs, n=len(sets) + 1):
            root = list(range(n))
            for a, b in pairs:
                a, b = root[a], root[b]
                root = [a if r == b else r for r in root]
            return [root.index(r) for r in root]

        assert parts(met + to_hub) == parts(every + to_hub)


def test_cells_of_a_leafs_size_are_not_cut_by_elements(spark, monkeypatch):
    """After the first round a group has a row for each member and is done; elements gave rows with the power of its size."""
    docs, real, members = hard_group(4, 300), J.with_pivots, []
    monkeypatch.setattr(J, "with_pivots", lambda *rest: members.append((out := real(*rest)).count()) or out)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
    assert len(members) == 2 and members[1] <= 300


def test_groups_beyond_a_leaf(spark, monkeypatch):
    """Cells with more members or n-grams than a leaf are cut by elements, and meet leaves, or none, in later rounds."""
    docs, measured, leaves = hard_group(8, 140), J.measured, []
    monkeypatch.setattr(J, "LEAF", 30)
    monkeypatch.setattr(J, "LEAF_GRAMS", 1500)
    monkeypatch.setattr(J, "measured", lambda *rest: leaves.append((out := measured(*rest)).where("met IS NOT NULL").count()) or out)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.linked(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and len(leaves) > 4
