import hashlib
import random

import pytest
from pyspark.sql import functions as F

from palisade.llm import merkle as M

FIELDS = ("doc_id", "lang", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests):
    """(root, for each leaf its siblings by level)."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for proof, i in zip(proofs, range(len(at))):
            run = at[i] // 8 * 8
            proof.append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 8])))
        level = [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], proofs


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), leaf(row)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {g: climb([d for _, d in sorted(trees[g])]) for g in langs}
    root, upper = climb([built[g][0] for g in langs])
    out = []
    for g, up in zip(langs, upper):
        for (_, d), proof in zip(sorted(trees[g]), built[g][1]):
            out.append((d, built[g][0], [*proof, *up]))
    return root, out


def made(spark, rows, schema="doc_id long, lang string, text string", **carry):
    df = spark.createDataFrame(rows, schema)
    return M.manifest(df, FIELDS, "lang", ["doc_id"], {"doc_id": F.col("doc_id")} | carry)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 700])
def test_manifest_equals_brute_force(spark, n):
    r = random.Random(n)
    langs = [None, "de", "en", "en", "en", "Ü", "é", "z", "", *[f"l{i}" for i in range(12)]]
    rows = [(i * 3, r.choice(langs), r.choice([None, "", "Text Ä " * r.randrange(1, 40)])) for i in range(n)]
    r.shuffle(rows)
    got, (root, want) = made(spark, rows), brute(rows)
    assert got.root == root
    leaves = got.leaves.withColumn("f", M.folded(F.col("digest"), F.col("steps"))).withColumn("p", M.proof_digest(F.col("steps"))).collect()
    assert sorted((x.digest, x.subroot, [tuple(s) for s in x.steps]) for x in leaves) == sorted(want)
    assert all(x.f == root and x.p == h(*[s[0] + s[1] for s in x.steps]) for x in leaves)


def test_altered_leaf_gives_another_root(spark):
    rows = [(i, "en", f"t{i}") for i in range(30)]
    got = made(spark, rows, other=M.leaf_digest(F.col("doc_id"), F.col("lang"), F.concat("text", F.lit("!"))))
    x = got.leaves.withColumn("f", M.folded(F.col("own.other"), F.col("steps"))).collect()
    assert len(x) == 30 and all(r.f != got.root for r in x)


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(5, "en", "same")] * 20 + [(5, "en", "other"), (None, "en", None), (None, None, None), (None, None, None)]
    got, (root, want) = made(spark, rows), brute(rows)
    assert got.root == root and sorted((x.digest, [tuple(s) for s in x.steps]) for x in got.leaves.collect()) == sorted((d, s) for d, _, s in want)


def test_empty_table_long_text_and_clashing_columns(spark):
    empty = made(spark, [])
    assert empty.root is None and empty.leaves.count() == 0
    rows = [(1, "en", "x" * 2_000_000, "a", 1, "b"), (2, "en", None, "c", 2, "d")]
    schema = "doc_id long, lang string, text string, tree string, pos int, digest string"
    got = made(spark, rows, schema, digest=F.col("digest"), tree=F.col("tree"))
    assert got.root == brute([r[:3] for r in rows])[0]
    assert {(x.own.doc_id, x.own.digest, x.own.tree) for x in got.leaves.collect()} == {(1, "b", "a"), (2, "d", "c")}
