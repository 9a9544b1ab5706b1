import random
import sys
from pathlib import Path

import pytest

from palisade.llm import decontamination, packing, quality_rules
from palisade.llm.common import staged
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_operators import brute_measures

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_equal_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocab = [f"word{i}" for i in range(800)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(4)]
    docs = []
    for d in range(70):
        lines = [say(r.randint(20, 40)) for _ in range(4)]
        if d % 5 == 0 and docs:
            w = r.choice(docs)[1].split(" ")
            w[r.randrange(len(w))] = "changed"
            lines = [" ".join(w)]
        if d % 7 == 0:
            lines.append(items[d % 4][1])
        if d % 9 == 0:
            lines = [say(10)]
        docs.append((d, "\n".join(lines), "en", "s", 0))
    docs = [(d, t, a, b, len(t)) for d, t, a, b, _ in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now = {d: t for d, t, *_ in docs}
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        df = staged(stage(spark, df, str(tmp_path)), name)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_rules":
            bad = lambda t: (m := brute_measures(t))[0] < 50 or 100 * m[4] > 50 * m[0]
            now = {d: t for d, t in now.items() if not bad(t)}
        elif name == "line_dedup":
            now = {d: t for d, t in without_lines(list(now.items())).items() if t.strip()}
        elif name == "ngram_jaccard_join":
            g = groups(list(now.items()))
            now = {d: t for d, t in now.items() if g[d][1] == d}
        else:
            now = {d: t for d, t in now.items() if not any(t2 in t for _, t2 in items)}
        got = {x.doc_id: (x.text, x.n_chars) for x in df.collect()}
        assert got == {d: (t, len(t)) for d, t in now.items()}, name
    packs = pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in packs} == set(now) and packs[0].sequence_id is not None


def test_nulls_repeats_and_extra_columns_pass_all_stages(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (2, None), (None, text + " x"), (3, ""), (4, "a line of its own, long enough\n" + text + " y\n" + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = ["__n_removed", "__n_lines", "__own", "__keep", "__text", "component_id", "item_id", "n_words", "failure_bits", "n_shingles"]
    wide = df.selectExpr("*", *[f"{i} AS {c}" for i, c in enumerate(clashing)])
    spark.createDataFrame([(0, "nothing of the sort is in here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        want = sorted(map(tuple, stage(spark, df, str(tmp_path)).collect()), key=repr)
        got = stage(spark, wide, str(tmp_path))
        assert got.columns == wide.columns, name
        assert sorted((tuple(r)[:2] for r in got.collect()), key=repr) == want, name
        assert all(tuple(r)[2:] == tuple(range(len(clashing))) for r in got.collect()), name
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0
    packs = pipeline.STAGES[-1][1](spark, wide, str(tmp_path)).collect()
    assert len({r.doc_id for r in packs}) == 5
    assert quality_rules.CURRENT in quality_rules.POLICIES and packing.CAPACITY == 4096 and decontamination.MIN_WORDS == 10
