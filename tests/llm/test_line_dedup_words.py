import random

import duckdb

from palisade.llm import line_dedup as L
from palisade.llm import queries
from tests.llm.test_line_dedup import within_one

SF = "/root/testdata/sf0.001"


def near(a, b):
    if a == b or min(len(a), len(b)) < L.MIN_CHARS:
        return a == b
    u, v = a.split(), b.split()
    return within_one(a, b) or min(len(u), len(v)) >= L.MIN_LINE_WORDS and within_one(tuple(u), tuple(v))


def brute(docs):
    seen, out = [], {}
    for d, text in docs:
        keep = []
        for line in text.split("\n"):
            if not any(near(line, s) for s in seen):
                keep.append(line)
            seen.append(line)
        out[d] = "\n".join(keep)
    return out


def test_words_equal_brute_force(spark):
    r = random.Random(9)
    word = lambda: r.choice(["to", "be", "or", "not", "that", "question", "été", "wherefore"])
    base = [[word() for _ in range(r.choice([2, 4, 5, 6, 15, 17, 40, 300]))] for _ in range(24)] + [["ha"] * 20]
    docs = []
    for d in range(50):
        lines = []
        for _ in range(r.randint(1, 4)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2])):
                i = r.randrange(len(w))
                w[i : i + 1] = r.choice([["replaced"], [w[i], "inserted"], [] if len(w) > 1 else ["replaced"]])
            lines.append(r.choice([" ", " ", "   "]).join(w))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.text for x in L.deduplicated(df, words=True).collect()}
    assert got == brute(docs)
    by_chars = {x.doc_id: x.text for x in L.deduplicated(df).collect()}
    assert sum(len(t) for t in got.values()) < sum(len(t) for t in by_chars.values())


def test_words_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op9_line_dedup_words"](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['op9_line_dedup_words']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
