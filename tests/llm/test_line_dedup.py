import random

from palisade.llm import line_dedup as L


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """docs: (id, text), in order. Each word line goes if an earlier one is within one edit."""
    seen, out = [], {}
    for d, text in sorted(docs, key=lambda r: r[0]):
        keep = []
        for line in text.split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                gone = any(line == s or len(line) >= L.MIN_CHARS and len(s) >= L.MIN_CHARS and within_one(line, s) for s in seen)
                seen.append(line)
                if gone:
                    continue
            keep.append(line)
        out[d] = "\n".join(keep)
    return out


def edited(r, line):
    i, kind = r.randrange(len(line) + 1), r.randrange(3)
    c = r.choice("abcé ñ.")
    if kind == 0:
        return line[:i] + c + line[i:]
    i = min(i, len(line) - 1)
    return line[:i] + line[i + 1 :] if kind == 1 else line[:i] + c + line[i + 1 :]


def test_equals_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.choice([2, 4, 6, 30, 80, 200]))) for _ in range(40)] + ["a" * 40, "ab" * 30]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                line = edited(r, line)
            lines += [line.replace("\n", "")] + [""] * r.randint(0, 1)
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {row.doc_id: row for row in L.deduplicated(df).collect()}
    want = brute(docs)
    assert {d: x.text for d, x in got.items()} == want
    assert sum(x["__n_removed"] for x in got.values()) > 40


def test_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one two three four five six", "x"), (3, "one two three four five six", "x"), (None, "one two three four five sis\n\n\nshort", "y"), (4, "short\nshor", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted(((r.doc_id, r.text, r.line) for r in L.deduplicated(df).collect()), key=repr)
    # the null id is earliest; the repeated row keeps the same lines in both
    assert got == sorted([(1, None, "x"), (2, "", "x"), (3, "", "x"), (3, "", "x"), (None, "one two three four five sis\n\n\nshort", "y"), (4, "shor", "z")], key=repr)
    assert L.deduplicated(df.limit(0)).count() == 0


def test_texts_are_hashed_before_they_are_cut(spark):
    """Above the generator a text would be hashed again for each of its lines."""
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, None)], "doc_id long, text string")
    plan = L.line_rows(docs, "doc_id", "text").select("__d", "__t", "__n", "h1")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate ", 1)
    assert above.count("xxhash64(") == 1 and below.count("xxhash64(") == 1
    assert sorted((r["__d"], r["__n"]) for r in L.line_rows(docs, "doc_id", "text").collect()) == [(1, 0), (1, 1)]
