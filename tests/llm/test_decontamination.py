import math
import random
import re

from palisade.llm import decontamination as D


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


def brute(doc, item):
    """Matching words by every diagonal, every mask and every run tried in turn; None if the item is not found."""
    covered, best = set(), 0
    for g in range(-len(item) + 1, len(doc)):
        same = [0 <= i + g < len(doc) and doc[i + g] == item[i] for i in range(len(item))]
        seen = any(all(same[i + o] for o in D.offsets(m)) for m in D.MASKS for i in range(len(item) - D.offsets(m)[-1]))
        ranges = [(0, len(item))] if seen else []
        while ranges:
            low, high = ranges.pop()
            runs = [(sum(1 if x else -1.5 for x in same[a:b]), -b, -a) for a in range(low, high) for b in range(a + 1, high + 1)]
            if not runs:
                continue
            _, b, a = max(runs)
            a, b = -a, -b
            hits = [i for i in range(a, b) if same[i]]
            if len(hits) >= D.MIN_ITEM:
                covered |= set(hits)
                best = max(best, len(hits))
                ranges += [(low, a), (b, high)]
    need = min(D.MIN_WORDS, math.ceil(0.6 * len(item)))
    return len(covered) if len(item) >= D.MIN_ITEM and len(covered) >= need and best >= min(need, 6) else None


def test_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    items = [[r.choice(vocab) for _ in range(n)] for n in (4, 5, 9, 14, 25, 25, 40)] + [["same"] * 12]
    items.append(list(items[4]))  # equal items are each found
    docs = []
    for _ in range(60):
        doc = [r.choice(vocab) for _ in range(r.choice([0, 3, 30]))]
        part = list(r.choice(items))
        for i in r.sample(range(len(part)), r.choice([0, 0, 1, len(part) // 4, len(part) // 3])):
            part[i] = "other"
        docs.append(doc + part + [r.choice(vocab) for _ in range(r.choice([0, 10]))])
    middle = list(items[4])
    middle[9:16] = [f"z{i}" for i in range(7)]  # 9 + 7 + 9: two runs of one diagonal
    docs += [middle, docs[0], ["same"] * 30]
    frame = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(998, None), (999, "")], "doc_id long, text string").selectExpr("*", "1 AS item_id").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.n_matched for x in D.contaminated(frame, bench).collect()}
    want = {(d, i): n for d, doc in enumerate(docs) for i, item in enumerate(items) if (n := brute(doc, item)) is not None}
    assert got == want and (60, 4) in got and got[(60, 4)] == 18
    assert D.contaminated(frame.limit(0), bench).count() == 0 and D.contaminated(frame, bench.limit(0)).count() == 0
