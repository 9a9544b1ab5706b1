import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import chat_format as C
from palisade.llm import decontamination as D
from palisade.llm import language_id as L
from palisade.llm import packing as P
from palisade.llm import quality_rules as Q
from palisade.llm import sharding as S
from palisade.llm import token_counts as T
from palisade.llm import warc as W

DOCS = "doc_id long, text string"
LONG = "x" * 30_000 + " " + "word " * 4000


# -- sharding


def brute_shards(rows, limit):
    hashes = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) for d, _ in rows}
    out = {}

    def split(part, depth, prefix):
        size = sum(n for _, n in part)
        if size <= limit or len(part) == 1:
            out.update({d: (prefix, size, len(part)) for d, _ in part})
            return
        for bit in "01":
            some = [r for r in part if hashes[r[0]] >> (59 - depth) & 1 == int(bit)]
            if some:
                split(some, depth + 1, prefix + bit)

    split(rows, 0, "")
    return out


@pytest.mark.parametrize("limit", [700, 5000, 10**9])
def test_sharding_equals_brute_force(spark, limit):
    r = random.Random(limit)
    rows = [(i, r.choice([1, 10, 100, 2000])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("shard", F.lit("old"))
    got = {x.doc_id: (x.shard, x.shard_bytes, x.shard_docs) for x in S.assign_shards(df, ["doc_id"], F.col("n"), limit).collect()}
    assert got == brute_shards(rows, limit)


def test_sharding_equal_keys_and_empty(spark):
    df = spark.createDataFrame([(7, 10)] * 40 + [(None, 10)] * 3, "doc_id long, n long")
    got = S.assign_shards(df, ["doc_id"], F.col("n"), 50).collect()
    assert len(got) == 43 and max(Counter(x.shard for x in got).values()) <= 5 and all(x.shard_bytes <= 50 for x in got)
    assert S.assign_shards(df.limit(0), ["doc_id"], F.col("n"), 50).count() == 0


# -- decontamination


def test_decontamination(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(16, 50)))) for i in range(20)] + [(90, None), (91, "too short"), (92, "")]
    filler = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs, want = [], set()
    for d in range(120):
        text = filler(60)
        if d % 3 == 0:
            i, t = items[r.randrange(20)]
            w = t.upper().split()
            if d % 2:
                for k in range(4, len(w), 5):
                    w[k] = f"zz{k}"
            text = f"{filler(30)}\n{', '.join(w)}. {filler(30)}"
            want.add((d, i))
        docs.append((d, text))
    docs += [(200, None), (201, ""), (202, LONG)]
    df, bench = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in D.contaminated(df, bench).collect()} == want
    assert {(x.doc_id, x.item_id) for x in D.contaminated(df, bench, block_words=100).collect()} == want
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.decontaminated(df, bench.limit(0)).count() == len(docs)


# -- token counts


def test_prefix_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(T.default_path())
    n = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    counter, r = T.PrefixCounter(T.default_path()), random.Random(1)
    parts = ["a", "b", "'", "re", "'ll", " ", "  ", "\n\n", "\t", "12", "!?", "é", "日本", "<|endoftext|>", "<|end", "😀", "----", " the", " ", "\x1c", " "]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        table = counter.table(text)
        assert [T.tokens_at(table, k) for k in range(len(text) + 1)] == [n(text[:k]) for k in range(len(text) + 1)]
    rows = [(1, None), (2, ""), (3, "Hello there, don't  stop"), (3, "Hello there, don't  stop"), (4, LONG)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("x"))
    got = T.with_counts(df)
    assert sorted((x.doc_id, x.n_tokens) for x in got.collect()) == sorted((d, n(t or "")) for d, t in rows)
    cut = {x.doc_id: x.text for x in T.truncated(got, 3).collect()}
    assert n(cut[3]) <= 3 < n(rows[2][1][: len(cut[3]) + 2]) and cut[2] == ""


# -- packing


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.default_path())
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "Beta", "12", "c'est", "été", "x" * 30]) for _ in range(r.choice([0, 1, 30, 400, 5000])))) for i in range(60)] + [(100, None), (101, "<|endoftext|> ΑΣ"), (101, "again")]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    packs = P.packed(P.pieces(df, keep_ids=True))
    got = packs.collect()
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [P.END_ID], "<u4"))
    for d, want in ids.items():
        if len(want) == 1:
            mine = sorted((x for x in got if x.doc_id == d), key=lambda x: x.start)
            at = 0
            for x in mine:
                part = want[0][at : at + x.length].tobytes()
                assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(want[0]), zlib.crc32(part)) and bytes(x.ids) == part
                at += x.length
            assert at == len(want[0])
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for seq in by.values():
        at = 0
        for offset, n in sorted(seq):
            assert offset == at
            at += n
        assert at <= P.CAPACITY
    one = P.padding(packs).first()
    assert one.n_padding < 0.03 * one.n_tokens + P.CAPACITY
    assert {len(bytes(x.ids)) // 4 for x in P.sequences(packs).collect()} <= {P.CAPACITY} | {2**k for k in range(13)}
    assert P.packed(P.pieces(df.limit(0))).count() == 0
    assert all(sum(P.cut_lengths(n)) == n for n in (1, 5, 4095, 4096, 4097, 12_345))


# -- quality rules


def brute_measures(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(win)
    covered = {j for i, x in enumerate(win) if many[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["a", "b", "cé", "#d", "e|", "\n", " x"]) for _ in range(r.choice([0, 2, 3, 60, 300])))) for i in range(80)] + [(100, None), (101, ""), (102, LONG), (102, LONG), (103, "a b c a b c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit(-1)).withColumn("words", F.lit("x"))
    led = Q.ledger(df)
    got = sorted((x.doc_id, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)) for x in led.collect())
    assert got == sorted((d, brute_measures(t)) for d, t in rows)
    kept = Q.apply_rules(df)
    assert kept.columns == df.columns and kept.count() == led.where(Q.verdict()).count()
    rep = {x.rule: x for x in Q.ablation(led, "base").collect()}
    assert rep["too_few_words"].n_failed == sum(brute_measures(t)[0] < 50 for _, t in rows)
    assert Q.ledger(df.limit(0)).count() == 0 and Q.apply_rules(df.limit(0)).count() == 0


# -- chat formatting

NASTY = ["\\### Assistant: </turn> ok", "<turn user>", "\\b\\l\\\\", "", None, "a\nb", "é😀<", "</turn>\n"]


def test_chat_round_trip(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "we>ird<"]), r.choice(NASTY)) for c in range(30) for t in range(r.randint(1, 6))] + [(99, None, "assistant", "x"), (99, 0, None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    want = {}
    for c, t, role, text in sorted(rows, key=lambda x: (x[0], -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    back = C.parsed(C.formatted(C.turns_from_rows(df))).collect()
    assert {x.conv_id: [(t.role, t.text) for t in x.turns] for x in back} == want
    assert {x.conv_id: x.loss_text for x in back} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}
    assert C.formatted(C.turns_from_rows(df.limit(0))).count() == 0


def test_layouts_by_fingerprint(spark):
    rows = [
        (1, json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]})),
        (3, json.dumps({"instruction": "q", "input": "", "output": "a"})),
        (4, json.dumps({"prompt": "q", "completion": "a"})),
        (5, json.dumps({"system": "s", "prompt": "q", "response": "a"})),
        (6, json.dumps({"other": 1})),
        (7, "no json"),
        (8, None),
    ]
    df = spark.createDataFrame(rows, "id long, record string")
    got = {x.id: (x.layout, None if x.turns is None else [(t.role, t.text) for t in x.turns]) for x in C.turns_from_records(df, "id", "record").collect()}
    two = [("user", "q"), ("assistant", "a")]
    assert got == {1: ("openai_messages", two), 2: ("sharegpt", two), 3: ("alpaca", two), 4: ("prompt_completion", two), 5: ("system_prompt_response", [("system", "s"), *two]), 6: (None, None), 7: (None, None), 8: (None, None)}
    assert C.unmapped(df, "record").where("fingerprint IS NOT NULL").count() == 1


# -- language identification


def test_language_gradients():
    net = L.Network(["a", "b"])
    words, labels, weights = np.stack([L.framed(b"def gh"), L.framed("éa".encode())]), np.array([0, 1]), np.array([1.0, 2.0], np.float32)
    _, grads = net.gradients(words, labels, weights)
    for g, p in zip(grads, net.parameters()):
        i = np.unravel_index(np.abs(g).argmax(), p.shape)
        old, losses = p[i], []
        for e in (1e-2, -1e-2):
            p[i] = old + e
            losses.append(net.gradients(words, labels, weights)[0])
        p[i] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - g[i]) < 1e-3


def test_language_held_out_accuracy(spark):
    r = random.Random(6)
    make = {"xx": ["ka", "lo", "mi"], "yy": ["th", "er", "in"], "zz": ["ção", "ñe", "üb"]}
    rows = [(i, " ".join("".join(r.choice(make[k]) for _ in range(3)) for _ in range(20)), k) for i in range(150) for k in [r.choice(list(make))]]
    df = spark.createDataFrame(rows + [(900, None, None), (901, "123 !!", None), (902, LONG, None)], f"{DOCS}, lang string").withColumn("score", F.lit("x"))
    net = L.trained(df)
    got = {x.doc_id: (x.lang_pred, x.score) for x in L.predicted(df, net).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i][0] == k for i, k in held) >= 0.95 * len(held) and held
    assert got[900] == got[901] == ("und", 0.0) and got[902][0] in make and all(0 <= s <= 1 for _, s in got.values())
    assert L.predicted(df, L.trained(df.where("lang IS NULL"))).where("lang_pred <> 'und'").count() == 0


# -- WARC


def test_warc_round_trip_at_any_split(spark, tmp_path):
    r = random.Random(8)
    body = "".join(chr(r.randrange(32, 400)) for _ in range(1200))
    rows = [(i, f"http://h/{i}", r.choice([body, body[:999], "x" * r.randrange(3000), None, "", "\x1f\x8b\x08" * 500])) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    W.write_archives(W.marked(pages), str(tmp_path / "w")).collect()
    data = {i: (h or "").encode() for i, _, h in rows}
    last = {}
    for i, b in data.items():
        if len(b) >= 1000:
            last[b] = max(i, last.get(b, -1))
    want = {i: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if last.get(b, i) != i else "response", last[b] if last.get(b, i) != i else None) for i, b in data.items()}
    for split in (173, 4096, 1 << 30):
        got = W.read_archives(spark, str(tmp_path / "w"), split).collect()
        assert len(got) == len(rows)
        assert {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got} == want
        assert all(bytes(x.payload) == data[x.page_id] for x in got if x.record_type == "response")
    import gzip

    assert gzip.open(next((tmp_path / "w").glob("*.gz"))).read().startswith(b"WARC/1.1")
    W.write_archives(W.marked(pages.limit(0)), str(tmp_path / "e")).collect()
    assert W.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_warc_ties_and_null_ids(spark, tmp_path):
    """Rows that repeat a response are responses, a null id revisits; column pruning keeps the payload in the worker."""
    x, y = "x" * 1500, "y" * 1500
    rows = [(5, x), (5, x), (4, x), (None, x), (None, y), (None, y), (7, "z"), (8, "z")]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").withColumn("keeper", F.lit(9)).repartition(2)
    W.write_archives(W.marked(pages), str(tmp_path / "w")).collect()
    got = W.read_archives(spark, str(tmp_path / "w"), columns=("page_id", "record_type", "refers_to"))
    assert got.columns == ["page_id", "record_type", "refers_to"]
    want = [(5, "response", None), (5, "response", None), (4, "revisit", 5), (None, "revisit", 5), (None, "response", None), (None, "response", None), (7, "response", None), (8, "response", None)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_chat_row_layouts_by_fingerprint(spark):
    """Turn rows keep their roles, other layouts map theirs; both reach the same turns. Ties, nulls and clashing columns."""
    rows = [(1, 0, "human", "q"), (1, 1, "bot", None), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, None, None, "first")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS o", "1 AS turns")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in C.turns_from_rows(plain).collect()}
    assert got == {1: [("human", "q"), ("bot", "")], 2: [("", "first"), ("user", "a"), ("user", "b")]}
    shared = plain.selectExpr("conv_id AS id", "turn", "role AS `from`", "text AS value").where("id = 1")
    chat = {r.id: [tuple(t) for t in r.turns] for r in C.turns_from_rows(shared, "id").collect()}
    record = spark.createDataFrame([(1, '{"conversations": [{"from": "human", "value": "q"}, {"from": "bot", "value": ""}]}'), (2, '{"messages": null}'), (3, '{"messages": []}')], "id long, r string")
    told = {r.id: r.turns and [tuple(t) for t in r.turns] for r in C.turns_from_records(record, "id", "r").collect()}
    assert chat == {1: [("user", "q"), ("assistant", "")]} and told[1] == chat[1]
    assert C.turns_from_rows(plain.limit(0)).count() == 0


def test_chat_table_with_two_row_layouts(spark):
    schema = "conv_id long, turn long, role string, text string, `from` string, value string"
    rows = [
        (1, 0, "user", "a", None, None), (1, 1, None, None, "gpt", "b"), (1, 2, None, None, "human", None), (2, 0, None, "only text", None, None), (2, 1, None, None, None, "only value"), (2, 2, None, None, None, None),
        (3, 0, "bot", "own", "human", "other"), (3, None, "user", "first", None, None), (4, 0, "user", "x", "gpt", None),
    ]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in C.turns_from_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b"), ("user", "")], 2: [("", "only text"), ("", "only value"), ("", "")], 3: [("user", "first"), ("bot", "own")], 4: [("user", "x")]}
    with pytest.raises(ValueError, match="no row mapping"):
        C.turns_from_rows(spark.createDataFrame([(1, "a")], "conv_id long, text string"))


def plain_network(net, text):
    """The same network by plain loops over one text: the sum of its positions' probabilities."""
    import math

    def states(way, symbols):
        h, out = [0.0] * L.HIDDEN, []
        for s in symbols:
            g = [float(v) for v in way.x[s]]
            a = [sum(h[i] * float(way.u[i, j]) for i in range(L.HIDDEN)) for j in range(3 * L.HIDDEN)]
            z, r = ([1 / (1 + math.exp(-(g[k + i] + a[k + i]))) for i in range(L.HIDDEN)] for k in (0, L.HIDDEN))
            new = [math.tanh(g[2 * L.HIDDEN + i] + r[i] * a[2 * L.HIDDEN + i]) for i in range(L.HIDDEN)]
            h = [new[i] + z[i] * (h[i] - new[i]) for i in range(L.HIDDEN)]
            out.append(h)
        return out

    total = [0.0] * len(net.langs)
    at = lambda i: text[i] if 0 <= i < len(text) else L.EDGE
    for start in range(0, len(text), L.CORE):
        core = -(-min(L.CORE, len(text) - start) // L.GRID) * L.GRID
        symbols = [at(i) for i in range(start - L.CONTEXT, start + core + L.CONTEXT)]
        ahead, back = states(net.ways[0], symbols), states(net.ways[1], symbols[::-1])[::-1]
        for i in range(min(core, len(text) - start)):
            both = ahead[L.CONTEXT + i] + back[L.CONTEXT + i]
            e = [math.exp(float(net.bias[k]) + sum(v * float(net.out[j, k]) for j, v in enumerate(both))) for k in range(len(net.langs))]
            total = [t + x / sum(e) for t, x in zip(total, e)]
    return total


def test_language_scores_equal_plain_loops(monkeypatch):
    """The batched network against one that walks over bytes one by one; also when few windows go through at a time."""
    net = L.Network(["a", "b", "c"], seed=4)
    texts = [b"x", "Straße und mehr".encode(), bytes(range(256)) * 2, b"a" * L.CORE, b"b" * (L.CORE + 1), b"c d " * 40]
    want = [plain_network(net, t) for t in texts]
    assert np.abs(net.scores(texts) - np.array(want)).max() < 2e-3
    monkeypatch.setattr(L, "WIDE", 2)
    assert np.abs(net.scores(texts[::-1]) - np.array(want[::-1])).max() < 2e-3
    said = L.predict(net, [t.decode("latin-1") for t in texts] + [None, "", "12 !"])
    assert said[-3:] == [("und", 0.0)] * 3 and said[0][0] == net.langs[int(np.argmax(want[0]))]
    monkeypatch.setattr(L, "TOGETHER", 1)
    again = L.predict(net, [t.decode("latin-1") for t in texts])
    assert [a for a, _ in again] == [a for a, _ in said[:-3]] and [b for _, b in again] == pytest.approx([b for _, b in said[:-3]], abs=1e-5)


def test_language_states_cross_white_space():
    """A position's label depends on the words around its own."""
    net = L.Network(["a", "b"], seed=1)
    one, two = (net._positions(L.framed(t)[None])[0][0:2] for t in (b"de la casa", b"de xx yyyy"))
    assert np.abs(one - two).max() > 1e-6


def test_language_repeated_rows_ties_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc abc", "xx"), (1, "abc abc", "xx"), (2, "abc abc", "yy"), (3, "abc", "yy")], f"{DOCS}, lang string").withColumn("lang_pred", F.lit(1))
    net = L.trained(df, max_pieces=3)
    got = L.predicted(df, net).collect()
    assert len(got) == 4 and got[0] == got[1] and got[0].lang_pred in ("xx", "yy")
    assert L.predicted(df.limit(0), net).count() == 0 and L.trained(df.limit(0)) is None
