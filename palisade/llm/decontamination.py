"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case words. A seed is the hash of the words that a fixed mask selects from a
window, so substituted words at ignored positions leave it alone. Seeds of the benchmark are joined
with those of the documents; a hit fixes a document, an item and a diagonal, and on that diagonal the
best-scoring runs of matching words (a match 1, a substitution -1.5) are the overlaps: the best one, then the best
to its left and right, for as long as they hold :data:`MIN_ITEM` matches. An item is found in a document if its
overlaps match at least :data:`MIN_WORDS` of its words, or three fifths of a shorter item, and one overlap alone matches
:data:`MIN_RUN` of them, or as many as the item needs at all; substituted words do not count. The second bound keeps items apart that
share many five-word phrases with a text without any longer passage.

The benchmark is a query set: it is taken in blocks of at most ``block_words`` words, each of which
workers hold whole; every block meets all rows, and no row is shuffled.

Defined cases: null and empty texts match nothing. Items of fewer than five words are never
found. Items with equal texts are each found. Repeated documents each get their rows. Empty tables give no
rows. Extra columns are ignored by :func:`contaminated` and kept by :func:`decontaminated`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import arrow_map
from palisade.llm.wordhash import ALNUM_SPLIT, gathered, window_hash, words_of

#: Fixed masks: 1 a word that counts, 0 one that is ignored. They pass substitutions of every fourth
#: and every third word, and irregular ones.
MASKS = ("1110111", "11011011", "1010011011", "11111")
MIN_WORDS = 10
MIN_ITEM = 5
#: Matching words that one overlap of a found item has at least.
MIN_RUN = 6
#: Words of the benchmark in a block: some 64 MB of seeds in a worker.
BLOCK_WORDS = 1_000_000
#: Bits of the first look at a seed.
FIRST_BITS = 20


def normal_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return words_of([t.lower() for t in texts], ALNUM_SPLIT)


def offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


class Seeds:
    """The seeds of some items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words, self.at = normal_words([t for _, t in items])
        owner = np.repeat(np.arange(len(items)), np.diff(self.at))
        self.tables = []
        for mask in MASKS:
            span = offsets(mask)
            h = window_hash(self.words, span)
            n = len(h)
            inside = owner[:n] == owner[span[-1] :][:n]
            pos = np.flatnonzero(inside)
            order = np.argsort(h[pos], kind="stable")
            first = np.zeros(1 << FIRST_BITS, bool)
            first[h[pos] >> np.uint64(64 - FIRST_BITS)] = True
            self.tables.append((span, h[pos][order], pos[order], first))
        self.owner = owner

    def diagonals(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (document, item, document word - item word) of all seed hits."""
        found = []
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        for span, hashes, pos, first in self.tables:
            h = window_hash(words, span)
            if not len(h) or not len(hashes):
                continue
            hit = np.flatnonzero(first[h >> np.uint64(64 - FIRST_BITS)])
            hit = hit[doc[hit] == doc[hit + span[-1]]]
            low, high = np.searchsorted(hashes, h[hit], "left"), np.searchsorted(hashes, h[hit], "right")
            n = high - low
            at = np.repeat(hit, n)
            which = pos[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            item = self.owner[which]
            found.append(np.stack([doc[at], item, (at - begin[doc[at]]) - (which - self.at[item])], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def overlaps(self, words: np.ndarray, item: int, diagonal: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """The runs on a diagonal: item positions that match, first word in the item and in the document."""
        own = self.words[self.at[item] : self.at[item + 1]]
        a, b = max(0, -diagonal), min(len(own), len(words) - diagonal)
        same = own[a:b] == words[a + diagonal : b + diagonal]
        open_ranges = [(0, b - a)]
        while open_ranges:
            low, high = open_ranges.pop()
            part = same[low:high]
            if part.sum() < MIN_ITEM:
                continue
            total = np.concatenate([[0.0], np.cumsum(np.where(part, 1.0, -1.5))])
            end = int((total[1:] - np.minimum.accumulate(total[:-1])).argmax()) + 1
            start = int(total[:end].argmin())
            if part[start:end].sum() >= MIN_ITEM:
                yield a + low + start + np.flatnonzero(part[start:end]), a + low + start, a + low + start + diagonal
                open_ranges += [(low, low + start), (low + end, high)]

    def found_in(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item, matched words, item words, first item word, first document word)."""
        words, begin = normal_words(texts)
        groups: dict[tuple[int, int], list[int]] = {}
        for d, i, g in self.diagonals(words, begin).tolist():
            groups.setdefault((d, i), []).append(g)
        for (d, i), diagonals in groups.items():
            size = int(self.at[i + 1] - self.at[i])
            covered, best = np.zeros(size, bool), (0, 0, 0)
            for g in diagonals:
                for matches, own, other in self.overlaps(words[begin[d] : begin[d + 1]], i, g):
                    covered[matches] = True
                    best = max(best, (len(matches), own, other))
            need = min(MIN_WORDS, math.ceil(0.6 * size))
            if size >= MIN_ITEM and covered.sum() >= need and best[0] >= min(need, MIN_RUN):
                yield d, i, int(covered.sum()), size, best[1], best[2]


def blocks_of(benchmark: DataFrame, item_col: str, item_text: str, block_words: int) -> list[DataFrame]:
    """The benchmark in blocks of about ``block_words`` words each, by a hash of the item."""
    bench = benchmark.select(F.col(item_col).alias("__i"), F.col(item_text).alias("__t")).where("__t IS NOT NULL")
    total = bench.agg(F.sum(F.regexp_count("__t", F.lit("\\s")) + 1)).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    return [bench.where(F.pmod(F.xxhash64("__i", "__t"), F.lit(n)) == b) for b in range(n)] if n > 1 else [bench]


def sent_items(bench: DataFrame):
    """A block's items, broadcast: at most about ``block_words`` words."""
    return bench.sparkSession.sparkContext.broadcast([(r["__i"], r["__t"]) for r in bench.collect()])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, item id, n_matched, n_item_words, item_start, doc_start): a row for each document and item found in it."""
    rows = docs.select(F.col(id_col), F.col(text).alias("__text"))
    ints = ["n_matched", "n_item_words", "item_start", "doc_start"]
    schema = T.StructType([rows.schema[0], T.StructField(item_col, benchmark.schema[item_col].dataType), *(T.StructField(c, T.LongType()) for c in ints)])

    def block(bench: DataFrame) -> DataFrame:
        sent = sent_items(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(sent.value)
            for batch in batches:
                out = [(first + d, seeds.ids[i], *rest) for first, group in gathered(batch.column(1).to_pylist()) for d, i, *rest in seeds.found_in(group)]
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c) for c in cols[1:])], schema.names)

        return arrow_map(rows, run, schema)

    return reduce(DataFrame.unionByName, map(block, blocks_of(benchmark, item_col, item_text, block_words)))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found. No row is shuffled."""
    for bench in blocks_of(benchmark, item_col, item_text, block_words):
        sent = sent_items(bench)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(sent.value)
            for batch in batches:
                bad = {first + hit[0] for first, group in gathered(batch.column(text).to_pylist()) for hit in seeds.found_in(group)}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs
