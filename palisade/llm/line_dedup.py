"""Line deduplication by a deletion-neighbourhood join, in DataFrame expressions only.

A line goes if an earlier line, kept or not, is within :data:`BOUND` edit of it (one inserted, deleted or
replaced character); earlier is by (document id, line number). Lines shorter than ``min_chars`` go only if
equal to an earlier one; lines without a word stay. With ``words`` a line goes also if an earlier one is within
:data:`BOUND` edit in words (one inserted, deleted or replaced), both having ``min_chars`` characters and
:data:`MIN_LINE_WORDS` words; white space between words does not count there.

The neighbourhood of a line is the line itself and all its one-character deletions. Two lines are within
one edit exactly if they share a string s such that one of them is s and the other becomes s by a
deletion, or both become s by a deletion at one position. Emitting that for every character of a corpus is
out of reach, so the join narrows first, without losing a pair: of a line cut into blocks an edit touches
one, so both lines agree on all but that block. Level one keys a line by everything but one block, level
two does the same inside blocks that met another line, and only blocks that still have company emit
their neighbourhoods. Every level compares keys, never pairs: a group needs its earliest line alone. Words take
the same way, with arrays of words in place of strings (:class:`Unit`).

Defined cases: null texts stay null, empty ones empty. Rows equal in id and text are one document,
and each row keeps the same lines; rows of equal id and other texts are told apart by the text. Null ids sort
first. Extra columns are kept, but for those named like an output (:data:`OUTPUTS`), which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import BROADCAST_ROWS, WORD, scratch, staged, with_small

BOUND = 1
#: Columns that :func:`deduplicated` adds; those of these names in its input are replaced.
OUTPUTS = ("__n_lines", "__n_removed")
MIN_CHARS = 20
MIN_LINE_WORDS = 5
#: Characters of a block at either level, and most blocks of a line or a block.
BLOCK, SMALL, MOST = 128, 16, 64


@dataclass(frozen=True)
class Unit:
    """What an edit changes: characters of a string, or words of an array. ``block`` and ``small`` are the
    items of a block at either level."""

    words: bool
    block: int
    small: int

    def size(self, s: str) -> str:
        return f"size({s})" if self.words else f"length({s})"

    def part(self, s: str, start: str, count: str) -> str:
        return f"slice({s}, {start}, greatest(0, {count}))" if self.words else f"substring({s}, {start}, {count})"

    def rest(self, s: str, start: str) -> str:
        return f"slice({s}, {start}, size({s}))" if self.words else f"substring({s}, {start})"

    def items(self, line: str, min_chars: int) -> Column:
        """The line as its items; a line too short for a near copy has no words."""
        if not self.words:
            return F.col(line)
        return F.when(F.length(line) >= min_chars, F.regexp_extract_all(line, F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def least(self, min_chars: int) -> int:
        return MIN_LINE_WORDS if self.words else min_chars

    def close(self) -> Column:
        """True if ``part`` and ``o.part`` are within :data:`BOUND` edit."""
        if not self.words:
            return F.levenshtein("part", "o.part") <= BOUND
        shorter = lambda a, b: f"size({a}) + 1 = size({b}) AND exists(sequence(0, size({b}) - 1), p -> concat(slice({b}, 1, p), slice({b}, p + 2, size({b}))) = {a})"
        equal = "size(part) = size(o.part) AND size(filter(zip_with(part, o.part, (a, b) -> a <> b), x -> x)) <= 1"
        return F.expr(f"({equal}) OR ({shorter('part', 'o.part')}) OR ({shorter('o.part', 'part')})")


CHARS = Unit(False, BLOCK, SMALL)
WORDS = Unit(True, 16, 4)


def line_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(__d, __t, __n, line, h1, h2) for each line with a word: place, line, 128 bits of hash. A text is hashed once, before it is cut into lines."""
    texts = docs.select(F.col(id_col).alias("__d"), F.xxhash64(text).alias("__t"), F.col(text).alias("__text"))
    rows = texts.select("__d", "__t", F.posexplode(F.split("__text", "\n")).alias("__n", "line"))
    return rows.where(F.col("line").rlike("[^\\x20\\x09-\\x0D]")).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line"))


def block_keys(least: int, unit: Unit = CHARS) -> Column:
    """Keys of ``line`` (``n`` items, ``least`` or more) by everything but one block, as a shorter and as a longer partner.

    ``m`` is the shorter length of a pair, ``x`` the items that this line has above it."""

    def of(x: int) -> str:
        m = f"(n - {x})"
        count = f"least({MOST}, greatest(2, cast(ceil({m} / {unit.block}) as int)))"
        width = f"cast(ceil({m} / {count}) as int)"
        return (
            f"transform(sequence(0, {count} - 1), j -> struct({x} as x, j, xxhash64({m}, j, {unit.part('line', '1', f'j * {width}')}, {unit.rest('line', f'(j + 1) * {width} + {x} + 1')}) as key,"
            f" j * {width} as at, least({width}, {m} - j * {width}) + {x} as size))"
        )

    return F.expr(f"filter(if(n >= {least}, concat({of(0)}, {of(1)}), array()), b -> b.size >= 1)")


def company(rows: DataFrame, key: str = "key") -> DataFrame:
    """The rows of a written table whose key another line has too. Keys are aggregated, so a hot one is no task's."""
    shared = rows.groupBy(key).agg(F.min("h1").alias("__a"), F.max("h1").alias("__b")).where("__a <> __b").select(key)
    return with_small(rows, staged(shared, "line-shared"), [key], "left_semi")


def char_keys(least: int) -> Column:
    """The keys of :func:`block_keys` for ``line``; those of two blocks, as nearly all lines have, are written out without lambdas."""
    keys = []
    for x in (0, 1):
        m = f"(n - {x})"
        width = f"cast(({m} + 1) div 2 as int)"
        keys += [f"xxhash64({m}, 0, '', substring(line, {width} + {x} + 1))", f"xxhash64({m}, 1, substring(line, 1, {width}), substring(line, 2 * {width} + {x} + 1))"]
    two = F.expr(f"n >= greatest({least}, 3) AND n <= {2 * CHARS.block}")
    return F.when(two, F.expr(f"array({', '.join(keys)})")).otherwise(F.transform(block_keys(least), lambda b: b["key"]))


def near_duplicates(lines: DataFrame, first: DataFrame, min_chars: int = MIN_CHARS, unit: Unit = CHARS, keys: str = "keys") -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one edit.

    ``lines`` as :func:`line_rows` gives them, ``first`` (h1, h2, place, and the unit's ``keys``) the distinct ones."""
    level1 = staged(company(first.where(F.size(keys) > 0).select("h1", "h2", F.explode(keys).alias("key"))), "line-blocks")
    ids = staged(level1.select("h1", "h2").distinct(), "line-live")
    texts = with_small(lines.select("h1", "h2", "line", F.length("line").alias("n")), ids, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    texts = staged(texts, "line-texts")
    if unit.words:
        texts = texts.withColumn("line", unit.items("line", min_chars)).withColumn("n", F.size("line"))
    found = with_small(first.select("h1", "h2", "place"), ids, ["h1", "h2"], "left_semi")
    blocks = texts.join(found, ["h1", "h2"]).withColumn("b", F.explode(block_keys(unit.least(min_chars), unit))).select("h1", "h2", "place", "b.x", F.col("b.key").alias("key"), F.expr(unit.part("line", "b.at + 1", "b.size")).alias("block"))
    blocks = blocks.join(level1.select("h1", "h2", "key").distinct(), ["h1", "h2", "key"], "left_semi")
    blocks = blocks.withColumn("m", F.expr(unit.size("block")) - F.col("x"))
    count = f"least({MOST}, greatest(1, cast(ceil(m / {unit.small}) as int)))"
    width = f"cast(ceil(m / {count}) as int)"
    small = F.expr(
        f"transform(sequence(0, {count} - 1), j -> struct(xxhash64(key, m, j, {unit.part('block', '1', f'j * {width}')}, {unit.rest('block', f'(j + 1) * {width} + x + 1')}) as key,"
        f" {unit.part('block', f'j * {width} + 1', f'least({width}, m - j * {width}) + x')} as part))"
    )
    parts = staged(blocks.select("h1", "h2", "place", F.explode(small).alias("s")).select("h1", "h2", "place", F.col("s.key").alias("key"), F.col("s.part").alias("part")), "line-parts")
    level2 = company(parts)
    # deletions: as one side of an insertion (any position) and of a replacement (that position)
    cut = f"concat({unit.part('part', '1', 'p')}, {unit.rest('part', 'p + 2')})"
    spots = f"if({unit.size('part')} = 0, cast(array() as array<int>), sequence(0, {unit.size('part')} - 1))"
    variants = F.expr(
        f"concat(array(struct(xxhash64(key, -1, part) as v, 0 as kind)), array_distinct(transform({spots}, p -> struct(xxhash64(key, -1, {cut}) as v, 1 as kind))),"
        f" transform({spots}, p -> struct(xxhash64(key, p, {cut}) as v, 2 as kind)))"
    )
    near = staged(level2.withColumn("v", F.explode(variants)).select("h1", "h2", "place", "part", "v.v", "v.kind"), "line-variants")
    earliest = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("place", "part")))
    met = near.groupBy("v").agg(earliest(0).alias("own"), earliest(1).alias("cut"), earliest(2).alias("at"), F.count("*").alias("k")).where("k > 1").drop("k")
    other = F.when(F.col("kind") == 0, F.col("cut")).when(F.col("kind") == 1, F.col("own")).otherwise(F.col("at"))
    near = near.join(met, "v").withColumn("o", other).where(F.col("o").isNotNull() & (F.col("o.place") < F.col("place")) & unit.close())
    return near.select("h1", "h2").distinct()


def kept_places(docs: DataFrame, id_col: str, text: str, min_chars: int, words: bool = False) -> DataFrame:
    """(__d, __t, __n) of the lines that stay, a row a distinct line."""
    lines = line_rows(docs, id_col, text)
    keyed = lines.withColumn("n", F.length("line")).withColumn("keys", char_keys(min_chars))
    aggs = [F.first("keys").alias("keys")]
    if words:
        split = keyed.withColumn("line", WORDS.items("line", min_chars)).withColumn("n", F.size("line"))
        keyed = split.withColumn("word_keys", F.transform(block_keys(WORDS.least(min_chars), WORDS), lambda b: b["key"]))
        aggs.append(F.first("word_keys").alias("word_keys"))
    first = staged(keyed.groupBy("h1", "h2").agg(F.min(F.struct("__d", "__t", "__n")).alias("place"), *aggs), "line-first")
    near = near_duplicates(lines, first, min_chars)
    if words:
        near = near.union(near_duplicates(lines, first, min_chars, WORDS, "word_keys")).distinct()
    dups = staged(near, "line-near")
    return with_small(first.select("h1", "h2", "place"), dups, ["h1", "h2"], "left_anti").select("place.*")


def n_wordy(text) -> Column:
    """Lines with a word: one match from a line's first such character to its end, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D][^\\n]*")), F.lit(0))


def changed_documents(docs: DataFrame, id_col: str, text: str, min_chars: int, words: bool = False) -> DataFrame:
    """(__d, __t, __keep): documents that lose lines, with the numbers of those that stay."""
    kept = kept_places(docs, id_col, text, min_chars, words).groupBy("__d", "__t").agg(F.collect_set("__n").alias("__keep"))
    sizes = docs.select(F.col(id_col).alias("__d"), F.xxhash64(text).alias("__t"), n_wordy(F.col(text)).alias("__all")).where("__all > 0").distinct()
    same = sizes["__d"].eqNullSafe(kept["__d"]) & (sizes["__t"] == kept["__t"])
    return sizes.join(kept, same, "left").where(F.coalesce(F.size("__keep"), F.lit(0)) < F.col("__all")).select(sizes["__d"], sizes["__t"], F.coalesce("__keep", F.array().cast("array<int>")).alias("__keep"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, words: bool = False) -> DataFrame:
    """``docs`` with the text's repeated lines taken out, and __n_lines, __n_removed (lines with a word).

    Documents that lose nothing are told by counts alone; the others' line numbers meet their texts."""
    with scratch(docs.sparkSession) as keep:
        changed = keep(staged(changed_documents(docs, id_col, text, min_chars, words), "line-changed"))
    n_docs, n_kept = changed.agg(F.count("*"), F.coalesce(F.sum(F.size("__keep")), F.lit(0))).first()
    side = F.broadcast(changed) if n_docs <= BROADCAST_ROWS and n_kept <= 4 * BROADCAST_ROWS else changed
    rows = docs.join(side, docs[id_col].eqNullSafe(side["__d"]) & (F.xxhash64(docs[text]) == side["__t"]), "left")
    t = docs[text]
    parts = F.split(t, "\n")
    blank = F.filter(F.transform(parts, lambda x, i: F.when(~x.rlike("[^\\x20\\x09-\\x0D]"), i)), lambda i: i.isNotNull())
    rest = F.array_join(F.transform(F.array_sort(F.concat(side["__keep"], blank)), lambda i: F.get(parts, i)), "\n")
    gone = side["__keep"].isNotNull()
    own = [F.when(gone, rest).otherwise(docs[c]).alias(c) if c == text else docs[c] for c in docs.columns if c not in OUTPUTS]
    return rows.select(*own, n_wordy(t).cast("long").alias("__n_lines"), F.when(gone, n_wordy(t) - F.size(side["__keep"])).otherwise(F.lit(0)).cast("long").alias("__n_removed"))
