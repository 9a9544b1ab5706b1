"""Exact similarity groups by a Jaccard metric-space join.

Documents are sets of word n-grams; 1 - |a & b| / |a | b| is a metric, and documents within
``1 - SIMILARITY`` of each other are linked. In such a space nearly all sets are at distance 1 from
each other, so pivots are drawn where distances can be below 1: linked sets share n-grams among the
first of each in any one global order (:func:`least_shared` at least), and each of those n-grams is a first region.
Then, round by round, until no region spans two components:

- *pivots*: each region takes its most central member of each of a number of hash buckets (:data:`PIVOTS`, and
  :data:`GROWTH` times as many each round); regions with the same pivots are one. The exact distance of every
  member to every pivot of its region is measured, a pivot's own set being sent once to some members
  and never a pair of sets to Spark. Members within the radius are linked;
- *Voronoi cells and windows*: a member belongs to the cell of its nearest pivot, and is replicated into
  the cell of every other pivot that is at most twice the radius farther. By the triangle inequality
  a link between members of a region lies in the home cell of either. Pivots are done with their region;
- *recursion*: inside a cell each set becomes its difference from the pivot, which leaves |x ^ y| as it was
  and takes out what the whole cell shares. Linked sets have |x ^ y| <= (|x| + |y|) / 7, so their differences
  share elements, and the more the farther they are from the pivot; if they share none, both are linked to it
  already. The leading elements of the differences (:func:`leading`) are therefore the regions of the next round.

Not all pairs of a region can give a new link: one of the two is at home in the cell, one is outside the pivot's
component, and in mixed regions (:func:`leading`) one alone is linked to the pivot. The smallest of these sides is
the region's *cover*; pivots come from it, and a region whose cover has no more members than pivots is done
when they are measured. That is the only place where a pair of members is made as such.

From the second round on, a cell of at most :data:`LEAF` members is a *leaf*: it is one region of its own and not cut by elements. Its
sets meet at one pivot in one task, which holds their differences from the pivot and compares those that are not linked to it with
all (:func:`met_in_leaf`). A leaf gives a row for each member, with the links that join others to it.

Before the first round, each set meets the least sets that have one of its :data:`BANDS` least hashes, if they share
:data:`SAME_BANDS` of them: these pivots put nearly all of a group into one component at the cost of a few rows a set.
A link shares as many in 995 of 1000 cases, sets with a common passage rarely do; what is missed is left to the rounds.

Equal sets count once. The global order puts n-grams of crowded hash buckets last, so regions of common
passages are rare; it is a matter of cost alone.

Defined cases: null and empty texts have no n-grams, form no links and are their own component. Fewer
words than n make one n-gram of all. Rows of equal id count as one document. A null id gets a null
component. Repeated rows each get a row. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from palisade.llm.common import arrow_map, scratch, staged, with_small
from palisade.llm.components import components
from palisade.llm.wordhash import SPACE_SPLIT, gathered, mixed, window_hash, words_of

WORDS = 5
SIMILARITY = Fraction(3, 4)
#: Hash buckets whose crowding orders n-grams, in bits; and buckets in a block of them.
BUCKET_BITS, BLOCK_BITS = 24, 16
#: Least hashes of a set, and how many of them it shares with each of the pivots that it tries first.
BANDS, SAME_BANDS = 6, 2
#: Pivots of a region in the first round, and their growth from round to round; a region of n members never has more than the root of n,
#: but for small ones that take all their members: up to GROWTH in the second round, and twice as many in each that follows.
PIVOTS, GROWTH = 1, 32
#: One in so many n-grams makes a prefix longer, and a set without as many shared ones is linked to none.
SHARED = 16
#: Members that meet one copy of their pivot's set; a pivot with more is sent more often.
SPOKES = 128
#: Members of a leaf and n-grams of their sets (16 MB), at most; and the round from which on there are none, so that the rounds end.
LEAF, LEAF_GRAMS, LEAF_UNTIL = 4096, 1 << 21, 5
#: Cells of a matrix that :func:`met_in_leaf` holds.
LEAF_CELLS = 1 << 22


def sets_of(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes, at = words_of(texts, SPACE_SPLIT)
    grams = window_hash(hashes, tuple(range(words)))
    for i in range(len(texts)):
        n = int(at[i + 1] - at[i])
        if n >= words:
            g = np.sort(grams[at[i] : at[i + 1] - words + 1])
            yield g[np.concatenate([[True], g[1:] != g[:-1]])]
        else:
            yield window_hash(hashes[at[i] : at[i + 1]], tuple(range(n))) if n else np.empty(0, np.uint64)


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of sets in one array, the sizes of the sets, and where those that are not empty start."""
    n = np.array([len(g) for g in sets], np.int64)
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), n, (np.cumsum(n) - n)[n > 0]


def digests(sets: list[np.ndarray]) -> list[int]:
    """64 bits of each set, with its size in the mix."""
    grams, n, starts = joined(sets)
    sums = n.astype(np.uint64)
    if len(starts):
        sums[n > 0] += np.add.reduceat(mixed(grams), starts)
    return mixed(sums).view(np.int64).tolist()


def digest(grams: np.ndarray) -> int:
    return digests([grams])[0]


def least_hashes(sets: list[np.ndarray]) -> list[list[int]]:
    """The least hash of each set under each of :data:`BANDS` orders; none of an empty one."""
    grams, n, starts = joined(sets)
    out: list[list[int]] = [[] for _ in sets]
    if len(starts):
        orders = [np.uint64(0x9E3779B97F4A7C15 * (b + 1) & (1 << 64) - 1) for b in range(BANDS)]
        least = np.stack([np.minimum.reduceat(mixed(grams ^ o), starts) for o in orders], axis=1).view(np.int64)
        for i, row in zip(np.flatnonzero(n), least.tolist()):
            out[i] = row
    return out


def profiles(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """From docs(__i, __text): rows of kind 0 with a document's size, digest and least hashes, and of
    kind 1 with a worker's bucket counts, a block each."""
    schema = T.StructType([docs.schema["__i"], *(T.StructField(c, t) for c, t in (("kind", T.IntegerType()), ("n", T.LongType()), ("set", T.LongType()), ("data", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))))])
    blocks = 1 << (BUCKET_BITS - BLOCK_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BUCKET_BITS, np.uint8)
        waiting, size, kind = [], 0, docs_type

        def count() -> None:
            if waiting:
                ids, n = np.unique(np.concatenate(waiting), return_counts=True)
                seen[ids] = np.minimum(seen[ids].astype(np.int64) + n, 255)
                waiting.clear()

        for batch in batches:
            for first, group in gathered(batch.column(1).to_pylist()):
                sets = list(sets_of(group, words))
                rows = [(0, len(g), d, None, b) for g, d, b in zip(sets, digests(sets), least_hashes(sets))]
                waiting.append((joined(sets)[0] >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
                size += len(waiting[-1])
                if size > 1 << 21:
                    count()
                    size = 0
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(rows)), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], schema.names)
        count()
        parts = [(i, part) for i, part in enumerate(seen.reshape(blocks, -1)) if part.any()]
        if parts:
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.array([1] * n, pa.int32()), pa.array([i for i, _ in parts], pa.int64()), pa.nulls(n, pa.int64()), pa.array([zlib.compress(p.tobytes(), 1) for _, p in parts], pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], schema.names)

    docs_type = to_arrow_type(docs.schema["__i"].dataType)
    return arrow_map(docs, run, schema)


def crowded(profile: DataFrame, total: int) -> bytes:
    """One bit for each bucket that is well above the mean of all. 2 MB, whatever the input."""
    mean = total / (1 << BUCKET_BITS)
    limit = 24 + mean + 3 * mean**0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(i, np.zeros(1 << BLOCK_BITS, np.int64))
                own += np.frombuffer(zlib.decompress(data), np.uint8)
        if sums:
            yield pa.RecordBatch.from_pydict({"n": pa.array(list(sums), pa.int64()), "data": pa.array([np.packbits(s > limit).tobytes() for s in sums.values()], pa.binary())})

    flags = bytearray(1 << (BUCKET_BITS - 3))
    step = 1 << (BLOCK_BITS - 3)
    for r in profile.where("kind = 1").select("n", "data").repartition("n").mapInArrow(run, "n long, data binary").collect():
        flags[r["n"] * step : (r["n"] + 1) * step] = r["data"]
    return bytes(flags)


def is_crowded(flags: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Whether each n-gram's bucket is flagged."""
    at = grams >> np.uint64(64 - BUCKET_BITS)
    return (flags[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def prefixes(docs: DataFrame, sent, words: int = WORDS) -> DataFrame:
    """(s, x, w, crowded): the leading n-grams s of each set x, crowded ones last, and the share w of crowded
    ones in all of the set, which is highest in the middle of a group. A worker sends equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, done = np.frombuffer(sent.value, np.uint8), set()
        for batch in batches:
            for _, group in gathered(batch.column(1).to_pylist()):
                grams, owners = [], []
                sets = list(sets_of(group, words))
                for g, d in zip(sets, digests(sets)):
                    if not len(g) or d in done:
                        continue
                    done.add(d)
                    k = min(len(g), len(g) + int(-SIMILARITY * len(g) // 1) + least_shared(len(g)))
                    last = is_crowded(flags, g)
                    lead = g[~last][:k]
                    grams.append(lead if len(lead) == k else np.concatenate([lead, g[last][: k - len(lead)]]))
                    owners.append((d, k, 1000 * int(last.sum()) // len(g)))
                if grams:
                    d, k, w = (np.array(c, np.int64) for c in zip(*owners))
                    s = np.concatenate(grams)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.repeat(d, k)), pa.array(np.repeat(w, k).astype(np.int16)), pa.array(is_crowded(flags, s))], ["s", "x", "w", "crowded"])

    return arrow_map(docs.select("__i", "__text"), run, "s long, x long, w short, crowded boolean")


def least_shared(n: int) -> int:
    """Leading n-grams that a set of n must share with one that is linked to it; prefixes are longer by as many."""
    return 1 + n // SHARED


def first_regions(docs: DataFrame, sent, words: int) -> DataFrame:
    """(s, x, w): leading n-grams that more than one set has, so far as is known: those of crowded buckets are all
    kept, others are compared within their few rows."""
    few = Window.partitionBy("s", "salt")
    rows = prefixes(docs, sent, words).withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64("x"), F.lit(1 << 16))).otherwise(-1))
    rows = rows.select("*", F.min("x").over(few).alias("a"), F.max("x").over(few).alias("b"))
    return staged(rows.where("crowded OR a <> b").select("s", "x", "w").distinct(), "first-regions")


def enough(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of regions (s, x, ...) whose set is in as many regions as a link to another set takes: with the
    longer prefixes, linked sets share as many leading n-grams as the smaller of them must."""
    least = F.expr(f"1 + ((n * {SIMILARITY.numerator} + {SIMILARITY.denominator - 1}) div {SIMILARITY.denominator}) div {SHARED}")
    counts = regions.groupBy("x").agg(F.count("*").alias("k")).join(sizes.select(F.col("set").alias("x"), "n"), "x")
    return with_small(regions, staged(counts.where(F.col("k") >= least).select("x"), "in-regions"), ["x"], "left_semi")


def gram_sets(docs: DataFrame, sizes: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(set, grams): the n-grams of the sets in ``nodes(x)``, from one document each. They are written where they are read,
    without a shuffle: a set is there once for each task that reads a row of its document's id, and :func:`measured` takes one."""
    ids = staged(sizes.join(nodes.withColumnRenamed("x", "set").distinct(), "set").select(F.col("rep").alias("__i")).distinct(), "set-docs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for _, group in gathered(batch.column(1).to_pylist()):
                sets = list(sets_of(group, words))
                found = {d: g.tobytes() for d, g in zip(digests(sets), sets)}
                new = [d for d in found if d not in done]
                done.update(new)
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64()), pa.array([found[d] for d in new], pa.binary())], ["set", "grams"])

    found = arrow_map(with_small(docs.select("__i", "__text"), ids, ["__i"], "left_semi"), run, "set long, grams binary")
    return staged(found, "set-grams")


def leading(own: np.ndarray, pivot: np.ndarray, inside: np.ndarray, missing: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a set's difference from its pivot by which links to sets of other components are found:
    those for any pair, and those for pairs of which one set is linked to the pivot.

    Let a set have e extra elements, q of them crowded, and lack d of the pivot's p. It is linked to the pivot
    if 4 d + 3 e <= p, and two sets x, y are linked if they share, of extra and lacking elements, at least
    (4 (d + d') + 3 (e + e') - p) / 7. For one set and any partner this bounds from below how many of each
    kind are shared; a partner that is not linked to the pivot has 4 d' + 3 e' > p, which says more:

    - extras: (3 e + d - p) / 4, and more than 3 (e - d) / 7; less the q that may be crowded ones;
    - if no rare extra is shared, lacking ones: (4 d + 3 e - 4 q - p) / 3, and more than (4 d + 3 e - 7 q) / 7;
    - if neither is shared, crowded extras: (4 d + 3 e - p) / 4, and more than (4 d + 3 e) / 7.

    Of two sets of different components one at least is not linked to the pivot. Of k elements of which at least m
    are shared, the first k - m + 1 in an order common to the cell suffice. Which kind an element is
    depends on itself and the pivot alone. Elements that most members share come last: a lacking one that is
    rare elsewhere is the pivot's own."""
    extra, lacks = own[~inside], pivot[missing]
    a, b = is_crowded(flags, extra), is_crowded(flags, lacks)
    rare, common, lacks = extra[~a], extra[a], np.concatenate([lacks[b], lacks[~b]])
    e, q, d, p = len(extra), len(common), len(lacks), len(pivot)
    far = 4 * d + 3 * e
    linked = far <= p
    up = lambda n, by: -(-n // by)
    # by kind: the bound for any partner, and that for a partner which is not linked to the pivot
    extras = up(3 * e + d - p, 4), max(up(3 * e + d - p, 4), 3 * (e - d) // 7 + 1)
    lacking = up(far - 4 * q - p, 3), max(up(far - 4 * q - p, 3), (far - 7 * q) // 7 + 1)
    crowd = up(far - p, 4), max(up(far - p, 4), far // 7 + 1)
    first = lambda these, least: these[: max(0, len(these) - max(1, least) + 1)]

    def without_rare(k: int) -> list[np.ndarray]:
        if extras[k] > q:
            return []
        return [first(lacks, lacking[k])] + ([first(common, crowd[k])] if lacking[k] <= 0 else [])

    nothing = lacks[:0]
    return np.concatenate([first(rare, extras[linked] - q), *([] if linked else without_rare(1))]), np.concatenate([nothing, *without_rare(int(linked))])


def met_in_leaf(extras: list[np.ndarray], lacks: list[np.ndarray], p: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the members of a leaf as all their links do, without those through the pivot.

    A member has ``extras`` above its pivot of ``p`` elements and ``lacks`` others of it, so two sets share p - d - d' elements
    and those that their differences share. Members that are linked to the pivot are one component already."""
    e, d = np.array([len(g) for g in extras], np.int64), np.array([len(g) for g in lacks], np.int64)
    n, linked = p + e - d, 4 * d + 3 * e <= p
    _, tokens = np.unique(np.concatenate(extras + lacks), return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(e)), e), np.repeat(np.arange(len(d)), d)])
    is_extra = np.arange(len(tokens)) < e.sum()
    live = np.ones(len(e), bool)
    while True:  # a link shares three quarters of either set: elements of the pivot, and extras that another member has
        held = live[owner]
        times = np.bincount(tokens[held], minlength=int(tokens.max(initial=-1)) + 1)
        met = np.bincount(owner[held & is_extra & (times[tokens] > 1)], minlength=len(e))
        still = live & (SIMILARITY.denominator * (p - d + met) >= SIMILARITY.numerator * n)
        if still.sum() == live.sum():
            break
        live = still
    rows, all_of = np.flatnonzero(live & ~linked), np.flatnonzero(live)
    if not len(rows) or len(all_of) < 2:
        return []
    wanted = np.zeros(len(times), bool)
    wanted[tokens[(live & ~linked)[owner]]] = True
    use = live[owner] & wanted[tokens] & (times[tokens] > 1)
    columns, column = np.unique(tokens[use], return_inverse=True)
    place = np.zeros(len(e), np.int64)
    place[all_of] = np.arange(len(all_of))
    at = place[owner[use]]
    order = np.argsort(column, kind="stable")
    at, column = at[order], column[order]
    width = max(64, LEAF_CELLS // len(all_of))
    high = max(1, LEAF_CELLS // len(all_of))
    root, found = np.where(linked, -1, np.arange(len(e)))[all_of], []
    for first in range(0, len(rows), high):
        these = place[rows[first : first + high]]
        shared = np.zeros((len(these), len(all_of)), np.float32)
        for start in range(0, len(columns), width):
            lo, hi = np.searchsorted(column, [start, start + width])
            block = np.zeros((len(all_of), min(width, len(columns) - start)), np.float32)
            block[at[lo:hi], column[lo:hi] - start] = 1
            shared += block[these] @ block.T
        for i, row in zip(these, shared):
            both = n[all_of[i]] + n[all_of]
            near = np.flatnonzero((SIMILARITY.numerator + SIMILARITY.denominator) * (p - d[all_of[i]] - d[all_of] + row.astype(np.int64)) >= SIMILARITY.numerator * both)
            others, one = np.unique(root[near], return_index=True)
            for other, j in zip(others, near[one]):
                if other != root[i]:
                    found.append((int(all_of[i]), int(all_of[j])))
                    root[root == other] = root[i]
    return found


def measured(pairs: DataFrame, grams: DataFrame, sent, sizes: DataFrame | None = None) -> DataFrame:
    """(x, p, link, dist, lead, mixed, met) of distinct pairs (x, p, cell) of a member x and its pivot p, x <> p.

    A pivot's set and up to :data:`SPOKES` of its members' sets come to one task in turn, so a task
    holds two sets at a time. ``lead``, ``mixed``: :func:`leading`, for the pairs that ``cell`` marks. With ``sizes`` (set, n), pivots
    that are within the bounds of a leaf have ``met``, other members linked to x, in their place, and a task holds a leaf at a time."""
    loads, leaf = pairs.groupBy("p").agg(F.count("*").alias("k"), F.lit(False).alias("leaf")), F.col("leaf")
    if sizes is not None:
        loads = pairs.join(sizes.select(F.col("set").alias("x"), "n"), "x").groupBy("p").agg(F.count("*").alias("k"), (F.bool_or("cell") & (F.count("*") <= LEAF) & (F.sum("n") <= LEAF_GRAMS)).alias("leaf"))
    loads = staged(loads.select("p", leaf, F.when(leaf, 1).otherwise(F.ceil(F.col("k") / SPOKES)).cast("int").alias("copies")), "pivot-loads")
    names = ["p", "part", "role", "x", "cell", "leaf"]
    spokes = pairs.join(loads, "p").select("p", F.pmod(F.xxhash64("x"), F.col("copies")).cast("int").alias("part"), F.lit(1).alias("role"), "x", "cell", "leaf")
    hubs = loads.select("p", F.explode(F.expr("sequence(0, copies - 1)")).alias("part"), F.lit(0).alias("role"), F.col("p").alias("x"), F.lit(False).alias("cell"), "leaf")
    wanted = staged(spokes.select(names).unionByName(hubs.select(names)), "sets-wanted")
    sets = with_small(grams.select(F.col("set").alias("x"), "grams"), wanted, ["x"], "inner")  # the sets themselves move once, to their pivots
    dealt = sets.select(*names, "grams").repartition("p", "part").sortWithinPartitions("p", "part", "role", "x")
    num, den = SIMILARITY.numerator, SIMILARITY.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, hub, last = np.frombuffer(sent.value, np.uint8), np.empty(0, np.uint64), None
        rows, inner = [], []  # inner: a leaf's rows with their differences

        def close() -> None:
            met: dict[int, list[int]] = {}
            for i, j in met_in_leaf([e for _, e, _ in inner], [m for _, _, m in inner], len(hub)) if len(inner) > 1 else ():
                met.setdefault(i, []).append(inner[j][0][0])
            rows.extend((*row, None, None, met.get(i)) for i, (row, _, _) in enumerate(inner))
            inner.clear()

        def told() -> Iterator[pa.RecordBatch]:
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), *[pa.list_(pa.int64())] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["x", "p", "link", "dist", "lead", "mixed", "met"])
                rows.clear()

        for batch in batches:
            for p, part, role, x, cell, whole, g in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6)):
                if last == (last := (p, part, role, x)):
                    continue
                own = np.frombuffer(g.as_buffer(), np.uint64)
                if not role:
                    close()
                    hub = own.copy()
                    continue
                at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                inside = hub[at] == own
                shared = int(inside.sum())
                union = len(own) + len(hub) - shared
                row = x, p, den * shared >= num * union, 1 - shared / union
                if not cell and not whole:
                    rows.append((*row, None, None, None))
                    continue
                missing = np.ones(len(hub), bool)
                missing[at[inside]] = False
                if whole:
                    inner.append((row, own[~inside], hub[missing]))
                else:
                    rows.append((*row, *(of.view(np.int64) for of in leading(own, hub, inside, missing, flags)), None))
            yield from told()
        close()
        yield from told()

    return staged(arrow_map(dealt, run, "x long, p long, link boolean, dist double, lead array<long>, mixed array<long>, met array<long>"), "pivot-distances")


def spanning(regions: DataFrame, labels: DataFrame, name: str = "regions") -> DataFrame:
    """Regions (s, x, home, mixed, link, pc and, if known, c) as (s, x, c, a, m, n, inner): with the component c of x, whether x is in the
    region's cover, the sizes of region and cover, and whether pairs inside the cover matter. ``pc`` is the component of the
    cell's pivot.

    Left out are regions inside one component, those without a member whose home the cell is (its links
    are found in other cells), and mixed ones whose members are all linked to the pivot or all not."""
    named = regions if "c" in regions.columns else regions.join(labels.select(F.col("node").alias("x"), "label"), "x", "left").withColumn("c", F.coalesce("label", "x"))
    sides = {"home": F.col("home"), "out": F.coalesce(F.col("c") != F.col("pc"), F.lit(True)), "link": F.col("link"), "rest": ~F.col("link")}
    rows = staged(named.select("s", "x", "c", "mixed", *[v.alias(k) for k, v in sides.items()]), f"{name}-labelled")
    wide = rows.groupBy("s").agg(F.min("c").alias("__a"), F.max("c").alias("__b"), F.count("*").alias("m"), F.bool_or("mixed").alias("mixed"), *[F.count_if(k).alias(k) for k in sides])
    wide = wide.where("__a <> __b AND home > 0 AND (NOT mixed OR link > 0 AND rest > 0)")
    cover = F.least(*[F.struct(F.when(F.col("mixed") | F.lit(k in ("home", "out")), F.col(k)).otherwise(F.col("m")).alias("n"), F.lit(k).alias("side")) for k in sides])
    wide = staged(wide.withColumn("cover", cover).select("s", "m", "cover.n", "cover.side"), f"{name}-wide")
    a = reduce(lambda rest, k: F.when(F.col("side") == k, F.col(k)).otherwise(rest), sides, F.lit(False))
    return staged(with_small(rows, wide, ["s"], "inner", 4).select("s", "x", "c", a.alias("a"), "m", "n", F.col("side").isin("home", "out").alias("inner")), name)


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (x, p) whose sets are in different components so far."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    return pairs.join(of("x"), "x", "left").join(of("p"), "p", "left").where(F.coalesce("lx", "x") != F.coalesce("lp", "p")).select("x", "p")


def with_pivots(regions: DataFrame, centre: DataFrame, turn: int) -> DataFrame:
    """(g, done, inner, ps, x, c): members of regions with their pivots ``ps`` (p, pc); regions (s, ...) of equal pivots are one.

    A region of a leaf's size takes one pivot. A small region, by its cover, takes all members as pivots and is ``done`` then. Others take at most the root of their size, those that
    are most in the middle by ``centre`` (x, w) and have most company. Small is twice as much every round, so the rounds end."""
    most, small = min(PIVOTS * GROWTH**turn, 1 << 40), PIVOTS if turn == 0 else GROWTH << (turn - 1)
    some = F.least(F.lit(most), F.ceil(F.sqrt("n")).cast("long"))
    leaf = F.lit(0 < turn < LEAF_UNTIL) & (F.col("m") <= LEAF)
    few = (F.col("n") <= small) & ~leaf
    weight = regions.groupBy("x").agg(F.sum("m").alias("company")).join(centre, "x").select("x", F.struct("w", "company").alias("w"))
    bucket = F.when(few, F.col("x")).when(leaf, 0).otherwise(F.pmod(F.xxhash64("x", F.lit(turn)), some))
    ranked = regions.where("a").join(weight, "x").groupBy("s", bucket.alias("bucket")).agg(F.max(F.struct("w", F.struct(F.col("x").alias("p"), F.col("c").alias("pc")).alias("p"))).alias("best"), F.first("inner").alias("inner"), F.bool_or(few).alias("done"))
    chosen = ranked.groupBy("s").agg(F.array_sort(F.collect_set("best.p")).alias("ps"), F.first("inner").alias("inner"), F.first("done").alias("done"))
    chosen = staged(chosen.withColumn("g", F.xxhash64(F.col("ps")["p"], "inner", "done")), "pivots")
    groups = chosen.groupBy("g").agg(*[F.first(c).alias(c) for c in ("done", "inner", "ps")])
    return staged(regions.select("s", "x", "c").join(chosen.select("s", "g"), "s").select("g", "x", "c").distinct().join(groups, "g"), "members")


def star(members: DataFrame) -> DataFrame:
    """(x, p, cell): the pairs to measure. Those of regions that are done need no differences, and no pairs inside a component."""
    both = F.array_contains(F.col("ps")["p"], F.col("x"))
    rows = members.select("x", "c", "done", "inner", both.alias("both"), F.explode("ps").alias("v")).select("*", "v.p", "v.pc")
    rows = rows.where("x <> p AND NOT (both AND p > x) AND NOT (done AND (c = pc OR both AND NOT inner))")
    return rows.groupBy("x", "p").agg(F.bool_or(~F.col("done") & ~F.col("both")).alias("cell"))


def cells(members: DataFrame, found: DataFrame) -> DataFrame:
    """(x, p, home): each member in the cell of its nearest pivot, its home, and in those of pivots within the
    window. ``found`` holds the measured distances; pivots themselves are in no cell of their own region."""
    rest = members.where(~F.col("done") & ~F.array_contains(F.col("ps")["p"], F.col("x"))).select("g", "x", F.explode(F.col("ps")["p"]).alias("p"))
    told = rest.join(found.select("x", "p", "dist"), ["x", "p"])
    nearest = F.min(F.struct("dist", "p")).over(Window.partitionBy("g", "x"))  # one row a pivot of the region
    told = told.withColumn("near", nearest).where(F.col("dist") <= F.col("near.dist") + 2 * float(1 - SIMILARITY) + 1e-9)
    return told.groupBy("x", "p").agg(F.bool_or(F.col("p") == F.col("near.p")).alias("home"))


def linked(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id): a row for each row of ``docs``."""
    own = docs.select(F.col(id_col).alias("__i"), F.col(text).alias("__text"))
    with scratch(docs.sparkSession) as keep:
        rows, named = (keep(t) for t in _grouped(own, words))
    out = rows.join(named, "set", "left")
    real_set = (F.col("n") > 0) & F.col("__i").isNotNull()
    return out.select(F.col("__i").alias(id_col), F.col("n").alias("n_shingles"), F.when(real_set, F.col("component")).otherwise(F.col("__i")).alias("component_id"))


def _grouped(own: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Tables (__i, n, set) of all rows and (set, component) of all sets that are not empty."""
    with scratch(own.sparkSession) as keep:
        profile = staged(profiles(own, words), "profiles")
        rows = keep(staged(profile.where("kind = 0").select("__i", "n", "set"), "rows"))
        total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sets = profile.where("kind = 0 AND n > 0 AND __i IS NOT NULL").groupBy("set")
        sizes = keep(staged(sets.agg(F.min("__i").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets"))
        sent = own.sparkSession.sparkContext.broadcast(crowded(profile, total))
    real = own.where(F.col("__i").isNotNull())
    links: list[DataFrame] = []

    def meet(pairs: DataFrame, grams: DataFrame, *leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Measure pairs (x, p, cell), with the sizes of sets where there are leaves; the measures and the labels of all links so far."""
        found = measured(staged(pairs, "pairs"), grams, sent, *leaves)
        new = found.where("link").select(F.col("x").alias("a"), F.col("p").alias("b"))
        if leaves:
            new = new.unionByName(found.where("met IS NOT NULL").select(F.col("x").alias("a"), F.explode("met").alias("b")))
        links.append(staged(new, "found-links"))
        return found, components(reduce(DataFrame.unionByName, links))

    # pivots by least hashes: first the least one of each set, then the others that are in another component
    with scratch(own.sparkSession) as keep:
        banded = sizes.select(F.col("set").alias("x"), F.posexplode("bands").alias("band", "h"))
        least = staged(banded.groupBy("band", "h").agg(F.min("x").alias("p"), F.count("*").alias("k")).where("k > 1").select("band", "h", "p"), "band-pivots")
        tried = with_small(banded, least, ["band", "h"], "inner").where("x <> p").groupBy("x", "p").count()
        tried = staged(tried.where(F.col("count") >= SAME_BANDS).select("x", "p"), "band-pairs")
        grams = gram_sets(real, sizes, tried.select("x").union(tried.select("p")), words)
        _, labels = meet(tried.groupBy("x").agg(F.min("p").alias("p"), F.lit(False).alias("cell")), grams)
        _, labels = meet(apart(tried, labels).withColumn("cell", F.lit(False)), grams)
        for kept in (*links, labels):
            keep(kept)

    plain = {"home": F.lit(True), "mixed": F.lit(False), "link": F.lit(False), "pc": F.lit(None).cast("long")}
    with scratch(own.sparkSession) as keep:
        found = first_regions(real, sent, words)
        centre = keep(staged(found.select("x", "w").distinct(), "centre"))
        regions = spanning(enough(found, sizes).withColumns(plain), labels)
        regions = keep(spanning(enough(regions, sizes).withColumns(plain), labels))
    grams = gram_sets(real, sizes, regions.select("x"), words)
    turn = 0
    while not regions.isEmpty():
        with scratch(own.sparkSession) as keep:
            members = with_pivots(regions, centre, turn)
            found, labels = meet(star(members), grams, *[sizes] * (0 < turn < LEAF_UNTIL))
            inside = found.where("lead IS NOT NULL").join(staged(cells(members, found), "cells"), ["x", "p"])
            parent = labels.select(F.col("node").alias("p"), F.col("label").alias("pc"))
            inside = staged(inside.join(parent, "p", "left").withColumn("pc", F.coalesce("pc", "p")), "cell-members")
            wide = spanning(inside.select(F.col("p").alias("s"), "x", "home", F.lit(False).alias("mixed"), "link", "pc"), labels, "cells-by-component")
            kinds = F.array(F.struct(F.lit(False).alias("mixed"), F.col("lead").alias("of")), F.struct(F.lit(True).alias("mixed"), F.col("mixed").alias("of")))
            again = inside.join(wide.select(F.col("s").alias("p"), "x", "c", "m"), ["p", "x"])
            leaf = F.lit(turn + 1 < LEAF_UNTIL) & (F.col("m") <= LEAF)
            names = ["p", "pc", "x", "c", "home", "link"]
            # who has no leading element has no link to find
            whole = again.where(leaf & (F.size("lead") + F.size(F.col("mixed")) > 0)).select(*names, F.lit(False).alias("mixed"), F.xxhash64("p").alias("s"))
            again = again.where(~leaf).select(*names, F.explode(kinds).alias("k"))
            again = again.select(*names, "k.mixed", F.explode("k.of").alias("e")).select(*names, "mixed", F.xxhash64("p", "mixed", "e").alias("s")).unionByName(whole)
            regions, turn = keep(spanning(again, labels)), turn + 1
            keep(labels)
            keep(links[-1])
    named = sizes.select("set", F.col("rep").alias("component"))
    if not labels.isEmpty():
        groups = staged(sizes.select("set", "rep").join(labels.select(F.col("node").alias("set"), "label"), "set"), "groups")
        least = staged(groups.groupBy("label").agg(F.min("rep").alias("least")), "group-ids")
        known = staged(groups.join(least, "label").select("set", "least"), "set-ids")
        named = named.join(known, "set", "left").select("set", F.coalesce("least", "component").alias("component"))
    return rows, staged(named, "set-ids")
