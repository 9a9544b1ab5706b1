"""Hard-negative mining by blocked dense products.

The anchors are cut into blocks of bounded bytes. A block is broadcast; tasks multiply it with their blocks of
candidates in float64. Components are whole numbers, so products are exact as long as a bound on them stays under 2^53;
blocks beyond that are multiplied in Python's integers. A first pass keeps of each task the best
positives of every anchor, which merge by (score, id); a second pass keeps for each anchor and positive the best negatives whose
score lies in the window that the positive sets. A task's state is the anchors of a block times a few places,
whatever the number of candidates, and no pair of rows is shuffled but those.

Work grows with anchors x rows, as the question asks for every anchor's exact neighbours.

Defined results. Rows without an id, a label or a vector, or with a null or non-finite component, take no part. Rows of
different vector lengths have no score with each other. Rows that share an id count each for themselves, and a row is
never the partner of one with its own id. Ties go to the smaller id. Scores beyond 64 bits are cut at
the ends of a long. An anchor without positives, or whose windows are empty, gives no rows; an empty table gives none.
Columns beyond the three named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import arrow_map, scratch, staged, staged_path

#: Bytes of a broadcast anchor block; anchors times candidates of one product.
BLOCK_BYTES, PRODUCT_CELLS = 8 << 20, 1 << 20
#: Components become floor(SCALE * x).
SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
#: A negative's score, times 100, lies between these shares of the positive's.
WINDOW = (50, 95)
#: Below this bound all sums, and 100 times them, are exact in float64.
EXACT = 2.0**46
LONG = np.iinfo(np.int64)


def usable(vector: str) -> Column:
    """The vector has no null and no non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def by_length(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Usable rows of a batch (id, label, vector) by vector length: ids, labels, scaled vectors; in id order."""
    ids, labels, vectors = (batch.column(i) for i in range(3))
    live = pc.and_(pc.is_valid(ids), pc.and_(pc.is_valid(labels), pc.is_valid(vectors)))
    rows = pa.Table.from_batches([batch]).filter(live).combine_chunks()
    if not len(rows):
        return {}
    ids, labels = (rows.column(i).to_numpy().astype(np.int64) for i in range(2))
    vectors = rows.column(2).combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        matrix = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        at, matrix = (x[np.isfinite(matrix).all(axis=1)] for x in (at, matrix))
        order = np.argsort(ids[at], kind="stable")
        if len(order):
            out[int(d)] = ids[at][order], labels[at][order], np.floor(SCALE * matrix[order])
    return out


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Whole inner products: float64 where that is exact, else Python integers within a long."""
    most = max(1, anchors.shape[1]) * float(np.abs(anchors).max(initial=0)) * float(np.abs(candidates).max(initial=0))
    if most < EXACT:
        return anchors @ candidates.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(anchors) @ whole(candidates).T, int(LONG.min), int(LONG.max))


def merged(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row of two sets of columns. Places without a partner have the lowest long as score."""
    s, i = np.concatenate([scores, more_scores], axis=1), np.concatenate([ids, more_ids], axis=1)
    order = np.argsort(i, axis=1, kind="stable")
    s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    order = np.argsort(~s, axis=1, kind="stable")[:, :k]  # ~s falls as s rises, without overflow
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Block:
    """Anchors of one length, and what a task keeps of their partners: ``places`` best for each of ``windows``."""

    def __init__(self, index, ids, labels, matrix, low=None, high=None):
        self.index, self.ids, self.labels, self.matrix = index, ids, labels, matrix
        #: (anchors, positives): the bounds of 100 x a negative's score; without them positives are sought.
        self.low, self.high = low, high
        self.windows, self.places = (1, POSITIVES) if low is None else (low.shape[1], NEGATIVES)
        shape = (len(ids) * self.windows, self.places)
        self.scores, self.found = np.full(shape, LONG.min), np.zeros(shape, np.int64)

    def meet(self, ids, labels, matrix) -> None:
        """Take candidates (in id order) into account."""
        step = max(1, PRODUCT_CELLS // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            rows = slice(at, at + step)
            score = products(self.matrix[rows], matrix)
            same = self.labels[rows, None] == labels[None, :]
            if self.low is None:
                self._keep(rows, score, same & (self.ids[rows, None] != ids[None, :]), ids, None, None)
            else:
                self._keep(rows, score, ~same, ids, self.low[rows], self.high[rows])

    def _keep(self, rows, score, fits, ids, low, high) -> None:
        m, w, k = score.shape[1], self.windows, self.places
        if score.dtype == object:
            key = np.where(fits, score, None)
            order = np.array([sorted(range(m), key=lambda j: (r[j] is None, -(r[j] or 0), j)) for r in key]).reshape(-1, m)
        else:
            order = np.argsort(np.where(fits, -score, np.inf), axis=1, kind="stable")  # ties stay in id order
        ranked = np.take_along_axis(score, order, 1)
        n = fits.sum(axis=1)
        places = np.zeros((len(ranked), w), np.int64)
        if low is not None:
            for r, row in enumerate(ranked):  # falling scores: the first that is not above the window
                falling = [-100 * x for x in row[: n[r]]] if score.dtype == object else -100 * row[: n[r]]
                places[r] = [next((j for j, x in enumerate(falling) if x >= -h), n[r]) for h in high[r]] if score.dtype == object else np.searchsorted(falling, -high[r].astype(np.float64), "left")
        at = places[:, :, None] + np.arange(k)
        valid, at = at < n[:, None, None], np.minimum(at, m - 1).reshape(len(ranked), -1)
        got = np.take_along_axis(ranked, at, 1).astype(np.int64).reshape(-1, w, k)
        if low is not None:
            valid &= ([[[100 * int(x) for x in c] for c in b] for b in got] >= low[:, :, None]) if score.dtype == object else (100 * got >= low[:, :, None])
        got_ids = ids[np.take_along_axis(order, at, 1)].reshape(-1, w, k)
        got = np.where(valid, got, LONG.min)
        here = slice(rows.start * w, rows.start * w + len(ranked) * w)
        self.scores[here], self.found[here] = merged(self.scores[here], self.found[here], got.reshape(-1, k), got_ids.reshape(-1, k), k)

    def batch(self) -> pa.RecordBatch:
        taken = self.scores > LONG.min
        row = np.repeat(np.arange(len(self.scores)), taken.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(self.index[row // self.windows].astype(np.int32)), pa.array((row % self.windows).astype(np.int32)), pa.array(self.found[taken]), pa.array(self.scores[taken])], names=["a", "p", "id", "score"])


def partners(rows: DataFrame, anchors, places: int) -> DataFrame:
    """One pass over ``rows``: (a, p, id, score, rank) of each anchor's best partners, merged over tasks.
    ``anchors`` is a broadcast list of the arguments of :class:`Block`."""

    def task(batches):
        blocks = None
        for batch in batches:
            blocks = blocks or {x[3].shape[1]: Block(*x) for x in anchors.value}
            for d, found in by_length(batch).items():
                if d in blocks:
                    blocks[d].meet(*found)
        for block in (blocks or {}).values():
            yield block.batch()

    best = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")
    return arrow_map(rows, task, "a int, p int, id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= places)


def mined(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 50) -> DataFrame:
    """For every row whose id ``every`` divides: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    out = staged_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    with scratch(spark):
        chosen = staged(rows.where(F.col("id") % every == 0).where(F.col("label").isNotNull() & usable("vector")), "anchors")
        size = chosen.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
        most = max(1, BLOCK_BYTES // (8 * max(1, size["d"] or 0)))
        n_blocks = -(-size["n"] // most)
        blocks = staged(chosen.withColumn("block", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(max(1, n_blocks)))), "anchor-blocks")
        for k in range(n_blocks):
            for part in slices(blocks.where(F.col("block") == k).drop("block").toArrow(), most):
                mine_block(rows, part).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def slices(table: pa.Table, most: int):
    """Record batches of at most ``most`` rows."""
    for at in range(0, len(table), most):
        yield table.slice(at, most).combine_chunks().to_batches()[0]


def mine_block(rows: DataFrame, anchors: pa.RecordBatch) -> DataFrame:
    """The two passes of one block of anchors."""
    context = rows.sparkSession.sparkContext
    made, n = [], 0
    for ids, labels, matrix in by_length(anchors).values():
        made.append((np.arange(n, n + len(ids)), ids, labels, matrix))
        n += len(ids)
    ids_of = np.concatenate([x[1] for x in made])
    found = partners(rows, context.broadcast(made), POSITIVES).toArrow()  # at most POSITIVES rows an anchor
    a, place, pid, score = (found.column(c).to_numpy() for c in ("a", "rank", "id", "score"))
    windowed = []
    low, high = np.full((n, POSITIVES), 1, object), np.full((n, POSITIVES), 0, object)  # an empty window where there is no positive
    for x, j, s in zip(a, place, score):
        low[x, j - 1], high[x, j - 1] = WINDOW[0] * int(s), WINDOW[1] * int(s)
    big = any(abs(int(s)) >= EXACT for s in score)
    for index, ids, labels, matrix in made:
        lo, hi = low[index], high[index]
        windowed.append((index, ids, labels, matrix, lo if big else lo.astype(np.int64), hi if big else hi.astype(np.int64)))
    negatives = partners(rows, context.broadcast(windowed), NEGATIVES)
    positives = rows.sparkSession.createDataFrame(
        pa.table({"a": pa.array(a, pa.int32()), "p": pa.array(place - 1, pa.int32()), "anchor_id": pa.array(ids_of[a] if len(a) else [], pa.int64()), "positive_id": pa.array(pid, pa.int64()), "positive_score": pa.array(score, pa.int64())})
    )
    return negatives.join(F.broadcast(positives), ["a", "p"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
