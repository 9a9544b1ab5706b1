"""Packing token sequences by harmonic classes.

A piece of length n belongs to the reciprocal class k = capacity // n, and a sequence of class k holds
exactly k pieces. Documents may be cut, so a length is first written as a short sum of reciprocals:
whole sequences, then capacity // (k + 1) for as long as k pieces of the rest would leave more than
a fiftieth of a sequence empty. Three pieces a document are usual.

Workers number the pieces of each class as they cut them, independently of each other. The counts by
class and worker, a small table, give each worker's offset in its class, so sequences may span workers and
each class has one unfinished sequence in all, not one for each worker. Those unfinished ones hold
at most :func:`leftover_bound` pieces whatever the input's size; they are placed first-fit, longest first.

Defined cases: null text counts as empty; a document always has its end id, so it has a piece. Repeated
rows are packed each on their own. An empty table gives no rows. Columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palisade.llm.common import arrow_map, staged
from palisade.llm.word_tokens import encoder

CAPACITY = 4096
END_ID = 2
SLICE = 2000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths, in order, whose sum is n."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        part = rest if capacity - k * rest <= capacity // 50 else capacity // (k + 1)
        out.append(part)
        rest -= part
    return out


def leftover_bound(capacity: int = CAPACITY) -> int:
    """Most pieces that unfinished sequences of all classes can hold together."""
    return sum(k - 1 for k in {capacity // n for n in range(1, capacity + 1)})


def pieces(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, its class k, the worker and its
    number there; with ``keep_ids`` also the ids as little-endian uint32 bytes."""
    path = path or default_path()
    df = df.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    longs = ["start", "length", "ids_crc32", "doc_tokens", "k", "worker", "n_there"]
    schema = T.StructType([df.schema[0], *(T.StructField(c, T.LongType()) for c in longs)] + [T.StructField("ids", T.BinaryType())] * keep_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker, seen = encoder(path).ids, TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows, own = [], []
                for i, t in enumerate(batch.column(1)):
                    ids = encode(t.as_py()) + end
                    start, total = 0, len(ids) // 4
                    for n in cut_lengths(total, capacity):
                        k, part = capacity // n, ids[4 * start : 4 * (start + n)]
                        rows.append((start, n, zlib.crc32(part), total, k, worker, seen[k], *([part] * keep_ids)))
                        own.append(i)
                        seen[k] += 1
                        start += n
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:7]), *(pa.array(c, pa.binary()) for c in cols[7:])],
                    [id_col, *longs, *["ids"] * keep_ids],
                )

    return arrow_map(df, run, schema)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` of :func:`pieces` with sequence_id and offset."""
    parts = staged(parts, "pieces")
    counts = staged(parts.groupBy("k", "worker").agg(F.count("*").alias("n")), "piece-counts")
    # a row a class: at most 2 * sqrt(capacity) rows
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    first, base = {}, 0
    for k in sorted(totals):
        first[k] = base
        base += totals[k] // k
    before = F.sum("n").over(Window.partitionBy("k").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("k", "worker", F.coalesce(before, F.lit(0)).alias("before"))
    classes = parts.sparkSession.createDataFrame([(k, first[k], totals[k] // k * k) for k in totals], "k long, first long, filled long")
    own = [c for c in parts.columns if c not in ("k", "worker", "n_there")]
    ranked = parts.join(offsets, ["k", "worker"]).withColumn("rank", F.col("before") + F.col("n_there")).join(F.broadcast(classes), "k")
    slot = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranked.where(F.col("rank") < F.col("filled")).withColumn("sequence_id", F.col("first") + F.floor(F.col("rank") / F.col("k")).cast("long"))
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(slot), F.lit(0).cast("long"))).select(*own, "sequence_id", "offset")
    rest = ranked.where(F.col("rank") >= F.col("filled")).select(*own, F.col("k").alias("__k"), F.col("rank").alias("__rank"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        frame = pd.concat(got).sort_values(["length", "__k", "__rank"], ascending=[False, True, True])
        room: list[int] = []
        ids, offsets = [], []
        for n in frame["length"]:
            at = next((i for i, r in enumerate(room) if r >= n), len(room))
            if at == len(room):
                room.append(capacity)
            ids.append(base + at)
            offsets.append(capacity - room[at])
            room[at] -= n
        yield frame.drop(columns=["__k", "__rank"]).assign(sequence_id=ids, offset=offsets)

    # at most leftover_bound() rows, whatever the input: one task
    return whole.unionByName(rest.repartition(1).mapInPandas(fit, whole.schema))


def padding(packs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padded ids. A sequence of a power of two ids stays as it is."""
    used = packs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count(F.col("n")) == 1
    return used.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_tokens"), F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))).alias("n_padding"))


def sequences(packs: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids binary): whole padded sequences, from pieces that kept their ids. A sequence
    has at most ``capacity`` ids, so a group is bounded."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x")))), lambda p: p["x"]), "")
    n = F.sum("length").cast("int")
    pad = F.when(F.bit_count(n) == 1, 0).otherwise(capacity - n)
    one = "".join(f"{b:02X}" for b in int(pad_id).to_bytes(4, "little"))
    return packs.groupBy("sequence_id").agg(F.unhex(F.concat(joined, F.repeat(F.lit(one), pad))).alias("ids"))
