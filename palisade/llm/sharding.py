"""Byte-bounded shards by extendible hashing, in DataFrame expressions only.

The directory is indexed by the leading bits of a 60-bit hash of the key. Only a bucket over
``max_bytes`` splits on its next bit, so buckets have local depths of their own. The split runs on
sums by prefix, never on rows: a round adds some bits, sums bytes by prefix with map-side
combination, rolls the sums up to every depth in between, and takes as a bucket's leaf the least
depth at which it fits. Only rows of prefixes that are still too large enter the next round.

Defined cases: a row above the limit is a shard of its own with ``shard_bytes`` over the limit, since
rows are not cut. Null text has 0 bytes. Null keys hash as the empty string. Rows with equal keys have
equal hashes; where such rows together pass the limit, no bit parts them, and they are written once
with a row number, by whose hash they split on. An empty table gives no rows. Columns named like
an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import scratch, staged

HASH_BITS = 60
#: Bits of a round beyond those that an even spread would need.
SPARE_BITS = 3
ROUND_BITS = 12


def hash60(*keys: str) -> Column:
    joined = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, HASH_BITS - depth)


def leaves(rows: DataFrame, above: int, depth: int, max_bytes: int) -> DataFrame:
    """(p, leaf, shard_bytes, shard_docs) for each prefix of ``depth`` bits in ``rows(__h, __b)``:
    ``leaf`` is the least depth over ``above`` whose bucket fits, or null if none does."""
    fine = rows.groupBy(prefix(F.col("__h"), depth).alias("p")).agg(F.sum("__b").alias("b"), F.count("*").alias("n"))
    path = fine.withColumn("d", F.explode(F.sequence(F.lit(above), F.lit(depth)))).withColumn("q", F.expr(f"shiftright(p, {depth} - d)"))
    nodes = staged(path.groupBy("d", "q").agg(F.sum("b").alias("nb"), F.sum("n").alias("nn")), "shard-nodes")
    fits = (F.col("nb") <= max_bytes) | (F.col("nn") == 1)
    parents = nodes.where(fits).select((F.col("d") + 1).alias("d"), F.col("q").alias("parent"))
    leaf = nodes.where(fits).withColumn("parent", F.shiftright("q", 1)).join(parents, ["d", "parent"], "left_anti")
    below = F.expr(f"sequence(shiftleft(q, {depth} - d), shiftleft(q + 1, {depth} - d) - 1)")
    done = leaf.select(F.explode(below).alias("p"), F.col("d").alias("leaf"), F.col("nb").alias("shard_bytes"), F.col("nn").alias("shard_docs"))
    rest = nodes.where((F.col("d") == depth) & ~fits).select(F.col("q").alias("p"), *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("leaf", "shard_bytes", "shard_docs")])
    return done.unionByName(rest)


def assign_shards(df: DataFrame, keys: list[str], n_bytes: Column, max_bytes: int) -> DataFrame:
    """``df`` with shard (the bucket's bits, as text), shard_depth, shard_bytes, shard_docs."""
    own = F.struct("*").alias("__own")
    rows = df.select(own, hash60(*keys).alias("__h"), F.coalesce(n_bytes.cast("long"), F.lit(0).cast("long")).alias("__b"))
    with scratch(df.sparkSession) as keep:
        assigned = _assign(rows, max_bytes, "", keep)
    return assigned.select(
        *[F.col("__own")[c].alias(c) for c in df.columns if c not in ("shard", "shard_depth", "shard_bytes", "shard_docs")], "shard", "shard_depth", "shard_bytes", "shard_docs"
    )


def _assign(rows: DataFrame, max_bytes: int, stem: str, keep) -> DataFrame:
    slim = staged(rows.select("__h", "__b"), "shard-sizes")
    total = slim.agg(F.coalesce(F.sum("__b"), F.lit(0))).first()[0]
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / max_bytes))) + SPARE_BITS))
    above, out = 0, rows.withColumn("__leaf", F.lit(None).cast("struct<leaf:int,shard_bytes:long,shard_docs:long>"))
    while True:
        found = keep(staged(leaves(slim, above, depth, max_bytes), "shard-leaves"))
        got = found.select(F.col("p").alias("__p"), F.when(F.col("leaf").isNotNull(), F.struct("leaf", "shard_bytes", "shard_docs")).alias("__new"))
        out = out.withColumn("__p", prefix(F.col("__h"), depth)).join(got, "__p", "left").withColumn("__leaf", F.coalesce("__leaf", "__new")).drop("__p", "__new")
        left = found.where(F.col("leaf").isNull()).select(F.col("p").alias("__p"))
        if left.isEmpty() or depth == HASH_BITS:
            break
        slim = staged(slim.withColumn("__p", prefix(F.col("__h"), depth)).join(left, "__p", "left_semi").select("__h", "__b"), "shard-rest")
        above, depth = depth + 1, min(HASH_BITS, depth + ROUND_BITS)
    done = out.where(F.col("__leaf").isNotNull()) if depth == HASH_BITS else out
    bits = F.expr(f"lpad(bin(shiftright(__h, {HASH_BITS} - __leaf.leaf)), __leaf.leaf, '0')")
    done = done.select("__own", F.concat(F.lit(stem), bits).alias("shard"), F.col("__leaf.leaf").alias("shard_depth"), F.col("__leaf.shard_bytes").alias("shard_bytes"), F.col("__leaf.shard_docs").alias("shard_docs"))
    if depth < HASH_BITS or left.isEmpty():
        return done
    same = keep(staged(out.where(F.col("__leaf").isNull()).select("__own", "__h", "__b", F.monotonically_increasing_id().alias("__i")), "shard-equal-keys"))
    again = same.select("__own", hash60("__h", "__i").alias("__h"), "__b")
    return done.unionByName(_assign(again, max_bytes, f"{stem}{'=' * (HASH_BITS // 4)}.", keep))
