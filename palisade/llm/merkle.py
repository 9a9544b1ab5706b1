"""Merkle dataset manifest: bottom-up build, top-down proof push.

Every row is a leaf of its tree (say, its language); trees of :data:`FAN` children a node give subroots, and the
subroots, in the order of their trees' values (null first), give the root by the same steps. Each level is a table
in the shared folder. Proofs come from the top down: a child meets its parent's row by (tree, position div 8) and
puts the digests of its siblings before the proof that the parent inherited, so a level moves one row a child and
one a parent, and no run has more than 8 members whatever the size of a tree.

Positions come from one range shuffle of thin rows over (tree, order, digest, row): a tree that holds a third of all
rows is spread over as many tasks as its share, and so are repeated rows. Only counts by task meet in a window.

Defined results. A null field counts as ``-``. Rows of equal order are placed by digest; repeated rows are leaves of
their own, each with its own proof. Null order values come first. A tree of one leaf has that leaf as its
subroot, and a single subroot is the root; their proofs may be empty. An empty table gives no rows and
no root. Columns of the input that are not named are not part of a leaf and cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palisade.llm.common import scratch, staged, with_small

#: Children of a node.
FAN = 8


def digest(c: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value: no two rows of values give one text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def placed(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows(tree, digest, ...)`` with ``pos`` from 0 in its tree, by ``order`` and digest, and ``n``, the tree's rows."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "digest")]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(*keys, F.col("row").asc()).sortWithinPartitions(*keys, F.col("row").asc()).drop("row")
    dealt = staged(dealt.withColumn("at", F.monotonically_increasing_id()), name)  # the task's number above bit 33, the place in it below
    share = F.shiftright("at", 33).alias("share")
    shares = dealt.groupBy("tree", share).agg(F.min("at").alias("start"), F.count("*").alias("m"))  # a row for each task and tree in it
    tree = Window.partitionBy("tree")
    shares = shares.select(
        "tree", "share", (F.sum("m").over(tree.orderBy("share")) - F.col("m") - F.col("start")).alias("shift"), F.sum("m").over(tree).alias("n")
    )
    return with_small(dealt.withColumn("share", F.shiftright("at", 33)), staged(shares, f"{name}-shares"), ["tree", "share"], "inner").withColumn("pos", F.col("at") + F.col("shift")).drop("at", "share", "shift")


def parent() -> Column:
    return F.floor(F.col("pos") / FAN).cast("long")


def levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The tables of all levels from ``leaves(tree, pos, n, digest, ...)`` up; those above hold ``kids`` as well, their children's digests.
    A tree ends at the level where it has one node."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = out[-1].where("n > 1").groupBy("tree", parent().alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"))
        kids = runs.agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("kids"))  # at most 8
        up = kids.select("tree", "pos", "n", F.col("kids.digest").alias("kids"))
        out.append(staged(up.withColumn("digest", digest(F.array_join("kids", ""))), f"{name}-{len(out)}"))
        most = -(-most // FAN)
    return out


def tops(tables: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's last node."""
    out = None
    for level in tables:
        own = level.where("n = 1").select("tree", "digest")
        out = own if out is None else out.unionByName(own)
    return out


STEP = "struct<left: string, right: string>"


def pushed(tables: list[DataFrame], inherited: DataFrame, name: str) -> DataFrame:
    """Level 0 with ``steps``, a (left, right) pair of joined sibling digests for each level up, and what else
    ``inherited(tree, steps, ...)`` gives to the tops of its trees."""
    extra = [c for c in inherited.columns if c not in ("tree", "steps")]
    above = None
    for k in range(len(tables) - 1, -1, -1):
        level = tables[k]
        here = with_small(level.where("n = 1"), inherited, ["tree"], "inner")
        if above is not None:
            i = (F.col("pos") % FAN).cast("int")
            own = F.struct(F.array_join(F.slice("up_kids", 1, i), "").alias("left"), F.array_join(F.slice("up_kids", i + 2, FAN), "").alias("right"))
            rest = level.where("n > 1").withColumn("up", parent()).join(above, ["tree", "up"])
            rest = rest.withColumn("steps", F.concat(F.array(own.cast(STEP)), F.col("up_steps"))).drop("up", "up_kids", "up_steps")
            here = here.unionByName(rest)
        if k:
            here = staged(here.drop("digest", "n"), f"{name}-{k}")
            above = here.select("tree", F.col("pos").alias("up"), F.col("kids").alias("up_kids"), F.col("steps").alias("up_steps"), *extra)
    return here


@dataclass
class Manifest:
    """``leaves``: own (a struct of the carried columns), tree, pos, n, digest, steps, subroot. ``root`` is null for an empty table."""

    leaves: DataFrame
    root: str | None


def manifest(docs: DataFrame, fields: Sequence[str], tree: str, order: Sequence[str], carry: dict[str, Column]) -> Manifest:
    """Build the trees of ``docs`` and every leaf's proof. ``carry`` are columns that go along with a leaf."""
    own = F.struct(*[v.alias(k) for k, v in carry.items()]).alias("own")
    by = {f"by{i}": F.col(c) for i, c in enumerate(order)}
    rows = docs.select(field(F.col(tree)).alias("tree"), F.col(tree).alias("value"), *[v.alias(k) for k, v in by.items()], leaf_digest(*map(F.col, fields)).alias("digest"), own)
    with scratch(docs.sparkSession) as keep:
        leaves = keep(staged(placed(rows, list(by), "merkle-placed").drop(*by), "merkle-leaves"))
        tables = levels(leaves, "merkle-level")
        values = leaves.where("pos = 0").select("tree", "value")
        subroots = values.join(tops(tables), "tree").select(F.lit("").alias("tree"), F.col("tree").alias("of"), "value", "digest")
        upper = staged(placed(subroots, ["value"], "merkle-subroots"), "merkle-upper")
        above = levels(upper, "merkle-root")
        root = tops(above).first()
        none = staged(docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(f"array<{STEP}>").alias("steps")), "merkle-top")
        inherited = staged(pushed(above, none, "merkle-down").select(F.col("of").alias("tree"), F.col("digest").alias("subroot"), "steps"), "merkle-inherited")
        proven = pushed([leaves.drop("value"), *tables[1:]], inherited, "merkle-proof")
        proven = keep(staged(proven, "merkle-proven"))
        return Manifest(proven, root and root["digest"])


def proof_digest(steps: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda up, s: digest(F.concat(s["left"], up, s["right"])))
