"""Keep an index like its table without comparing all rows: trees of digests over ranges of keys' hashes.

A leaf is a range of hashes with LEAF_BITS bits in common; each level above joins FAN_BITS of them. A node has the
count and the digest of its rows, sums that don't depend on order. Both sides' trees are compared from the top
down; only children of nodes that differ are looked at, and only the rows of leaves that differ are compared. Trees
can be kept as tables beside their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialised
from ..sources.tables import broadcast_if_small

LEAF_BITS, FAN_BITS = 12, 4


def keyed(rows: DataFrame, keys: list[str], leaf_bits: int = LEAF_BITS) -> DataFrame:
    """``rows`` with _leaf and _digest (of all other columns)."""
    others = [c for c in sorted(rows.columns) if c not in keys]
    return rows.withColumns({"_leaf": F.shiftrightunsigned(F.xxhash64(*keys), 64 - leaf_bits), "_digest": F.xxhash64(F.to_json(F.struct(*keys, *others), {"ignoreNullFields": "false"}))})


def tree(held: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """level (0: leaves), node, n, digest of rows from ``keyed``."""
    total = F.sum(F.col("_digest").cast("decimal(38,0)")).alias("digest")
    leaves = held.groupBy(F.col("_leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), total)
    levels = [leaves.select(F.lit(0).alias("level"), "node", "n", "digest")]
    for level in range(1, -(-leaf_bits // FAN_BITS) + 1):
        up = leaves.groupBy(F.shiftright("node", FAN_BITS * level).alias("node")).agg(F.sum("n").alias("n"), F.sum("digest").alias("digest"))
        levels.append(up.select(F.lit(level).alias("level"), "node", "n", "digest"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return materialised(out)


def differing_leaves(a: DataFrame, b: DataFrame, leaf_bits: int = LEAF_BITS) -> DataFrame:
    """_leaf of the leaves in which two trees differ."""
    side = lambda t, level: t.filter(F.col("level") == level).select("node", "n", "digest")
    open_ = None
    for level in range(-(-leaf_bits // FAN_BITS), -1, -1):
        left, right = side(a, level), side(b, level)
        if open_ is not None:
            above = F.shiftright("node", FAN_BITS)
            left, right = (x.withColumn("above", above).join(broadcast_if_small(open_.select(F.col("node").alias("above"))), "above", "left_semi").drop("above") for x in (left, right))
        both = left.join(right.select("node", F.col("n").alias("n2"), F.col("digest").alias("digest2")), "node", "full_outer")
        open_ = materialised(both.filter(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("digest").eqNullSafe(F.col("digest2")))).select("node"))
    return open_.select(F.col("node").alias("_leaf"))


def differences(table: DataFrame, index: DataFrame, keys: list[str], leaf_bits: int = LEAF_BITS) -> tuple[DataFrame, DataFrame]:
    """(the keys, what: missing, stale or changed; n_compared: how many rows of both sides were compared). Keys are distinct on each side."""
    a, b = keyed(table, keys, leaf_bits), keyed(index, keys, leaf_bits)
    leaves = broadcast_if_small(differing_leaves(tree(a, leaf_bits), tree(b, leaf_bits), leaf_bits))
    a, b = (x.join(leaves, "_leaf", "left_semi").select(*keys, "_digest") for x in (a, b))
    both = materialised(a.withColumnRenamed("_digest", "_a").join(b.withColumnRenamed("_digest", "_b"), keys, "full_outer"))
    what = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "stale").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(*keys, what.alias("what")).filter("what IS NOT NULL"), both.agg(F.count("_a").alias("of_table"), F.count("_b").alias("of_index"))


def mended(table: DataFrame, index: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``index`` without what is stale, and with the table's rows for what is missing or changed."""
    gone = index.join(broadcast_if_small(found.filter("what <> 'missing'").select(*keys)), keys, "left_anti")
    new = table.join(broadcast_if_small(found.filter("what <> 'stale'").select(*keys)), keys, "left_semi")
    return gone.unionByName(new.select(*index.columns))
