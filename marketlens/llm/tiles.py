"""Bounded all-against-all work within groups: large groups are cut into blocks, blocks meet in tiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048  # members of a block

def dealt(members: DataFrame, key: str, member: str, limit: int = LIMIT, weight: str | None = None, weight_limit: int = 1) -> DataFrame:
    """One row for each tile that a member takes part in: key, lo, hi, block, blocks (of its group), and the member's columns.

    A group of m members has ceil(m / limit) blocks (or more, so that a block's weights sum to about ``weight_limit``), to which members are dealt by hash, and a tile for each pair of
    blocks (lo <= hi); a tile holds two blocks at most, so no task has to hold a group. Groups of one are left out.
    Group sizes are counted with partial sums; the join with the counts can be split where it is skewed.
    """
    load = F.lit(0) if weight is None else F.sum(weight)
    sizes = members.groupBy(key).agg(F.count("*").alias("_n"), load.alias("_w")).filter("_n > 1")
    sizes = sizes.select(key, F.greatest(F.ceil(F.col("_n") / limit), F.ceil(F.col("_w") / weight_limit)).cast("int").alias("_k"))
    out = members.join(sizes, key)
    out = out.withColumn("block", F.pmod(F.xxhash64(F.col(member), F.lit(17)), F.col("_k")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    lo, hi = F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi")
    rest = [c for c in members.columns if c != key]
    return out.select(F.col(key).alias("key"), lo, hi, "block", F.col("_k").alias("blocks"), *rest)


def sorted_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def sides(block: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a tile's two sides; the same within one block."""
    if lo == hi:
        both = np.arange(len(block))
        return both, both
    return np.flatnonzero(block == lo), np.flatnonzero(block == hi)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach, by repeated minima (a few rounds)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label
