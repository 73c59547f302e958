"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import scratch_dir, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of every node with a link, the smallest node it can reach.

    ``edges`` has columns a and b (long); direction, repeats and self-links don't matter. Each round sends a node's
    neighbours to the smallest of them, so that chains shorten geometrically; a round is cut with checkpoint().
    Minima are combined before the shuffle. They are written before stars are joined on their centre, so that both sides
    of the join come plainly from a shuffle and Spark's skew join can split a large star.
    """
    scratch_dir(edges.sparkSession)
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct().checkpoint()
    seen = _state(down)
    while seen[0]:
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-minima")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().checkpoint()
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "star-minima")
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = _state(down)
        if now == seen:
            break
        seen = now
    roots = down.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return down.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct()
