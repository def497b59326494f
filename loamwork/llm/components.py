"""Connected components by alternating stars, for link tables of any size.

Each round points every node at the smallest node it knows of, first from the
larger side and then from the smaller. Links never multiply, the smallest
neighbour is a partial aggregate, and the join that spreads it is one that
Spark's skew join can split, so a hub with very many links is no hot task.

Defined cases: a link with a null end, and one from a node to itself, is none;
repeated links, and links told from either side, count once; nodes are of any type
that has an order; without links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a, b) with a > b."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    # large star: every greater neighbour of u goes to the least around u
    large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    # small star: u and its lesser neighbours go to the least of them
    lowest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    small = large.join(lowest, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return small.union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _unfinished(links: DataFrame) -> bool:
    """Whether some node points at two others, or at one that itself points on."""
    forked = links.groupBy("a").count().where("count > 1").select("a")
    deep = links.join(links.select(F.col("a").alias("next")), F.col("b") == F.col("next"), "left_semi").select("a")
    return not forked.union(deep).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link."""
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = cut(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "links")
    while _unfinished(now.df):
        after = cut(_stars(now.df), "links")
        now.drop()
        now = after
    leaves = now.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.df.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
