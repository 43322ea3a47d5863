"""Connected components of a link table, by alternating large and small stars.

Nodes are long integers. Each round links nodes to the smallest neighbour they know; the
number of rounds grows with the logarithm of a component's size. Links stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stash, unstash


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    kept = down.join(least, "a")
    return kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, tag: str) -> DataFrame:
    """(node, root) of each node that has a link; root is the smallest node it reaches.

    ``links`` has the columns a and b. Links from a node to itself are dropped.
    """
    def sums(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())

    links = stash(links.select("a", "b").where("a <> b").distinct(), tag)
    before = None
    now = sums(links)
    while now != before and now[0]:
        after = stash(_small_star(_large_star(links).distinct()).distinct(), tag)
        unstash(links)
        links = after
        before, now = now, sums(links)
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
