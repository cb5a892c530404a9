"""Connected components of a link table, by rounds of joins; no links or labels come to the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modelscout.sources.scratch import materialize

MAX_ROUNDS = 64


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest node that it is connected with.

    Alternating large-star and small-star rounds: every node hands its neighbours to the smallest of them, until the links
    are stars. The number of links never grows and the rounds are about the logarithm of the longest path. Links of a
    node with itself and repeated links are fine; nodes without links do not appear.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    now = _digest(links)
    for _ in range(MAX_ROUNDS):
        after = materialize(_small_star(_large_star(links)), "links")
        before, now = now, _digest(after)
        links = after
        if before == now:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _digest(links: DataFrame) -> tuple:
    """The number of links and two sums of 64-bit hashes over them: equal for equal sets of links."""
    sums = [F.sum(F.xxhash64("a", "b", F.lit(seed)).cast("decimal(38)")) for seed in (1, 2)]
    return tuple(links.agg(F.count(F.lit(1)), *sums).first())


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours.

    The smallest neighbours are aggregated and written before they are joined back, so a node with many neighbours can be split.
    """
    both = _both(links)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.filter("v > u").join(materialize(low, "lows"), "u")
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them."""
    low = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "lows")
    joined = links.join(low, "a")
    moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
