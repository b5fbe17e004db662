"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemill.session import stage


def _stars(edges: DataFrame) -> DataFrame:
    """Link every node to the least of its neighbourhood, larger neighbours first."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    large = both.join(least, "a").where("b > a AND b > root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    # now every edge points to a smaller node: the small star
    down = large.distinct()
    lowest = down.groupBy("a").agg(F.min("b").alias("root"))
    kept = down.join(lowest, "a")
    return kept.select("a", F.col("root").alias("b")).union(kept.where("b != root").select(F.col("b").alias("a"), F.col("root").alias("b"))).distinct()


def _sum(edges: DataFrame) -> tuple:
    """Row count and order-free checksums of an edge list."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.hash("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the least node reachable from each node of ``edges`` that is not a root itself.

    ``edges`` has columns a and b of one orderable type; loops and repeats do no harm, an
    empty list gives an empty result. Rounds go on until every node hangs on its root, which
    takes a logarithmic number of them; each one is written to the shared folder. Minima are
    taken before rows are joined back, so no neighbourhood is ever collected.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        after = stage(_stars(now), "links")
        if _sum(now) == _sum(after):
            return after.select("a", F.col("b").alias("root"))
        now = after
