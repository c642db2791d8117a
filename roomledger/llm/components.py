"""Connected components by iterative joins: every node gets its component's smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from roomledger.llm.common import remove, save


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b).

    Rounds of two star steps: each node hands its smallest neighbour first to
    its larger, then to its smaller neighbours, until nothing changes.  Counts
    and minima combine on the map side, so a hub is no hot group; each round is
    written to the shared folder, in files whose number follows the edges.
    """
    now = save(edges.where(F.col("a") != F.col("b"))
               .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = _sums(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.where(F.col("b") > F.col("a")).join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = save(least.select("a", F.col("m").alias("b")).union(small.where(F.col("a") > F.col("b"))).distinct(), "edges", rows=was[0])
        before, was = was, _sums(new)
        remove(now)
        now = new
        if was == before:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                roots.select("node", F.col("node").alias("component")))


def _sums(edges: DataFrame) -> Row:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
