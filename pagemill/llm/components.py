"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) and a join with it, so a
node with very many neighbours is not gathered anywhere; Spark splits skewed joins.
Every round is written to the shared checkpoint folder.

Rounds go on until the links no longer change. They end on every input: a step never gives a node
a link to a larger neighbour than it had, so the sum of all links' ends falls until each component is
a star; alternating both steps needs O(log(n)**2) rounds (Kiveris and others, 2014).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Links of each node's neighbours (a, b) to the least of the node and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = pairs.join(least, "a")
    if larger_only:
        return met.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    own = least.select(F.col("a").alias("x"), F.col("m").alias("y"))
    return met.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a long, b long)``; component is the least node reachable."""
    links = edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct()
    links = cut(links)
    mark = F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("s")
    seen = None
    while True:
        now = tuple(links.agg(F.count("*").alias("n"), mark).first())
        if now == seen or now[0] == 0:
            break
        seen = now
        both = links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(links.select(F.col("y").alias("a"), F.col("x").alias("b")))
        large = _star(both, larger_only=True).where("x <> y").distinct()
        down = large.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        links = cut(_star(down, larger_only=False).where("x <> y").distinct())
    return links.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(links.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct())
