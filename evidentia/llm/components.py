"""Connected components of a graph held in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame) -> DataFrame:
    """Both steps at once: link every neighbour of a node, and the node, to the smallest of them. (a, b) with b < a."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    # written, so that the join below has plain sides: a node with very many links is then split, or its row sent to all
    least = stage(both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least")), "least")
    linked = both.join(least, "n")
    out = linked.select(F.col("m").alias("a"), F.col("least").alias("b")).union(least.select(F.col("n").alias("a"), F.col("least").alias("b")))
    return out.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node can reach, for every node of edges (a, b).

    Links stay in written tables; each round replaces a node's links by links to the smallest node it sees, so the
    longest path shrinks geometrically, and the rounds end when a round changes nothing. Null ends are no links.
    """
    now = stage(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:  # the same set of links as before, by number and by sum of hashes
            break
        seen, now = state, stage(_star(now), "links")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    ).groupBy("node").agg(F.min("root").alias("root"))
