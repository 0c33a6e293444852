"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Each step joins every node's neighbours to the least node it knows of. The number of steps grows with the logarithm of
the largest component's diameter. Nothing is collected; a node with many neighbours is aggregated before the shuffle
and its rows are split by Spark where they are joined. Each step is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.session import cut_lineage


def _star(links: DataFrame) -> DataFrame:
    """Every (node, other) becomes (other, least of node and its others)."""
    least = links.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return links.join(least, "node")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root being the least node of its component."""
    links = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _star(both).filter(F.col("other") > F.col("node")).select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        small = _star(large)
        links = cut_lineage(small.select(F.col("other").alias("node"), F.col("least").alias("other")).unionByName(small.select("node", F.col("least").alias("other"))).filter("node <> other").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if now == state:
            roots = links.select("node", F.col("other").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        state = now
