"""Connected components as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the edges (a, b); the component is its smallest node.

    Stars are made larger and smaller in turn: every node hands its larger neighbours to the
    smallest one it knows, then keeps only the link to it. Each round writes its edges to the shared
    folder; the rounds grow with the logarithm of the nodes, and none gathers a node's neighbours.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = cut_lineage(links.filter(F.col("a") < F.col("b")).distinct())
    before = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Each node's larger neighbours to the least node around it ...
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()
        large = large.filter(F.col("a") < F.col("b"))
        # ... and then each node's smaller neighbours, and itself, to the least of them.
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = (
            large.join(lower, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
            .filter(F.col("a") < F.col("b")).select("a", "b").distinct()
        )
        links = cut_lineage(small)
    nodes = links.select(F.col("b").alias("id"), F.col("a").alias("component"))
    roots = links.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return nodes.unionByName(roots)
