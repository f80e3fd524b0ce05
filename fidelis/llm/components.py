"""Connected components of a table of links, by alternating stars; nothing but Spark joins and sums of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import written


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    ``rows`` is about how many links there can be, if that is known: their tables are then written as few files.

    Each round joins every node to the smallest neighbour of its neighbours, first those above it (large star), then
    those below (small star), until all edges lead to the smallest node. The number of rounds grows with the logarithm
    of the longest chain. A node's neighbours are never gathered: only their minimum is, map-side first. Null ends and
    links of a node with itself are ignored; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = written(edges.filter("u > v").distinct(), "links", rows)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        small = small.filter("u > v").select("u", "v").unionAll(small.select(F.col("w"), F.col("v"))).distinct()
        edges = written(small, "links", rows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
