"""Connected components of a graph given by its edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """`node, root` for each node of `edges(a long, b long)`; root is the smallest node that can be reached.

    Large star: every larger neighbour of a node moves to the node's smallest neighbour. Small star: every smaller
    neighbour does. Both keep components whole; when neither changes anything, all nodes hang on their root. Minima are
    found before rows meet, so a node with very many neighbours is no burden. Edges that repeat or join a node to itself
    change nothing; edges with a null end are none; without edges there are no rows.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")  # as files, so that the join may split a hot node
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "edges")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = written(small, "edges")
        forget(e)
        e = new
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
