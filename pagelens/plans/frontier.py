"""Breadth-first search as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.changes import bucketed, n_buckets, undeclare
from pagelens.storage import shared_folder


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`page_id, depth` of all pages that `links(src, dst)` reach from `seeds(page_id)`, in at most `max_depth` steps if that is given.

    Links are worked out once and lie in buckets of their source, so a round deals its newest level only; it drops what is
    known and stops when nothing is left. Levels are files in shared storage, so the plan of a round does not grow with the
    rounds before it.
    """
    spark = links.sparkSession
    root = shared_folder(spark, "bfs")
    links = bucketed(links.select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct(), f"{root}/links", "src", n_buckets(spark))
    seeds.select(F.col("page_id").cast("long")).distinct().write.parquet(f"{root}/levels/depth=0")
    depth = 0
    while max_depth is None or depth < max_depth:
        level = spark.read.parquet(f"{root}/levels/depth={depth}").select(F.col("page_id").alias("src"))
        known = spark.read.parquet(*[f"{root}/levels/depth={d}" for d in range(depth + 1)])
        new = links.join(level, "src", "left_semi").select(F.col("dst").alias("page_id")).distinct().join(known, "page_id", "left_anti")
        depth += 1
        new.write.parquet(f"{root}/levels/depth={depth}")
        if spark.read.parquet(f"{root}/levels/depth={depth}").isEmpty():
            break
    undeclare(spark, f"{root}/links")
    return spark.read.option("basePath", f"{root}/levels").parquet(f"{root}/levels").select("page_id", F.col("depth").cast("int").alias("depth"))
