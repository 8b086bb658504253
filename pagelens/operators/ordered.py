"""Running totals and ranks in one order over all rows, without bringing all rows to one task.

Rows are dealt by ranges of the order; each range is summed by itself, and the few range totals give what comes before it.
The dealt rows are kept as files first: ranges are drawn by sampling, and a second draw could cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.storage import kept


def in_ranges(df: DataFrame, order: Sequence[str]) -> tuple[DataFrame, Window]:
    """The rows dealt by ranges of the order, whose numbers (`_range`) ascend with it; and the window over a range and the first column of the order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    return dealt, Window.partitionBy("_range", order[0]).orderBy(*order[1:])


def running_total(df: DataFrame, order: Sequence[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one. `order` must tell all rows apart."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(df.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum"), F.min(F.struct(*order)).alias("_first"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(w), F.lit(0)))
    joined = inside.join(F.broadcast(before.select("_range", "_before")), "_range")
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).select(*df.columns, out)


#: Rows that are ranked in one task where their number is known.
FEW = 100_000


def rank(df: DataFrame, order: Sequence[str], out: str, n: int | None = None) -> DataFrame:
    """Adds `out`: the place of each row in the order, from 1. Where the caller has counted the rows, few of them take the short way.

    Rows are sorted in ranges before they are kept, so the place of a row in its file and the rows of the files before that make
    its rank: rows are dealt once, whatever else they carry.
    """
    if n is not None and n <= FEW:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("long"))
    dealt = kept(df.repartitionByRange(*order).sortWithinPartitions(*order), "ranges").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    files = dealt.groupBy("_file").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    return dealt.join(F.broadcast(files.select("_file", before.alias("_before"))), "_file").withColumn(out, F.col("_before") + F.col("_index") + 1).select(*df.columns, out)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: the first writer wins. Partly found before rows are dealt, so a hot key is no burden."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*[F.col(k) for k in keys], *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
