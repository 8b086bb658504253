"""From fetched bodies to stored files: the ladder of filters, first-writer deduplication, and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.config import Filters, Limits
from pagelens.functions import binary as B
from pagelens.operators.ordered import first_by, rank, running_total


def declared_reason(declared: Column, filters: Filters, limits: Limits) -> Column:
    """What a declared length rules out before the body is read."""
    return F.when(declared > limits.max_file_bytes, "filter_size_max").when(declared < filters.min_file_bytes, "filter_size")


def skip_reason(declared: Column, size: Column, fmt: Column, filters: Filters, limits: Limits) -> Column:
    """The first rung that stops an image, or null. A body of at least 4096 bytes shows what it is before its full size is known."""
    seen = (size >= B.HEAD_BYTES) & fmt.isNull()
    return (
        F.coalesce(
            declared_reason(declared, filters, limits),
            F.when(seen, "not_image")
            .when(size > limits.max_file_bytes, "filter_size_max")
            .when(fmt.isNull(), "not_image")
            .when(~fmt.isin(list(filters.formats)), "filter_format")
            .when(size < filters.min_file_bytes, "filter_size"),
        )
    )


def climb(images: DataFrame, filters: Filters, limits: Limits) -> DataFrame:
    """Adds `bytes, format, skip_reason, sha256` to `images(declared, body, ...)`; the body itself goes. sha256 is null for skipped rows."""
    sized = images.withColumns({"bytes": F.length("body").cast("long"), "format": B.sniff(F.col("body"))})
    reason = skip_reason(F.col("declared"), F.col("bytes"), F.col("format"), filters, limits)
    return sized.withColumn("skip_reason", reason).withColumn("sha256", F.when(F.col("skip_reason").isNull(), B.content_digest(F.col("body")))).drop("body")


def store(climbed: DataFrame, order: str, known: DataFrame | None = None) -> DataFrame:
    """Adds `outcome` (saved, duplicate, skipped) and `path`. Of equal contents the first in `order` is saved, at its own
    host's folder; all others point to it. `known(sha256, path)` holds files of earlier rounds."""
    good = climbed.filter("sha256 is not null")
    first = first_by(good.select("sha256", order, "host_folder", "format"), ["sha256"], [order])
    path = F.concat(F.lit("images/"), "host_folder", F.lit("/"), "sha256", F.lit("."), B.extension(F.col("format")))
    files = first.select("sha256", F.col(order).alias("_first"), path.alias("path"))
    if known is not None:
        old = known.select("sha256", F.col("path").alias("_old"))
        files = files.join(old, "sha256", "left").select("sha256", F.when(F.col("_old").isNull(), F.col("_first")).alias("_first"), F.coalesce("_old", "path").alias("path"))
    out = climbed.join(files, "sha256", "left")
    outcome = F.when(F.col("sha256").isNull(), "skipped").when(F.col(order) == F.col("_first"), "saved").otherwise("duplicate")
    return out.withColumn("outcome", outcome).drop("_first")


def files_of(stored: DataFrame, order: str) -> DataFrame:
    """`sha256, path, bytes, format` of newly saved files."""
    return stored.filter("outcome = 'saved'").select("sha256", "path", "bytes", "format", F.col(order).alias("seq"))


def within_bytes(images: DataFrame, order: list[str], size: Column, cap: int) -> DataFrame:
    """Rows claimed while the bytes before them stay below the cap; the last one may overshoot."""
    return running_total(images, order, size, "bytes_before").filter(F.col("bytes_before") < cap)


def pattern_limited(pages: DataFrame, prior: DataFrame | None, limit: int, order: list[str]) -> DataFrame:
    """Adds `skip_reason`: `pattern_limit` for pages beyond `limit` of one pattern, counting `prior(pattern, n)` rows that are not skipped.

    Only the first `limit` rows of a pattern can pass, so a task sends on that many of each at most (a window's group limit), and
    the last one that passes is what all others are held against. A hot pattern is thus never ranked as a whole.
    """
    prior = prior if prior is not None else pages.sparkSession.createDataFrame([], "pattern string, n long")
    prior = prior.select(F.col("pattern").alias("_pattern"), F.col("n").alias("_prior"))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy(*order))
    first = pages.select("pattern", *order).withColumn("_place", place).filter(F.col("_place") <= limit)
    passing = first.join(prior, F.col("pattern").eqNullSafe(F.col("_pattern")), "left").filter(F.col("_place") + F.coalesce("_prior", F.lit(0)) <= limit)
    last = passing.groupBy(F.col("pattern").alias("_pattern")).agg(F.max(F.struct(*order)).alias("_last"))
    held = pages.join(last, F.col("pattern").eqNullSafe(F.col("_pattern")), "left")
    over = F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))
    return held.withColumn("skip_reason", F.when(over, "pattern_limit")).drop("_pattern", "_last")


def first_pages(pages: DataFrame, remaining: int, order: list[str], n: int | None = None) -> DataFrame:
    """The first `remaining` pages in the order, by their ranks: none goes through one task, however many the budget allows."""
    return rank(pages, order, "_place", n).filter(F.col("_place") <= max(0, remaining)).drop("_place")
