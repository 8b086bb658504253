"""Counts and lists about a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T


def states(page: DataFrame) -> DataFrame:
    return page.filter("kind = 'page'").groupBy("state").agg(F.count("*").alias("n"))


def asset_states(page: DataFrame) -> DataFrame:
    return page.filter("kind <> 'page'").groupBy("state").agg(F.count("*").alias("n"))


def image_states(image_url: DataFrame) -> DataFrame:
    return image_url.groupBy("state").agg(F.count("*").alias("n"))


def skip_reasons(image_url: DataFrame) -> DataFrame:
    return image_url.filter("state = 'skipped'").groupBy("skip_reason").agg(F.count("*").alias("n"))


def totals(file: DataFrame) -> DataFrame:
    return file.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def counts(page: DataFrame, image_url: DataFrame, file: DataFrame) -> DataFrame:
    """`section, key, n` of all the counts above, from one pass over each table."""
    pages = page.groupBy(F.when(F.col("kind") == "page", "pages").otherwise("assets").alias("section"), F.col("state").alias("key")).agg(F.count("*").alias("n"))
    images = image_url.groupBy("state", "skip_reason").agg(F.count("*").alias("n"))
    by_state = images.groupBy(F.lit("images").alias("section"), F.col("state").alias("key")).agg(F.sum("n").alias("n"))
    skipped = images.filter("state = 'skipped'").select(F.lit("skipped").alias("section"), F.col("skip_reason").alias("key"), "n")
    sums = totals(file).select(F.explode(F.create_map(F.lit("files"), "files", F.lit("bytes"), "bytes")).alias("key", "n")).select(F.lit("files").alias("section"), "key", "n")
    return pages.unionByName(by_state).unionByName(skipped).unionByName(sums)


def top_hosts(file: DataFrame, k: int = 10) -> DataFrame:
    """The hosts with the most files; ties by name."""
    host = F.substring_index(F.substring("path", 8, 1 << 20), "/", 1)
    return file.groupBy(host.alias("host")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).orderBy(F.desc("files"), "host").limit(k)


def errors(page: DataFrame, image_url: DataFrame) -> DataFrame:
    """Failed images and pages with their errors."""
    failed = F.col("state") == "failed"
    return image_url.filter(failed).select("url", "error").unionByName(page.filter(failed).select("url", "error"))


def recent_errors(page: DataFrame, image_url: DataFrame, k: int = 10) -> DataFrame:
    return errors(page, image_url).orderBy("url", "error").limit(k)


def pattern_counts(page: DataFrame) -> DataFrame:
    return page.filter("pattern is not null and state <> 'skipped'").groupBy("pattern").agg(F.count("*").alias("n"))


def pages_started(page: DataFrame) -> DataFrame:
    return page.agg(F.count(F.when((F.col("kind") == "page") & F.col("state").isin("in_progress", "done", "failed"), 1)).alias("started"), F.count(F.when(F.col("state") == "queued", 1)).alias("queued"))


def state_line(page: DataFrame) -> DataFrame:
    """All states of pages as one line, `done: 3, failed: 1`."""
    return states(page).agg(T.summary(F.col("state"), F.col("n")).alias("states"))


def lineage(page: DataFrame) -> DataFrame:
    """Each page with the URL of the page it was found on."""
    parent = page.select(F.col("page_id").alias("_id"), F.col("url").alias("found_on"))
    return page.join(parent, F.col("discovered_from") == F.col("_id"), "left").drop("_id")


def statistics(page: DataFrame, image_url: DataFrame, file: DataFrame) -> DataFrame:
    """One row of what a crawl has done so far: pages and how many of them failed or were rendered, assets, and images by their fate."""

    def n(condition: str, name: str):
        return F.count_if(F.expr(condition)).alias(name)

    pages = page.agg(
        n("kind = 'page' and state in ('done', 'failed')", "pages"), n("kind = 'page' and state = 'failed'", "pages_failed"), n("kind <> 'page' and state = 'done'", "assets"),
        n("rendered", "rendered"), n("kind = 'page' and state = 'queued'", "pages_queued"),
    )
    images = image_url.agg(n("state = 'done'", "_done"), n("state = 'skipped'", "images_skipped"), n("state = 'failed'", "images_failed"), n("state = 'queued'", "images_queued"))
    stored = file.agg(F.count("*").alias("images_saved"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_saved"))
    one = F.lit(1)  # three tables of one row
    joined = pages.withColumn("_k", one).join(images.withColumn("_k", one), "_k").join(stored.withColumn("_k", one), "_k")
    return joined.withColumn("images_duplicate", F.col("_done") - F.col("images_saved")).drop("_k", "_done")


def exit_code(page: DataFrame, image_url: DataFrame, status: str) -> int:
    """0; 130 if interrupted; 2 if more than a fifth of all requests failed."""
    if status == "interrupted":
        return 130
    n = page.select("state").unionByName(image_url.select("state")).agg(F.count(F.when(F.col("state") == "done", 1)).alias("done"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed")).first()
    return 2 if n.failed and n.failed / (n.done + n.failed) > 0.2 else 0
