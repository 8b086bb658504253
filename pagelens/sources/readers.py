"""Tables that a crawl starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.config import Config
from pagelens.functions import url as U
from pagelens.operators import policy
from pagelens.schema import RESPONSE


def responses(spark: SparkSession, path: str) -> DataFrame:
    """A captured snapshot, one row a URL."""
    return spark.read.schema(RESPONSE).parquet(path)


def responses_from_files(spark: SparkSession, path: str, base_url: str, most_bytes: int = 50 << 20) -> DataFrame:
    """A folder of files as a snapshot: the path below the folder becomes the path of the URL. Files above `most_bytes` are left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= most_bytes)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    below = F.substring("path", len(root.rstrip("/")) + 1, 1 << 20)
    name = F.lower(F.element_at(F.split("path", r"\."), -1))
    kinds = {"html": "text/html", "htm": "text/html", "css": "text/css", "xml": "application/xml", "txt": "text/plain", "json": "application/json", "webmanifest": "application/manifest+json"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[name]
    row = {f: F.lit(None) for f in ("location", "headers", "rendered_html", "network_images", "json_images")}
    row |= {"url": U.normalize(F.concat(F.lit(base_url.rstrip("/")), below)), "status": F.lit(200), "content_type": kind, "content_length": F.col("length"), "body": F.col("content"), "fetched_at": F.col("modificationTime")}
    schema = spark.createDataFrame([], RESPONSE).schema
    return files.select(*[row[f.name].cast(f.dataType).alias(f.name) for f in schema])


def capped_body(body: Column, declared: Column, most: int) -> Column:
    """`struct(body, error)`: the error is set where the declared or the real length is above the cap."""
    big = (F.coalesce(declared, F.lit(0)) > most) | (F.length(body) > most)
    return F.struct(F.when(~big, body).alias("body"), F.when(big, "BodyTooLarge").alias("error"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """`url` of a text file: a URL on each line, blank lines and lines with `#` in front left out."""
    return listed(spark.read.text(path).withColumnRenamed("value", "line"))


def listed(lines: DataFrame) -> DataFrame:
    line = F.trim("line")
    return lines.filter((line != "") & ~line.startswith("#")).select(line.alias("url"))


def seeds(spark: SparkSession, cfg: Config) -> DataFrame:
    """Pages at depth 0 with their patterns."""
    rows = spark.createDataFrame([(s,) for s in cfg.seeds], "raw string").select(U.normalize(F.col("raw"), cfg.http.strip_page_params).alias("url"))
    return rows.filter("url is not null").select("url", F.lit(0).alias("depth"), U.url_pattern(F.col("url")).alias("pattern"))


def cdx(spark: SparkSession, path: str) -> DataFrame:
    """`original, timestamp, mimetype` of an archive index: a JSON array of arrays, of which the first names the columns."""
    return cdx_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "json"))


def cdx_rows(documents: DataFrame) -> DataFrame:
    table = documents.select(F.from_json("json", "array<array<string>>").alias("t")).filter("size(t) > 1").select(F.element_at("t", 1).alias("head"), F.posexplode(F.slice("t", 2, 1 << 30)).alias("pos", "r"))

    def named(name: str) -> Column:
        return F.try_element_at("r", F.array_position("head", F.lit(name)).cast("int")).alias(name)

    return table.select("pos", named("original"), named("timestamp"), named("mimetype"))


def queue_archive(rows: DataFrame, cfg: Config, domain: str) -> DataFrame:
    """What an archive index queues: `url, source, skip_reason, kind, context, outcome` for each of its rows.

    In `archive` mode the archived copy is queued; in `live` mode the original, with its scope reason kept. `outcome` is
    `added` for the first row of a URL that may be fetched, else `skipped`.
    """
    original = F.col("original")
    url = U.normalize(F.when(original.contains("://"), original).otherwise(F.concat(F.lit("http://"), original)))
    live = cfg.wayback.mode == "live"
    at = rows.withColumn("plain", url)
    target = F.col("plain") if live else F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("id_/"), "plain")
    at = at.withColumn("url", target).withColumn("skip_reason", policy.image_reason(F.col("plain"), cfg.scope) if live else F.lit(None).cast("string"))
    first = at.filter("url is not null").groupBy("url").agg(F.min("pos").alias("_first"))
    out = at.join(first, "url", "left")
    new = F.col("url").isNotNull() & (F.col("pos") == F.col("_first")) & F.col("skip_reason").isNull()
    folder = U.host_dir(F.lit(domain))
    return out.select("pos", "url", F.lit("wayback" if live else "wayback-archive").alias("source"), "skip_reason", F.lit("wayback:cdx").alias("kind"), F.concat("timestamp", F.lit(" "), folder).alias("context"), F.when(F.coalesce(new, F.lit(False)), "added").otherwise("skipped").alias("outcome"))


def json_images(body: Column, most: int = 5_000_000) -> Column:
    """Quoted strings of a JSON body that look like image addresses, `\\/` read as `/`."""
    quoted = F.regexp_extract_all(F.substring(body, 1, most), F.lit(r"""(?i)"([^"\s]+?\.(?:jpe?g|png|gif|webp|avif|svg)(?:\?[^"\s]*+)?)\""""), F.lit(1))
    return F.array_distinct(F.transform(quoted, lambda s: F.replace(s, F.lit("\\/"), F.lit("/"))))
