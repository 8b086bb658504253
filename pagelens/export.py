"""Manifests of a crawl: one row a reference, one document a file, one row a URL, and the mirror tree's paths."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import url as U
from pagelens.operators.ordered import in_ranges
from pagelens.sources.sinks import write_document
from pagelens.state import Store
from pagelens.storage import file_system

#: The columns of the exported tables, in their order.
MANIFEST_COLUMNS = "file sha256 bytes format image_url final_url url_filename page_url kind context status content_type fetched_at".split()
URL_COLUMNS = "image_url state skip_reason error sha256 file status source".split()


def stamp(col) -> F.col:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _images(image_url: DataFrame, file: DataFrame) -> DataFrame:
    """A row for each stored image, with its file."""
    u, f = image_url.filter("state = 'done'").alias("u"), file.alias("f")
    return u.join(f, F.col("u.sha256") == F.col("f.sha256")).select(
        F.col("u.image_id").alias("image_id"), F.col("f.path").alias("file"), F.col("f.sha256").alias("sha256"), F.col("f.bytes").alias("bytes"), F.col("f.format").alias("format"), F.col("u.url").alias("image_url"),
        F.col("u.final_url").alias("final_url"), F.col("u.url_filename").alias("url_filename"), F.col("u.status").alias("status"), F.col("u.content_type").alias("content_type"), F.col("u.fetched_at").alias("fetched_at"),
    )


def _references(page: DataFrame, occurrence: DataFrame) -> DataFrame:
    """A row for each reference with its page. Pages are looked up before anything of the images is there, so what is dealt for it stays narrow."""
    o, p = occurrence.alias("o"), page.alias("p")
    return o.join(p, F.col("p.page_id") == F.col("o.page_id"), "left").select(F.col("o.image_id").alias("_image"), F.col("p.url").alias("page_url"), F.col("o.kind").alias("kind"), F.col("o.context").alias("context"))


def manifest(page: DataFrame, image_url: DataFrame, file: DataFrame, occurrence: DataFrame) -> DataFrame:
    """One row for each reference to each stored image; an image without references has one row without them."""
    rows = _images(image_url, file).join(_references(page, occurrence), F.col("image_id") == F.col("_image"), "left")
    return rows.select(*MANIFEST_COLUMNS)


def manifest_ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("file", "image_url", "page_url", "kind")


def url_audit(image_url: DataFrame, file: DataFrame) -> DataFrame:
    """Every image URL with what became of it."""
    f = file.select(F.col("sha256").alias("_sha"), F.col("path").alias("file"))
    joined = image_url.join(f, F.col("sha256") == F.col("_sha"), "left")
    return joined.select("image_id", F.col("url").alias("image_url"), "state", "skip_reason", "error", "sha256", "file", "status", "source")


def _gathered() -> Column:
    """References in their order; those without a kind are none."""
    return F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct(F.col("page_url").alias("page"), "kind", "context"))))


def _files(by_url: DataFrame) -> DataFrame:
    url = F.struct(F.col("image_url").alias("url"), "final_url", "url_filename", "status", "content_type", stamp(F.col("fetched_at")).alias("fetched_at"), "referenced_by")
    return by_url.groupBy("file", "sha256", "bytes", "format").agg(F.array_sort(F.collect_list(url)).alias("urls"))


def nested(rows: DataFrame) -> DataFrame:
    """A row for each file with `urls`, each with its `referenced_by`."""
    return _files(rows.groupBy("file", "sha256", "bytes", "format", "image_url", "final_url", "url_filename", "status", "content_type", "fetched_at").agg(_gathered().alias("referenced_by")))


def nested_tables(page: DataFrame, image_url: DataFrame, file: DataFrame, occurrence: DataFrame) -> DataFrame:
    """What `nested` gives for the manifest of these tables. References are gathered by image, before they meet its file."""
    refs = _references(page, occurrence).repartition("_image").groupBy("_image").agg(_gathered().alias("refs"))
    by_url = _images(image_url, file).join(refs, F.col("image_id") == F.col("_image"), "left")
    none = F.array().cast(refs.schema["refs"].dataType)
    return _files(by_url.withColumn("referenced_by", F.coalesce("refs", none)))


def document_lines(rows: DataFrame, target: list[str], status: str | None) -> DataFrame:
    """`place, file, image_url, page_url, kind, line`: in this order the lines make one JSON document with `target`, `status` and
    the `files`, each with its `urls`, each with its `referenced_by`.

    No file is ever gathered: a line belongs to one reference and opens or closes what differs from the line before. Lines are
    made by ranges of the order, and each range gets the last file and URL of those before it.
    """
    order = ["file", "image_url", "page_url", "kind", "context"]
    dealt, _ = in_ranges(rows, order)
    ends = dealt.groupBy("_range").agg(F.max(F.struct("file", "image_url")).alias("end"))
    ranges = Window.orderBy("_range")  # a row for each range
    ends = ends.select(F.col("_range").alias("_r"), F.lag("end").over(ranges).alias("end"))
    w = Window.partitionBy("_range").orderBy(*order)
    before = F.coalesce(F.lag(F.struct("file", "image_url")).over(w), F.col("end"))
    at = dealt.join(F.broadcast(ends), F.col("_range") == F.col("_r")).withColumn("before", before)
    first, same_file = F.col("before").isNull(), F.coalesce(F.col("before.file") == F.col("file"), F.lit(False))
    same_url = same_file & (F.col("before.image_url") == F.col("image_url"))
    opened = lambda *names: F.expr(f"left(to_json(struct({', '.join(names)}), map('ignoreNullFields', 'false')), length(to_json(struct({', '.join(names)}), map('ignoreNullFields', 'false'))) - 1)")
    file = F.concat(opened("file", "sha256", "bytes", "format"), F.lit(',"urls":['))
    url = F.concat(opened("image_url AS url", "final_url", "url_filename", "status", "content_type", "date_format(fetched_at, \"yyyy-MM-dd'T'HH:mm:ss'+00:00'\") AS fetched_at"), F.lit(',"referenced_by":['))
    ref = F.when(F.col("kind").isNotNull(), F.expr("to_json(struct(page_url AS page, kind, context), map('ignoreNullFields', 'false'))")).otherwise("")
    begin = F.when(first, F.concat(file, url)).when(~same_file, F.concat(F.lit("]}]},"), file, url)).when(~same_url, F.concat(F.lit("]},"), url)).otherwise(",")
    keys = ["place", "file", "image_url", "page_url", "kind"]
    lines = at.select(F.lit(1).alias("place"), "file", "image_url", "page_url", "kind", F.concat(begin, ref).alias("line"))
    none = [F.lit(None).cast("string").alias(k) for k in keys[1:]]
    head = rows.sparkSession.range(1).select(F.lit(0).alias("place"), *none, F.lit(json.dumps({"target": target, "status": status})[:-1] + ', "files": [').alias("line"))
    foot = rows.agg(F.count("*").alias("n")).select(F.lit(2).alias("place"), *none, F.when(F.col("n") > 0, "]}]}]}").otherwise("]}").alias("line"))
    return head.unionByName(lines).unionByName(foot).orderBy(*keys)


def mirror_paths(image_url: DataFrame, file: DataFrame) -> DataFrame:
    """`path, target` of a tree that follows the URLs' paths. A name gets the stored file's extension; different files that
    want one name get `~1`, `~2` ... in the order of their images, equal files share it. Data URIs have no place in it."""
    url = F.coalesce(F.nullif("final_url", F.lit("")), "url")
    rows = image_url.filter("state = 'done'").join(file.select("sha256", "path"), "sha256").withColumn("at", url).filter(~F.col("at").startswith("data:"))
    parts = F.filter(F.transform(F.split(U.path_of(F.col("at")), "/"), lambda s: T.safe_segment(U.percent_decode(s))), lambda s: s != "")
    rows = rows.withColumn("parts", F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit("index")))).withColumn("ext", F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    last = F.element_at("parts", -1)
    stem = F.when(F.lower(last).endswith(F.lower("ext")), F.substring(last, F.lit(1), F.length(last) - F.length("ext"))).otherwise(last)
    host = T.safe_segment(F.when(U.host_of(F.col("at")) != "", U.host_of(F.col("at"))).otherwise("_"))
    folder = F.array_join(F.concat(F.array(host), F.slice("parts", F.lit(1), F.size("parts") - 1)), "/")
    named = rows.select("image_id", "path", "ext", F.concat_ws("/", folder, stem).alias("stem"))
    once = named.groupBy("stem", "ext", "path").agg(F.min("image_id").alias("image_id"))
    n = F.row_number().over(Window.partitionBy("stem", "ext").orderBy("image_id")) - 1
    return once.withColumn("n", n).select("path", F.concat("stem", F.when(F.col("n") > 0, F.concat(F.lit("~"), F.col("n").cast("string"))).otherwise(""), "ext").alias("target"))


def csv_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The `line`s of a CSV file with its head, in order; nulls come first."""
    have = rows.select(F.lit(1).alias("_place"), *columns, *[k for k in order if k not in columns])
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in have.schema][1:]
    dealt = rows.sparkSession.range(1).select(F.lit(0).alias("_place"), *blank).unionByName(have).orderBy("_place", *order)
    # lines are made once the rows lie in order: they repeat what the order is by
    return dealt.select(F.when(F.col("_place") == 0, ",".join(columns)).otherwise(F.to_csv(F.struct(*columns), {"escape": '"'})).alias("line"))


def manifest_lines(rows: DataFrame) -> DataFrame:
    """`manifest.csv` as lines."""
    return csv_lines(rows.withColumn("fetched_at", stamp(F.col("fetched_at"))), MANIFEST_COLUMNS, ["file", "image_url", "page_url", "kind"])


def audit_lines(audit: DataFrame) -> DataFrame:
    """`urls.csv` as lines."""
    return csv_lines(audit, URL_COLUMNS, ["image_id"])


def export_all(store: Store, friendly: bool = False, one_file: bool = False) -> dict[str, str]:
    """Writes `manifest.csv`, `manifest.json` and `urls.csv` into the output folder, and on request the mirror tree.

    Each is a folder of parts of Spark's own commit protocol, those of `manifest.json` one after another being one JSON document;
    with `one_file` each is one file, which takes the place of a folder of its name.
    """
    t = store.tables()
    rows = manifest(t["page"], t["image_url"], t["file"], t["occurrence"])
    out = store.out
    if one_file:
        meta = store.meta()
        write_document(manifest_lines(rows), f"{out}/manifest.csv")
        write_document(document_lines(rows, meta.get("config", {}).get("seeds", []), meta.get("status")), f"{out}/manifest.json")
        write_document(audit_lines(url_audit(t["image_url"], t["file"])), f"{out}/urls.csv")
        if friendly:
            link_tree(mirror_paths(t["image_url"], t["file"]), out)
        return {n: f"{out}/{n}" for n in ("manifest.csv", "manifest.json", "urls.csv")}
    flat = manifest_ordered(rows).withColumn("fetched_at", stamp(F.col("fetched_at"))).select(*MANIFEST_COLUMNS)
    flat.write.mode("overwrite").csv(f"{out}/manifest.csv", header=True, escape='"')
    meta = store.meta()
    document_lines(rows, meta.get("config", {}).get("seeds", []), meta.get("status")).select("line").write.mode("overwrite").text(f"{out}/manifest.json")
    url_audit(t["image_url"], t["file"]).orderBy("image_id").select(*URL_COLUMNS).write.mode("overwrite").csv(f"{out}/urls.csv", header=True, escape='"')
    if friendly:
        link_tree(mirror_paths(t["image_url"], t["file"]), out)
    return {n: f"{out}/{n}" for n in ("manifest.csv", "manifest.json", "urls.csv")}


def link_tree(paths: DataFrame, out: str) -> int:
    """Hard-links the stored files into `friendly/`; copies them where a store has no links. What is there already stays."""

    def link(batches):
        import pandas as pd
        from pyarrow.fs import FileType

        fs, root = file_system(out)
        for t in batches:
            made = 0
            for path, target in zip(t.path, t.target):
                src, dst = f"{root}/{path}", f"{root}/friendly/{target}"
                if fs.get_file_info(dst).type != FileType.NotFound:
                    continue
                fs.create_dir(dst.rpartition("/")[0], recursive=True)
                try:
                    if fs.type_name != "local":
                        raise OSError("no links here")
                    os.link(src, dst)
                except FileExistsError:
                    continue
                except OSError:
                    fs.copy_file(src, dst)
                made += 1
            yield pd.DataFrame({"n": [made]})

    return paths.mapInPandas(link, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
