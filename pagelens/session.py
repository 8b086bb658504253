"""The commands as functions: crawl, status, export, retry, archive queue, purge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens import export, reports
from pagelens.config import Config, check_runnable
from pagelens.operators.ladder import first_pages
from pagelens.plans.crawl import Crawl
from pagelens.sources import readers
from pagelens.state import Store, requeue_failed


class Session:
    def __init__(self, spark: SparkSession, cfg: Config):
        check_runnable(cfg)
        self.spark, self.cfg, self.store = spark, cfg, Store(spark, cfg.out)

    def crawl(self, responses: DataFrame, *, dry_run: bool = False, overwrite: bool = False, images_only: DataFrame | None = None, max_rounds: int | None = None, friendly: bool = False, stop: Callable[[], bool] = lambda: False) -> tuple[str, int]:
        """Runs or resumes a crawl over a snapshot; gives its status and exit code. `images_only(url)` replaces the pages by a list of images."""
        resumed = self.store.open(self.cfg, overwrite)
        c = Crawl(self.spark, responses, self.cfg, dry_run)
        if images_only is not None and not resumed:
            c.seed_images(images_only)
        status = c.run(max_rounds, stop)
        export.export_all(self.store, friendly)
        t = self.store.tables()
        return status, reports.exit_code(t["page"], t["image_url"], status)

    def status(self) -> dict:
        t = self.store.tables()
        meta = self.store.meta()
        out: dict = {"status": meta.get("status"), "statistics": (meta.get("runs") or [{}])[-1].get("statistics")}
        for r in sorted(reports.counts(t["page"], t["image_url"], t["file"]).collect(), key=lambda r: (r.section, r.key or "")):
            out.setdefault(r.section, {})[r.key] = r.n
        out["skipped"] = dict(sorted(out.get("skipped", {}).items(), key=lambda kv: (-kv[1], kv[0] or "")))
        out["top_hosts"] = [tuple(r) for r in reports.top_hosts(t["file"]).collect()]
        out["errors"] = [tuple(r) for r in reports.recent_errors(t["page"], t["image_url"]).collect()]
        return out

    def export(self, friendly: bool = False, one_file: bool = False) -> dict[str, str]:
        return export.export_all(self.store, friendly, one_file)

    def retry(self, responses: DataFrame) -> tuple[str, int]:
        """Queues what failed once more and goes on."""
        self.store.commit({n: requeue_failed(self.store.table(n)) for n in ("page", "image_url")}, status="limit")
        return self.crawl(responses)

    def queue_archive(self, cdx: DataFrame, domain: str) -> tuple[int, int]:
        """Queues the rows of an archive index; gives how many are new and how many are not."""
        self.store.open(self.cfg)
        rows = readers.queue_archive(first_pages(cdx, self.cfg.wayback.limit, ["pos"]), self.cfg, domain).cache()
        images, occurrences = self.store.table("image_url"), self.store.table("occurrence")
        old = images.select("url")
        added = rows.filter("outcome = 'added'").join(old, "url", "left_anti").count()
        total = rows.count()
        top = images.agg(F.max("image_id")).first()[0] or 0
        from pagelens.operators.ordered import first_by, rank

        fresh = first_by(rows.filter("url is not null").select("url", "source", "skip_reason", "pos"), ["url"], ["pos"]).join(old, "url", "left_anti")
        new = rank(fresh, ["pos"], "_n").withColumns({"image_id": F.col("_n") + top, "state": F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("queued")})
        have = set(new.columns)
        typed = new.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in images.schema])
        everything = images.unionByName(typed)
        seen = first_by(rows.filter("url is not null").join(everything.select("url", "image_id"), "url").select("image_id", "kind", "context", "pos"), ["image_id", "kind"], ["pos"])
        known = occurrences.filter("page_id is null").select("image_id", "kind")
        more = seen.join(known, ["image_id", "kind"], "left_anti").select("image_id", F.lit(None).cast("long").alias("page_id"), "kind", "context")
        self.store.commit({"image_url": everything, "occurrence": occurrences.unionByName(more)}, seeded=True)
        rows.unpersist()
        return added, total - added

    def purge(self) -> list[str]:
        return self.store.purge()
