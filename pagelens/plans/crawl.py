"""A crawl over a snapshot of responses, as rounds of joins until nothing is queued.

The snapshot is read once into a link index (`linkindex`). A round takes all queued assets, or if there are none the queued
pages that the page budget allows, looks up what becomes of them, follows their links by number, and appends what is new.
Where several rows want the same URL the first one wins, in the order of (parent, place in the parent). Rows are kept as
changes in buckets (`changes`), so a round deals and writes what is new in it, and each round is committed as one generation.
Images lead to no further pages, so all of them are found and handled once, at the end.
"""

from __future__ import annotations

import logging
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagelens import reports
from pagelens.changes import Changes, beside, undeclare
from pagelens.config import Config
from pagelens.extract import html, rewrite
from pagelens.functions import binary as B
from pagelens.functions import text as T
from pagelens.functions import url as U
from pagelens.operators import ladder, policy, politeness
from pagelens.operators.ordered import first_by, rank, running_total
from pagelens.plans.linkindex import AGENT, MOST_ROBOTS_BYTES, LinkIndex
from pagelens.sources.sinks import write_files
from pagelens.state import FIXED, VARYING, Store, recover
from pagelens.storage import kept

MOST_SITEMAPS = 1000
_ORDER = ["parent", "section", "pos"]
_FOUND = ["round", *_ORDER]
#: Generations after which the changes of a run are written as one.
MOST_GENERATIONS = 32
_OPEN = "u page_id url kind depth discovered_from".split()


class _Rounds:
    """The pages of a run while it is under way: their changes, and what is still queued."""

    def __init__(self, crawl: Crawl, index: LinkIndex, pages: DataFrame):
        self.crawl, self.index, self.cfg, self.spark, self.store = crawl, index, crawl.cfg, crawl.spark, crawl.store
        self.root = index.root
        base = self._kept(pages.join(index.urls.select("u", "url"), "url"), "base")
        n = base.agg(
            F.coalesce(F.max("page_id"), F.lit(0)).alias("top"), F.count_if(F.expr("kind = 'page' and state in ('in_progress', 'done', 'failed')")).alias("started"), F.count_if(F.col("kind") == "sitemap").alias("sitemaps"),
            F.count_if(F.expr("state = 'queued' and kind <> 'page'")).alias("assets"), F.count_if(F.expr("state = 'queued' and kind = 'page'")).alias("pages"), F.count_if(F.expr("state <> 'skipped'")).alias("live"),
        ).first()
        self.top, self.started, self.sitemaps, self.live = n.top, n.started, n.sitemaps, n.live
        queued = base.filter("state = 'queued'").select(*_OPEN)
        self.assets = [queued.filter("kind <> 'page'")] if n.assets else []
        self.pages = [queued.filter("kind = 'page'")] if n.pages else []
        self.n_pages = n.pages
        self.patterns = [base.filter("pattern is not null and state <> 'skipped'").groupBy("pattern").agg(F.count("*").alias("n"))]
        self.gen = self.n = 0
        self.totals = Counter()
        self.steps: list[DataFrame] = []
        self.changes = Changes(self.spark, f"{self.root}/changes", FIXED, VARYING, index.buckets)
        self.changes.append(base, 0, born=True)
        self._commit(seeded=True)

    def _kept(self, df: DataFrame, name: str, counts: dict[str, Column] | None = None) -> DataFrame:
        """The rows as files of this run; counts are taken on the way."""
        path = f"{self.root}/{name}"
        seen = Observation(uuid.uuid4().hex) if counts else None
        (df.observe(seen, *[v.alias(k) for k, v in counts.items()]) if counts else df).write.mode("overwrite").parquet(path)
        self.seen = seen.get if seen else {}
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, **meta) -> None:
        self.store.set_meta(open_run={"path": self.changes.path, "buckets": self.index.buckets, "gen": self.gen}, **meta)

    @staticmethod
    def _all(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _frontier(self) -> DataFrame | None:
        """All queued assets, else the queued pages that the budget allows; they are queued no more."""
        if self.assets:
            out, self.assets = self._all(self.assets), []
            return out
        left = self.cfg.limits.max_pages - self.started
        if not self.pages or left <= 0:
            return None
        out = self._all(self.pages)
        if self.n_pages <= left:
            self.pages, self.n_pages = [], 0
            return out
        first = self._kept(ladder.first_pages(out, left, ["depth", "page_id"], self.n_pages), f"first-{self.n}")
        self.pages = [self._kept(out.join(first.select("u"), "u", "left_anti"), f"rest-{self.n}")]
        self.n_pages -= left
        return first

    def round(self) -> bool:
        """One round; false if there was nothing to do."""
        frontier = self._frontier()
        if frontier is None:
            return False
        self.n += 1
        index = self.index
        answers = index.answers.withColumnsRenamed({"u": "_u", "kind": "_kind"})
        same = F.col("kind").between(F.col("_kind"), F.col("_kind"))  # no key, else the buckets of `u` alone would not do
        done = beside(frontier, "u", index.buckets).join(answers, (F.col("u") == F.col("_u")) & same).drop("_u", "_kind")
        page, state = F.col("kind") == "page", F.col("state")
        step = self._kept(done.withColumn("round", F.lit(self.n)), f"step-{self.n}", {
            "started": F.count_if(page & state.isin("done", "failed")), "pages": F.count_if(page & state.isin("done", "failed")), "pages_failed": F.count_if(page & (state == "failed")),
            "assets": F.count_if(~page & (state == "done")), "rendered": F.count_if("rendered"), "good": F.count_if("good"), "dropped": F.count_if(state == "skipped"),
        })
        seen = self.seen
        self.steps.append(step)
        self.changes.append(step, self.gen + 1, born=False)
        self.started += seen["started"]
        self.live -= seen["dropped"]
        self.totals.update({k: seen[k] for k in ("pages", "pages_failed", "assets", "rendered")})
        if seen["good"]:
            self._grow(step.filter("good"))
        self.gen += 1
        if self.gen % MOST_GENERATIONS == 0:
            old, self.changes = self.changes, self.changes.compact(f"{self.root}/changes-{self.gen}", self.gen)
            self._commit()
            undeclare(self.spark, old.path)
            self.store.delete(old.path)
        self._commit()
        return True

    def _grow(self, good: DataFrame) -> None:
        """Appends the pages and assets that this round finds and no row has yet."""
        index, cfg = self.index, self.cfg
        deepest = cfg.limits.max_depth
        links = index.links.withColumnsRenamed({"u": "to", "kind": "to_kind"})
        readers = beside(good.select("page_id", "depth", "fu", F.col("kind").alias("skind0")), "fu", index.buckets)
        found = readers.join(links, (F.col("fu") == F.col("src")) & F.col("skind0").between(F.col("skind"), F.col("skind")))
        section = F.col("section")
        depth = F.when(section == 0, F.col("depth") + 1).when(section == 1, F.lit(1)).otherwise(F.col("depth"))
        rows = found.select(F.col("to").alias("u"), F.col("to_kind").alias("kind"), depth.alias("depth"), F.col("page_id").alias("parent"), "section", "pos").filter((section > 1) | (F.col("depth") <= deepest))
        moved = good.filter("moved").select(F.col("fu").alias("u"), F.lit("page").alias("kind"), "depth", F.col("page_id").alias("parent"), F.lit(6).alias("section"), F.lit(0).alias("pos"))
        wanted = self._kept(first_by(rows.unionByName(moved), ["u"], _ORDER), f"wanted-{self.n}")
        fresh = beside(self.changes.unseen(wanted, self.gen), "u", index.buckets).join(index.urls, "u").withColumns({"pattern": F.when(section < 2, F.col("pattern")), "skip_reason": F.when(section == 6, "duplicate:redirect")})
        fresh = self._kept(fresh, f"fresh-{self.n}", {"n": F.count(F.lit(1)), "patterned": F.count("pattern"), "sitemaps": F.count_if(F.col("kind") == "sitemap")})
        n, patterned, sitemaps = (self.seen[k] for k in ("n", "patterned", "sitemaps"))
        if not n:
            return
        if self.live + patterned > cfg.limits.max_pages_per_pattern:  # else no pattern can have too many
            own = fresh.filter("pattern is not null").drop("skip_reason")
            prior = self._all(self.patterns).join(own.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(F.sum("n").alias("n"))
            fresh = fresh.filter("pattern is null").unionByName(ladder.pattern_limited(own, prior, cfg.limits.max_pages_per_pattern, _ORDER))
        if self.sitemaps + sitemaps > MOST_SITEMAPS:
            few = ladder.first_pages(fresh.filter("kind = 'sitemap'"), MOST_SITEMAPS - self.sitemaps, _ORDER, sitemaps)
            fresh = fresh.filter("kind <> 'sitemap'").unionByName(few)
        named = rank(fresh, [*_ORDER, "u"], "_n", n).select(
            "u", (F.col("_n") + self.top).alias("page_id"), "url", "kind", "depth", F.when(F.col("parent") > 0, F.col("parent")).alias("discovered_from"), "pattern",
            F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("queued").alias("state"), "skip_reason",
            *[F.lit(None).alias(c) for c in ("status", "final_url", "content_type", "fetched_at", "error")], F.lit(False).alias("rendered"),
        )
        queued = F.col("state") == "queued"
        new = self._kept(self._typed(named), f"new-{self.n}", {
            "n": F.count(F.lit(1)), "assets": F.count_if(queued & (F.col("kind") != "page")), "pages": F.count_if(queued & (F.col("kind") == "page")), "sitemaps": F.count_if(F.col("kind") == "sitemap"), "live": F.count_if(queued),
            "top": F.max("page_id"),
        })
        seen = self.seen
        if not seen["n"]:
            return
        self.changes.append(new, self.gen + 1, born=True)
        self.top, self.live, self.sitemaps = seen["top"], self.live + seen["live"], self.sitemaps + seen["sitemaps"]
        opened = new.filter(queued).select(*_OPEN)
        if seen["assets"]:
            self.assets.append(opened.filter("kind <> 'page'"))
        if seen["pages"]:
            self.pages.append(opened.filter("kind = 'page'"))
            self.n_pages += seen["pages"]
        if patterned:
            self.patterns.append(new.filter(queued & F.col("pattern").isNotNull()).groupBy("pattern").agg(F.count("*").alias("n")))

    def _typed(self, df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType for f in self.changes.schema}
        return df.select(*[F.col(c).cast(kinds[c]).alias(c) for c in df.columns])

    def progress(self) -> dict[str, int]:
        """Counts of this run, taken while its rows were written."""
        return {**self.totals, "pages_queued": self.n_pages, "rows": self.top}

    def found_images(self) -> DataFrame | None:
        """The references to images of all bodies that were read in this run, in the order in which they were found."""
        if not self.steps:
            return None
        good = self._all(self.steps).filter("good").select("page_id", F.col("kind").alias("_kind"), F.col("final_url").alias("_final"), F.col("url").alias("_asked"), "discovered_from", "direct", "round")
        refs = self.index.images().join(good.filter("not direct"), (F.col("final_url") == F.col("_final")) & (F.col("skind") == F.col("_kind")))
        out = refs.select("url", "kind", "context", "round", F.col("page_id").alias("parent"), "section", "pos", "page_id")
        direct = good.filter("direct").select(F.col("_final").alias("url"), F.lit("page:direct").alias("kind"), F.col("_asked").alias("context"), "round", F.col("page_id").alias("parent"), F.lit(8).alias("section"), F.lit(0).alias("pos"), F.col("discovered_from").alias("page_id"))
        out = out.unionByName(direct)
        if not self.cfg.filters.data_uris:
            out = out.filter(~F.col("url").startswith("data:"))
        return out.withColumn("source", F.lit("live"))

    def close(self) -> None:
        """Writes the pages of the run as the table of pages; its changes are needed no more."""
        self.store.commit({"page": self.changes.current(self.gen)}, open_run=None)
        undeclare(self.spark, self.changes.path)
        self.index.close()


class Crawl:
    def __init__(self, spark: SparkSession, responses: DataFrame, cfg: Config, dry_run: bool = False):
        self.spark, self.cfg, self.dry_run = spark, cfg, dry_run
        self.responses = responses
        self.options = html.Options(frozenset(cfg.discovery.lazy_attrs), cfg.filters.srcset, cfg.filters.data_uris, cfg.discovery.css, cfg.discovery.jsonld, cfg.discovery.manifest)
        self.rules = rewrite.rules(cfg.upgrade, cfg.upgrade_rules)
        self.robots: DataFrame | None = None
        self.store = Store(spark, cfg.out)
        self.rounds: _Rounds | None = None

    def _robots(self) -> DataFrame:
        """A row for each origin of a captured robots.txt."""
        at = self.responses.filter(F.col("url").endswith("/robots.txt")).select("url", "status", "body")
        files = at.filter(U.path_and_query(F.col("url")) == "/robots.txt").select(
            U.origin_of(F.col("url")).alias("origin"), F.when(F.length("body") <= MOST_ROBOTS_BYTES, F.col("status")).alias("status"), F.make_valid_utf8("body").alias("body")
        )
        return kept(policy.robots_table(files, AGENT), "robots")

    def _fetched(self, wanted: DataFrame, reasons: dict, by: Column) -> DataFrame:
        """Rows with what their URL answers in the end. Origins without a captured robots.txt count as having none."""
        if self.robots is None:
            self.robots = self._robots()
        hops = self.responses.select("url", "status", "location")
        respect = self.cfg.robots != "ignore" and not self.robots.isEmpty()
        allowed = policy.with_robots(wanted, "url", self.robots, respect, unknown=True)
        ends = self._kept(politeness.follow_redirects(allowed, hops, reasons, by), "fetched")
        body = self.responses.select(F.col("url").alias("_u"), F.lower(F.coalesce("content_type", F.lit(""))).alias("ctype"), "content_length", "headers", "body", "fetched_at")
        return ends.withColumnRenamed("status", "http").join(body, (F.col("final_url") == F.col("_u")) & F.col("robots_ok"), "left").drop("_u")

    # Pages.

    def seeds(self) -> DataFrame:
        """The rows that a new crawl starts with."""
        cfg, spark = self.cfg, self.spark
        seeds = spark.createDataFrame([(s, i) for i, s in enumerate(cfg.seeds)], "raw string, pos int")
        pages = seeds.select(U.normalize(F.col("raw"), cfg.http.strip_page_params).alias("url"), "pos").filter("url is not null").withColumns({"kind": F.lit("page"), "pattern": U.url_pattern(F.col("url"))})
        if cfg.discovery.sitemaps:
            origins = pages.select(U.origin_of(F.col("url")).alias("origin")).distinct()
            maps = policy.sitemap_urls(origins, self.robots, cfg.scope).select("url", F.lit(1 << 20).alias("pos"), F.lit("sitemap").alias("kind"), F.lit(None).cast("string").alias("pattern"))
            pages = pages.unionByName(maps)
        rows = rank(first_by(pages, ["url"], ["pos", "url"]), ["pos", "url"], "page_id")
        own = rows.withColumns({"depth": F.lit(0), "state": F.lit("queued"), "rendered": F.lit(False)})
        have = set(own.columns)
        return own.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.store.schema("page")])

    def start(self) -> _Rounds | None:
        """Reads the snapshot and readies the rounds; none if no page is queued."""
        store = self.store
        seeded = store.meta().get("seeded")
        if seeded and store.table("page").filter("state = 'queued'").isEmpty():
            return None
        index = LinkIndex(self.spark, f"{store.root}/run-{uuid.uuid4().hex[:12]}", self.cfg, self.options).read(self.responses)
        self.robots = index.robots
        pages = index._kept(store.table("page") if seeded else self.seeds(), "known")
        index.finish(pages)
        return _Rounds(self, index, pages)

    # Images.

    def seed_images(self, urls: DataFrame) -> None:
        """Starts from a list of image URLs (`url`) instead of pages."""
        listed = urls.select(U.normalize(F.col("url")).alias("url"), F.lit("list").alias("kind"), F.lit("").alias("context")).filter("url is not null")
        refs = listed.withColumns({"round": F.lit(0), "parent": F.lit(None).cast("long"), "section": F.lit(0), "pos": F.lit(0), "source": F.lit("list"), "page_id": F.lit(None).cast("long")})
        images, occurrences = self._new_images(refs, self.store.table("image_url"), self.store.table("occurrence"))
        self.store.commit({}, {"image_url": images, "occurrence": occurrences}, seeded=True)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """The rows as files: what several later steps read is worked out once, and their plans stay small."""
        path = f"{self.store.root}/work/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def add_images(self) -> None:
        """Adds what the pages of this run refer to to the images and their occurrences."""
        found = self.rounds.found_images() if self.rounds else None
        if found is not None:
            images, occurrences = self._new_images(found, self.store.table("image_url"), self.store.table("occurrence"))
            self.store.commit({}, {"image_url": images, "occurrence": occurrences})

    def _new_images(self, refs: DataFrame, images: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that the references add to the image and the occurrence tables."""
        scope = self.cfg.scope
        if self.rules:
            better = refs.filter(~F.col("url").startswith("data:")).withColumn("_v", F.explode_outer(rewrite.variants(F.col("url"), self.rules))).filter("_v is not null")
            better = better.withColumns({"url": U.normalize(F.col("_v")), "kind": F.concat("kind", F.lit("+upgrade"))}).drop("_v").filter("url is not null")
            refs = refs.unionByName(better)
        inline = F.col("url").startswith("data:")
        refs = refs.withColumn("_d", F.when(inline, B.decode_data_uri(F.col("url")))).filter(~inline | F.col("_d").isNotNull())
        refs = refs.withColumns({
            "url": F.when(F.col("_d").isNotNull(), B.data_uri_key(F.col("_d.mime"), F.col("_d.data"))).otherwise(F.col("url")),
            "kind": F.when(F.col("_d").isNotNull(), F.concat("kind", F.lit("(data-uri)"))).otherwise(F.col("kind")),
            "source": F.when(F.col("_d").isNotNull(), "data-uri").otherwise(F.col("source")),
            "inline": F.col("_d.data"), "context": T.collapse(F.col("context")),
        }).drop("_d")
        refs = self._kept(refs, "made")
        fresh = first_by(refs.select("url", "source", "inline", *_FOUND, "kind"), ["url"], [*_FOUND, "kind"]).join(images.select("url"), "url", "left_anti")
        fresh = self._kept(fresh, "fresh")
        top = images.agg(F.max("image_id")).first()[0] or 0
        reason = F.when(F.col("source") != "data-uri", policy.image_reason(F.col("url"), scope))
        blank = {c: F.lit(None) for c in ("sha256", "final_url", "status", "content_type", "headers", "url_filename", "fetched_at", "error")}
        rows = rank(fresh, [*_FOUND, "kind", "url"], "_n", fresh.count()).withColumn("image_id", F.col("_n") + top).withColumns(blank).withColumn("skip_reason", reason)
        rows = rows.withColumn("state", F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("queued"))
        typed = self._kept(rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in images.schema]), "images")
        all_images = images.unionByName(typed)
        seen = refs.join(all_images.select("url", "image_id"), "url").withColumn("_page", F.coalesce("page_id", F.lit(0)))
        first = first_by(seen.select("image_id", "_page", "kind", "page_id", "context", *_FOUND), ["image_id", "_page", "kind"], _FOUND)
        known = occurrences.select("image_id", F.coalesce("page_id", F.lit(0)).alias("_page"), "kind")
        added = first.join(known, ["image_id", "_page", "kind"], "left_anti").select("image_id", "page_id", "kind", "context")
        return typed, added

    def save_images(self) -> bool:
        """Fetches and stores all queued images; true if the byte budget left some queued."""
        cfg, store = self.cfg, self.store
        images, files = store.table("image_url"), store.table("file")
        queued = images.filter("state = 'queued'")
        if self.dry_run:
            queued = queued.filter("source = 'data-uri'")
        if queued.isEmpty():
            return False
        scope = cfg.scope
        have = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

        reasons = {"image": lambda u: policy.image_reason(u, scope), "archive": policy.archive_only}
        web = self._fetched(queued.filter("source <> 'data-uri'").select("image_id", "url", "source"), reasons, F.when(F.col("source") == "wayback-archive", "archive").otherwise("image"))
        own = queued.filter("source = 'data-uri'").select("image_id", "url", F.col("inline").alias("body"))
        gate = F.when(~F.col("robots_ok"), "robots").when(F.col("denied").isNotNull(), F.col("denied"))
        failure = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("http") != 200, F.concat(F.lit("HTTP "), F.col("http").cast("string")))
        port = F.regexp_extract(F.col("final_url"), r"^[a-z]+://[^/]*:([0-9]+)(?:/|$)", 1)
        web = web.select(
            "image_id", "url", "final_url", F.col("http").alias("status"), F.col("ctype").alias("content_type"), F.to_json("headers").alias("headers"), "fetched_at", "body", F.col("content_length").alias("declared"),
            gate.alias("gate"), F.when(gate.isNull(), failure).alias("failure"), U.host_dir(U.host_of(F.col("final_url")), F.when(port != "", port)).alias("host_folder"),
            F.coalesce(F.nullif(F.substring(U.disposition_filename(F.element_at("headers", "content-disposition")), 1, 255), F.lit("")), U.url_filename(F.col("final_url"))).alias("url_filename"),
        )
        blank = {c: F.lit(None).cast(web.schema[c].dataType) for c in web.columns if c not in ("image_id", "url", "body", "host_folder")}
        rows = web.unionByName(own.withColumn("host_folder", F.lit("_data-uri")).withColumns(blank))
        climbed = ladder.climb(rows.withColumn("body", F.when(F.col("gate").isNull() & F.col("failure").isNull(), F.coalesce("body", F.lit(b""))).otherwise(F.lit(b""))), cfg.filters, cfg.limits)
        stops = F.coalesce("gate", F.when(F.col("failure").isNull(), F.col("skip_reason")))
        climbed = climbed.withColumn("skip_reason", stops).withColumn("sha256", F.when(F.col("skip_reason").isNull() & F.col("failure").isNull(), F.col("sha256")))
        spent = F.when(F.col("outcome") == "saved", F.col("bytes")).otherwise(F.lit(0)).cast("long")
        seen = Observation(uuid.uuid4().hex)
        climbed = self._kept(climbed, "climbed")
        claimed = self._kept(ladder.store(climbed, "image_id", files).observe(seen, F.sum(spent).alias("bytes")), "stored")
        if have + (seen.get["bytes"] or 0) >= cfg.limits.max_total_bytes:  # else the budget holds for all
            claimed = running_total(claimed, ["image_id"], spent, "_before").filter(F.col("_before") + have < cfg.limits.max_total_bytes).drop("_before")
        ends = claimed.select(
            "image_id", F.when(F.col("failure").isNotNull(), "failed").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("done").alias("_state"), F.col("skip_reason").alias("_skip"),
            F.col("sha256").alias("_sha"), F.col("final_url").alias("_final"), F.col("status").alias("_status"), F.substring("content_type", 1, 100).alias("_ctype"), F.col("headers").alias("_headers"),
            F.col("url_filename").alias("_name"), F.col("fetched_at").alias("_at"), F.substring("failure", 1, 500).alias("_error"),
        )
        pairs = {"state": "_state", "skip_reason": "_skip", "sha256": "_sha", "final_url": "_final", "status": "_status", "content_type": "_ctype", "headers": "_headers", "url_filename": "_name", "fetched_at": "_at", "error": "_error"}
        new_images = images.join(ends, "image_id", "left").withColumns({k: F.coalesce(F.col(v), F.col(k)) for k, v in pairs.items()}).drop(*pairs.values())
        new_files = claimed.filter("outcome = 'saved'").select("sha256", "path", "bytes", "format", F.coalesce("fetched_at", F.current_timestamp()).alias("first_seen"))
        self._write_files(claimed.filter("outcome = 'saved'").select("image_id", "path"), rows.select("image_id", "body"))
        store.commit({"image_url": new_images, "file": files.unionByName(new_files)})
        left = store.table("image_url").filter("state = 'queued'")
        return not self.dry_run and not left.isEmpty()

    def _write_files(self, saved: DataFrame, bodies: DataFrame) -> None:
        """Content-addressed files. A name depends on the content alone, so repeated attempts write the same file."""
        write_files(saved.join(bodies, "image_id").select("path", "body"), self.cfg.out.rstrip("/"))

    def report(self, event: str, **more) -> dict:
        """Logs how far the crawl is, and gives it."""
        t = self.store.tables()
        stats = reports.statistics(t["page"], t["image_url"], t["file"]).first().asDict()
        logging.getLogger("pagelens").info(event, extra={"data": more | stats})
        return stats

    def run(self, max_rounds: int | None = None, stop: Callable[[], bool] = lambda: False) -> str:
        """Rounds until nothing is queued or a limit is met, then the images. `stop` is asked before every round: once it says so,
        the run ends as interrupted with all that is committed, and the next run goes on from there. So does `max_rounds`."""
        store = self.store
        run_id = store.begin()
        if store.meta().get("seeded"):  # rows of a run that broke off go back into the table of pages
            store.commit({n: recover(store.table(n)) for n in ("page", "image_url")}, open_run=None)
        store.clear()
        n, stopped = 0, stop()
        if not stopped:
            self.rounds = self.start()
        while self.rounds and (max_rounds is None or n < max_rounds):
            if n and (stopped := stop()):
                break
            if not self.rounds.round():
                break
            n += 1
            logging.getLogger("pagelens").info("round", extra={"data": {"round": n} | self.rounds.progress()})
        if self.rounds:
            self.add_images()
            self.rounds.close()
        if stopped or stop() or n == max_rounds:
            store.end(run_id, "interrupted", self.report("interrupted"))
            store.clear()
            return "interrupted"
        over_budget = self.save_images()
        waiting = not store.table("page").filter("state = 'queued'").isEmpty()
        status = "dry_run" if self.dry_run else "limit" if over_budget or waiting else "finished"
        store.end(run_id, status, self.report(status))
        store.clear()
        return status
