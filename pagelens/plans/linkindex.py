"""What a snapshot says, worked out in one pass over its bodies: URLs as numbers, what each answers, and where it leads.

A crawl of many rounds asks for the same facts again and again: what a URL of some kind answers in the end (robots.txt,
redirects, status, faults), and what its body refers to. None of this depends on the round. `read` reads every body once and
keeps what its kind yields; `finish` makes three tables of numbers in buckets:

- `urls(u, url, pattern)`: the dictionary,
- `answers(u, kind, ...)`: what becomes of a URL that is asked for as some kind, and the number `fu` where it ends,
- `links(src, skind, u, kind, section, pos)`: where the body of `src`, read as `skind`, leads.

HTML is read wherever it stands. Style sheets, sitemaps and manifests are told by their types and names; where some page asks
for a body as a kind that its looks do not suggest, those bodies alone are read once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.changes import bucketed, n_buckets, undeclare
from pagelens.config import Config
from pagelens.extract import columns as X
from pagelens.extract import html
from pagelens.functions import url as U
from pagelens.operators import policy, politeness
from pagelens.operators.ordered import first_by, rank

AGENT = "pagelens"
MOST_ROBOTS_BYTES = 512 * 1024
#: Kinds of pages, in the order in which their bodies are named here.
KINDS = ("page", "css", "sitemap", "manifest", "browserconfig")
_ANSWER = "kind state skip_reason status final_url content_type rendered fetched_at error good direct moved fu".split()


def class_of(kind: Column) -> Column:
    """Which scope check the hops of a kind go through."""
    return F.when(kind.isin("page", "sitemap"), "page").otherwise("asset")


class LinkIndex:
    def __init__(self, spark: SparkSession, root: str, cfg: Config, options: html.Options):
        self.spark, self.root, self.cfg, self.options = spark, root, cfg, options
        self.parts: list[DataFrame] = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # The pass over the bodies.

    def _parsed(self, rows: DataFrame, asked: Column | None = None) -> DataFrame:
        """What the bodies say. `asked` names the kinds to read a body as; where it is null its looks decide."""
        cfg = self.cfg
        ctype = F.lower(F.coalesce("content_type", F.lit("")))
        base = rows.select(
            "url", F.col("status").alias("http"), "location", ctype.alias("ctype"), "fetched_at", "body", "rendered_html", "network_images", "json_images",
            F.coalesce(F.length("body") > cfg.limits.max_page_bytes, F.lit(False)).alias("big"), F.lower(U.path_of(F.col("url"))).alias("path"), (F.lit(None).cast("array<string>") if asked is None else asked).alias("asked"),
        )
        sound = (F.col("http") == 200) & ~F.col("big")
        kind, path = F.col("ctype"), F.col("path")
        is_html = ~kind.startswith("image/") & policy.is_html(F.when(kind != "", kind), F.col("body"))
        xml = ~is_html & (kind.contains("xml") | path.endswith(".xml"))
        looks = {
            "page": is_html, "css": kind.contains("css") | path.endswith(".css"), "sitemap": xml | (~is_html & (kind.contains("gzip") | kind.startswith("text/plain") | path.endswith(".gz") | path.endswith(".txt"))),
            "manifest": kind.contains("json") | kind.contains("manifest") | path.endswith(".json") | path.endswith(".webmanifest"), "browserconfig": xml,
        }
        reads = {k: sound & F.coalesce(v if asked is None else F.array_contains("asked", k), F.lit(False)) for k, v in looks.items()}
        # Pages may lie in few files, as their bodies are small beside those of images: what is to be read is dealt by URL, so that
        # all cores read alike, and other bodies are left behind.
        robots = F.col("url").endswith("/robots.txt") & (U.path_and_query(F.col("url")) == "/robots.txt")
        base = base.withColumns({f"is_{k}": v for k, v in reads.items()}).withColumn("is_robots", robots)
        wanted = F.col("is_robots")
        for k in KINDS:
            wanted = wanted | F.col(f"is_{k}")
        parts = min(n_buckets(self.spark), 4 * self.spark.sparkContext.defaultParallelism)  # by number, for reading costs more than its bytes tell
        base = base.withColumn("body", F.when(wanted, F.col("body"))).repartition(parts, "url")
        on = lambda k, c: F.when(F.col(f"is_{k}"), F.col(c))
        text = X.decode(F.when(F.col("is_page") | F.col("is_css"), F.col("body")), F.col("ctype"))
        base = base.withColumn("text", text).withColumns({
            "html": X.html_refs(on("page", "text"), F.col("url"), self.options), "live": X.html_refs(on("page", "rendered_html"), F.col("url"), self.options),
            "css": X.css_refs(on("css", "text"), cfg.filters.srcset), "map": X.sitemap_refs(on("sitemap", "body")), "icons": X.manifest_refs(on("manifest", "body")), "tiles": X.browserconfig_refs(on("browserconfig", "body")),
        })
        wants = policy.render_wanted(F.col("url"), F.col("html.mount_nodes"), F.col("html.text_chars"), F.col("html.noscript_js"), F.size("html.images"), cfg.render.mode, cfg.render.patterns)
        short = F.length("body") <= MOST_ROBOTS_BYTES
        base = base.withColumns({
            "rendered": F.col("is_page") & F.col("rendered_html").isNotNull() & F.coalesce(wants, F.lit(False)),
            "robots": F.when(F.col("is_robots"), F.struct(F.when(short, F.col("http")).alias("status"), F.when(short, F.make_valid_utf8("body")).alias("body"))),
        })
        faults = {"page": F.coalesce("html.error", F.when(F.col("rendered"), F.col("live.error"))), "css": F.col("css.error"), "sitemap": F.col("map.error")}
        faults |= {k: F.when(F.col(f"is_{k}") & F.col(c).isNull(), "unreadable body") for k, c in (("manifest", "icons"), ("browserconfig", "tiles"))}
        return base.withColumn("faults", F.struct(*[v.alias(k) for k, v in faults.items()])).drop("body", "text", "rendered_html", "path", "asked", "is_robots")

    def read(self, responses: DataFrame) -> "LinkIndex":
        """Reads all bodies."""
        self.responses = responses
        self.parts = [self._kept(self._parsed(responses), "parsed")]
        files = self.parts[0].filter("robots is not null").select(U.origin_of(F.col("url")).alias("origin"), "robots.status", "robots.body")
        self.robots = self._kept(policy.robots_table(files, AGENT), "robots")
        self.with_robots = self.cfg.robots != "ignore" and not self.robots.isEmpty()
        return self

    def _of(self, kind: str, *columns: Column | str) -> DataFrame:
        """The bodies that were read as a kind."""
        out = None
        for p in self.parts:
            own = p.filter(f"is_{kind}").select(*columns)
            out = own if out is None else out.unionByName(own)
        return out

    # Links and images by their URLs.

    def _links(self) -> DataFrame:
        """`src, skind, url, kind, section, pos` of everything that a crawl may follow, one row for each way to a URL."""
        cfg, scope = self.cfg, self.cfg.scope
        live = F.when(F.col("rendered"), F.col("live")).otherwise(F.col("html"))

        def found(skind: str, urls: Column, kind: str, section: int) -> DataFrame:
            rows = self._of(skind, F.col("url").alias("src"), F.posexplode_outer(urls).alias("pos", "raw")).filter("raw is not null")
            return rows.select("src", F.lit(skind).alias("skind"), "raw", F.lit(kind).alias("kind"), F.lit(section).alias("section"), "pos")

        rows = found("page", live["links"], "page", 0)
        for more in (
            found("sitemap", F.col("map.pages"), "page", 1), found("sitemap", F.col("map.sitemaps"), "sitemap", 2), found("page", live["stylesheets"], "css", 3), found("css", F.col("css.imports"), "css", 3),
            found("page", live["manifests"], "manifest", 4), found("page", live["browserconfigs"], "browserconfig", 5),
        ):
            rows = rows.unionByName(more)
        is_page = F.col("kind") == "page"
        made = F.when(is_page, U.normalize(F.col("raw"), cfg.http.strip_page_params)).otherwise(U.resolve(F.col("src"), F.col("raw")))
        rows = self._kept(rows.withColumn("url", made).filter("url is not null").drop("raw"), f"made-{len(self.parts)}")
        url = F.col("url")
        allowed = F.when(is_page, policy.enqueueable(url, F.lit(0), scope, 0)).when(F.col("kind") == "sitemap", policy.page_reason(url, scope).isNull()).otherwise(policy.asset_reason(url, scope).isNull())
        # links to pages depend on the depth of their page, so they are told apart from the rest
        rows = rows.filter(allowed).withColumn("deep", F.col("section") < 2)
        return first_by(rows, ["src", "skind", "url", "deep"], ["section", "pos"]).drop("deep")

    def images(self) -> DataFrame:
        """`final_url, skind, url, kind, context, section, pos`: what bodies refer to as images."""
        none = F.lit("")

        def found(skind: str, items: Column, section: int, kind: Column | None, only: Column = F.lit(True)) -> DataFrame:
            """Items are URLs where their kind is given, else structs that have it, and those of documents are absolute."""
            rows = self._of(skind, "url", F.posexplode_outer(F.when(only, items)).alias("pos", "r")).filter("r is not null")
            bare, whole = kind is not None, section in (0, 3)
            return rows.select(
                F.col("url").alias("final_url"), F.lit(skind).alias("skind"), (F.col("r") if bare else F.col("r.url")).alias("raw"), (kind if bare else F.col("r.kind")).alias("kind"),
                (F.col("r.context") if whole else none).alias("context"), F.lit(section).alias("section"), "pos",
            )

        rendered = F.col("rendered")
        out = found("page", F.col("live.images"), 0, None, rendered)
        for more in (
            found("page", F.col("network_images"), 1, F.lit("render:network"), rendered), found("page", F.col("json_images"), 2, F.lit("render:json"), rendered), found("page", F.col("html.images"), 3, None),
            found("sitemap", F.col("map.images"), 4, F.lit("sitemap:image")), found("css", F.col("css.images"), 5, None), found("manifest", F.col("icons"), 6, None), found("browserconfig", F.col("tiles"), 7, F.lit("browserconfig:tile")),
        ):
            out = out.unionByName(more)
        raw = F.trim("raw")
        made = F.when(F.col("section").isin(0, 3), F.col("raw")).when(raw.startswith("data:"), raw).otherwise(U.resolve(F.col("final_url"), raw))
        return out.withColumn("url", made).filter("url is not null").drop("raw")

    # Tables of numbers.

    def finish(self, known: DataFrame) -> "LinkIndex":
        """Makes the tables. `known(url, kind, state)` holds the rows that a crawl starts with."""
        cfg = self.cfg
        reasons = {"page": lambda u: policy.page_reason(u, cfg.scope), "asset": lambda u: policy.asset_reason(u, cfg.scope)}
        steps = politeness.redirect_steps(self.parts[0].select("url", F.col("http").alias("status"), "location"), reasons)
        ends = self._kept(politeness.redirect_ends(steps), "ends")
        links = self._kept(self._links(), "found")
        queued = known.filter("state = 'queued'").select("url", "kind")
        while not (more := self._unread(links.select("url", "kind").unionByName(queued).distinct(), ends)).isEmpty():
            self.parts.append(self._kept(self._parsed(self.responses.join(more, "url"), F.col("asked")), f"parsed-{len(self.parts)}"))
            links = self._kept(self._links(), f"found-{len(self.parts)}")
        asked = links.select("url", "kind").unionByName(queued).distinct()
        every = self.parts[0].select("url").unionByName(links.select("url")).unionByName(ends.select(F.col("final_url").alias("url"))).unionByName(known.select("url")).distinct()
        every = self._kept(every, "every")
        n = every.count()
        buckets = self.buckets = n_buckets(self.spark, n)
        numbers = rank(every, ["url"], "u", n).select("u", "url", U.url_pattern(F.col("url")).alias("pattern"))
        self.urls = bucketed(numbers, f"{self.root}/urls", "u", buckets)
        by_url = self.urls.select("u", "url")
        there = by_url.select(F.col("u").alias("src"), F.col("url").alias("src_url"))
        rows = links.withColumnRenamed("src", "src_url").join(there, "src_url").join(by_url, "url").select("src", "skind", "u", "kind", "section", "pos")
        self.links = bucketed(rows, f"{self.root}/links", "src", buckets)
        self.answers = bucketed(self._answers(asked.join(by_url, "url"), ends, by_url), f"{self.root}/answers", "u", buckets)
        return self

    def _ends(self, asked: DataFrame, ends: DataFrame) -> DataFrame:
        """Adds `final_url, denied, error` and what the last response says about itself."""
        ends = ends.withColumnsRenamed({"class": "_class", "at": "_at"})
        at = asked.join(ends, (F.col("url") == F.col("_at")) & (class_of(F.col("kind")) == F.col("_class")), "left").withColumn("final_url", F.coalesce("final_url", "url")).drop("_at", "_class", "hops")
        meta = self.parts[0].select(F.col("url").alias("_u"), "http", "ctype", "big", "fetched_at")
        out = at.join(meta, F.col("final_url") == F.col("_u"), "left")
        return out.withColumn("error", F.coalesce("error", F.when(F.col("_u").isNull(), "no response"))).drop("_u")

    def _unread(self, asked: DataFrame, ends: DataFrame) -> DataFrame:
        """`url, asked`: bodies that are asked for as kinds that they have not been read as."""
        wanted = self._ends(asked.filter("kind <> 'page'"), ends).filter((F.col("http") == 200) & ~F.col("big") & F.col("denied").isNull() & F.col("error").isNull())
        read = None
        for kind in KINDS[1:]:
            own = self._of(kind, F.col("url").alias("final_url"), F.lit(kind).alias("kind"))
            read = own if read is None else read.unionByName(own)
        left = wanted.select("final_url", "kind").distinct().join(read, ["final_url", "kind"], "left_anti")
        return left.groupBy(F.col("final_url").alias("url")).agg(F.collect_set("kind").alias("asked"))  # four kinds at most

    def _answers(self, asked: DataFrame, ends: DataFrame, by_url: DataFrame) -> DataFrame:
        cfg = self.cfg
        f = policy.with_robots(self._ends(asked, ends), "url", self.robots, self.with_robots, unknown=True)
        read = None
        for kind in KINDS:
            own = self._of(kind, F.col("url").alias("_u"), F.lit(kind).alias("_kind"), F.col(f"faults.{kind}").alias("unread"), "rendered")
            read = own if read is None else read.unionByName(own)
        f = f.join(read, (F.col("final_url") == F.col("_u")) & (F.col("kind") == F.col("_kind")), "left")
        f = f.join(by_url.select(F.col("u").alias("fu"), F.col("url").alias("final_url")), "final_url", "left")
        is_page, ok = F.col("kind") == "page", F.col("robots_ok")
        direct = is_page & ok & F.coalesce(F.col("ctype").startswith("image/"), F.lit(False))
        skip = F.when(~ok, "robots").when(F.col("denied").isNotNull(), F.col("denied")).when(~is_page & (F.col("http").isin(404, 410) | (F.col("error") == "no response")), "not_found")
        failure = (
            F.when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("http") != 200, F.concat(F.lit("HTTP "), F.col("http").cast("string")))
            .when(~direct & F.col("big"), "BodyTooLarge")
            .when(~direct, F.col("unread"))
        )
        f = f.withColumns({"skip_reason": skip, "direct": direct}).withColumn("error", F.when(F.col("skip_reason").isNull(), F.substring(failure, 1, 500)))
        good = F.col("skip_reason").isNull() & F.col("error").isNull()
        state = F.when(F.col("skip_reason").isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("done")
        f = f.withColumns({"state": state, "good": good, "moved": good & is_page & (F.col("final_url") != F.col("url")), "direct": good & F.col("direct")})
        f = f.withColumns({"status": F.col("http"), "content_type": F.when(ok, F.substring("ctype", 1, 100)), "rendered": good & F.coalesce("rendered", F.lit(False)) & ~F.col("direct"), "fetched_at": F.when(ok, F.col("fetched_at"))})
        return f.select("u", *_ANSWER)

    def close(self) -> None:
        undeclare(self.spark, *[f"{self.root}/{n}" for n in ("urls", "links", "answers")])
