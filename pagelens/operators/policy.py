"""What may be fetched: scope, globs, extensions, depth, robots, rendering. Each check gives a reason, or null if allowed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.config import ScopeConfig
from pagelens.extract import robots as rfc
from pagelens.functions import url as U
from pagelens.functions.glob import matches_any

#: Most hosts that a scope check spells out in the expression; longer lists are joined.
SPELLED_HOSTS = 1000


def host_in(host: Column, hosts: Sequence[str], subdomains: bool) -> Column:
    """Whether a host is one of `hosts`, or below one of them."""
    hosts = sorted(set(hosts))
    if not hosts:
        return F.lit(False)
    if len(hosts) > SPELLED_HOSTS:
        raise ValueError("join long host lists with join_hosts")
    inside = host.isin(hosts)
    for h in hosts if subdomains else ():
        inside = inside | host.endswith("." + h)
    return inside


def join_hosts(df: DataFrame, host: str, hosts: DataFrame, subdomains: bool, out: str = "in_scope") -> DataFrame:
    """Adds `out` by a table `hosts(host)` of any length: a host is looked up by itself and, on request, by all its parents."""
    known = hosts.select(F.lower("host").alias("_host")).distinct()
    labels = F.split("_h", r"\.")
    own = F.array("_h")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = df.select(F.col(host).alias("_h")).distinct().select("_h", F.explode((parents if subdomains else own).cast("array<string>")).alias("_host"))
    inside = names.join(known, "_host", "left_semi").select("_h").distinct().withColumn("_in", F.lit(True))
    return df.join(inside, F.col(host) == F.col("_h"), "left").withColumn(out, F.coalesce("_in", F.lit(False))).drop("_h", "_in")


def page_host(host: Column, scope: ScopeConfig) -> Column:
    return host_in(host, scope.pages.hosts, scope.pages.subdomains)


def image_host(host: Column, scope: ScopeConfig) -> Column:
    own = host_in(host, scope.images.hosts, scope.images.subdomains)
    return own | page_host(host, scope) if scope.images.also_page_hosts else own


def page_reason(url: Column, scope: ScopeConfig) -> Column:
    """`scope`, `scope:include`, `exclude` or null."""
    pq = U.path_and_query(url)
    out = F.when(~page_host(U.host_of(url), scope), "scope")
    if scope.pages.include:
        out = out.when(~matches_any(pq, scope.pages.include), "scope:include")
    return out.when(matches_any(pq, scope.pages.exclude), "exclude")


def image_reason(url: Column, scope: ScopeConfig) -> Column:
    return F.when(~image_host(U.host_of(url), scope), "scope")


def asset_reason(url: Column, scope: ScopeConfig) -> Column:
    """Style sheets and manifests may come from any page or image host."""
    host = U.host_of(url)
    return F.when(~(page_host(host, scope) | image_host(host, scope)), "scope")


def guarded(df: DataFrame, url: str, scope: ScopeConfig) -> DataFrame:
    """The same rows; a row whose host is outside every scope ends the query with an error."""
    bad = asset_reason(F.col(url), scope).isNotNull()
    return df.filter(F.when(bad, F.raise_error(F.concat(F.lit("out of scope: "), F.col(url)))).otherwise(F.lit(True)))


def enqueueable(url: Column, depth: Column, scope: ScopeConfig, max_depth: int) -> Column:
    """Whether a link becomes a page row at all."""
    return url.isNotNull() & ~U.looks_like_non_page(url) & (depth <= max_depth) & page_reason(url, scope).isNull()


def robots_table(files: DataFrame, agent: str) -> DataFrame:
    """`origin, rules, delay, sitemaps` from `files(origin, status, body)`: one row an origin."""
    rule = "struct<allow:boolean,pattern:string,length:int,prefix:string,plain:boolean>"

    def parse(batches):
        import pandas as pd

        for t in batches:
            got = [rfc.for_response(None if pd.isna(s) else int(s), b, agent) for s, b in zip(t.status, t.body)]
            yield pd.DataFrame({"origin": t.origin, "rules": [[r._asdict() for r in g.rules] for g in got], "delay": [g.delay for g in got], "sitemaps": [g.sitemaps for g in got]})

    return files.select("origin", F.col("status").cast("int"), F.col("body").cast("string")).mapInPandas(parse, f"origin string, rules array<{rule}>, delay double, sitemaps array<string>")


def with_robots(df: DataFrame, url: str, robots: DataFrame | None, respect: bool = True, unknown: bool = False) -> DataFrame:
    """Adds `robots_ok`. An origin without a robots row counts as unreachable, so that nothing is allowed there, unless `unknown` says otherwise."""
    if not respect or robots is None:
        return df.withColumn("robots_ok", F.lit(True))
    named = df.withColumns({"_o": U.origin_of(F.col(url)), "_path": U.path_and_query(F.col(url))})
    paths = named.select(F.col("_o").alias("origin"), F.col("_path").alias("path")).filter("origin is not null").distinct()
    known = paths.join(robots.select("origin").distinct(), "origin", "left_semi")
    found = known.join(rfc.verdicts(known, rfc.rule_index(robots)), ["origin", "path"], "left")
    found = found.select(F.col("origin").alias("_origin"), F.col("path").alias("_p"), (F.coalesce("allow", F.lit(True)) | (F.col("path") == "/robots.txt")).alias("_ok"))
    joined = named.join(found, (F.col("_o") == F.col("_origin")) & (F.col("_path") == F.col("_p")), "left")
    return joined.withColumn("robots_ok", F.coalesce("_ok", F.lit(unknown))).drop("_o", "_path", "_origin", "_p", "_ok")


def sitemap_urls(origins: DataFrame, robots: DataFrame, scope: ScopeConfig) -> DataFrame:
    """Sitemaps of each origin: those its robots.txt lists, else /sitemap.xml; page scope only."""
    r = robots.select("origin", "sitemaps")
    listed = F.when(F.size(F.coalesce("sitemaps", F.array().cast("array<string>"))) > 0, F.col("sitemaps")).otherwise(F.array(F.concat("origin", F.lit("/sitemap.xml"))))
    urls = origins.join(r, "origin", "left").select("origin", F.explode(listed).alias("raw")).select("origin", U.normalize(F.col("raw")).alias("url"))
    return urls.filter(F.col("url").isNotNull() & page_reason(F.col("url"), scope).isNull()).distinct()


def is_html(content_type: Column, body: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("html") | ((kind == "") & F.ltrim(F.make_valid_utf8(F.substring(body, 1, 256))).startswith("<"))


def render_wanted(url: Column, mount_nodes: Column, text_chars: Column, noscript_js: Column, n_images: Column, mode: str = "auto", patterns: Sequence[str] = ()) -> Column:
    """Whether a page should be taken from its rendered form: asked for, or a client-side page with little text, or one that asks for scripts and shows few images."""
    if mode in ("never", "always"):
        return F.lit(mode == "always")
    return matches_any(url, patterns) | ((F.size(mount_nodes) > 0) & (text_chars < 500)) | (noscript_js & (n_images < 3))


def archive_only(url: Column) -> Column:
    """Archived copies must stay on the archive's host."""
    return F.when(U.host_of(url) != "web.archive.org", "scope")
