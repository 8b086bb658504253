"""robots.txt by RFC 9309: rules of the most specific group, longest match, allow on ties."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    allow: bool
    pattern: str  # a regular expression, anchored at the start of path and query
    length: int
    prefix: str  # what stands before the first wildcard
    plain: bool  # whether the prefix is all there is


class Robots(NamedTuple):
    rules: list[Rule]
    delay: float | None
    sitemaps: list[str]


ALLOW_ALL = Robots([], None, [])
DENY_ALL = Robots([Rule(False, "^/", 1, "/", True)], None, [])


def path_regex(path: str) -> str:
    """`*` any run, `$` at the end the end; all else as it stands."""
    ends = path.endswith("$")
    body = "".join(".*" if c == "*" else c if c.isalnum() or c in "/_-~%=&" else "\\" + c for c in (path[:-1] if ends else path))
    return f"^{body}$" if ends else f"^{body}"


def _fields(text: str) -> Iterator[tuple[str, str]]:
    for line in text.lstrip("\ufeff").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        if colon:
            yield key.strip().lower(), value.strip()


def parse(text: str, agent: str) -> Robots:
    """What a robots.txt says to one agent. Groups that name the agent go before those for `*`; several groups add up."""
    groups: dict[str, tuple[list[Rule], list[float]]] = {}
    sitemaps: list[str] = []
    names: list[str] = []
    heading = False
    for key, value in _fields(text):
        if key == "sitemap":
            if value:
                sitemaps.append(value)
        elif key == "user-agent":
            names = [*names, value.lower()] if heading else [value.lower()]
            heading = True
            groups.setdefault(value.lower(), ([], []))
        elif key in ("allow", "disallow", "crawl-delay"):
            heading = False
            for n in names:
                if key == "crawl-delay":
                    if re.fullmatch(r"[0-9]+(?:\.[0-9]+)?", value):
                        groups[n][1].append(float(value))
                elif value:
                    path = quote(value, safe="/%*$?=&;:@!+,'()~")
                    prefix = path.partition("*")[0]
                    prefix = prefix[:-1] if prefix == path and path.endswith("$") else prefix
                    groups[n][0].append(Rule(key == "allow", path_regex(path), len(path), prefix, prefix == path))
    named = [n for n in groups if n != "*" and n and agent.lower().startswith(n)]
    own = [max(named, key=len)] if named else ["*"] if "*" in groups else []
    return Robots([r for n in own for r in groups[n][0]], next((d for n in own for d in groups[n][1]), None), sitemaps)


def for_response(status: int | None, body: str | None, agent: str) -> Robots:
    """200: as it says. Other 4xx: everything is allowed. No answer or any other status: nothing is."""
    if status == 200:
        return parse(body or "", agent)
    return ALLOW_ALL if status is not None and 400 <= status < 500 else DENY_ALL


def rule_index(robots: DataFrame) -> DataFrame:
    """`origin, prefix, allow, length, pattern` from `robots(origin, rules)`: a row for each rule, under what it has before its
    first wildcard; `pattern` is null where that decides."""
    rules = robots.select("origin", F.explode("rules").alias("r"))
    return rules.select("origin", "r.prefix", "r.allow", "r.length", F.when(~F.col("r.plain"), F.col("r.pattern")).alias("pattern")).distinct()


def verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """`origin, path, allow` for those of the distinct `paths(origin, path)` that some rule of a rule index matches.

    A path is looked up by its own prefixes, of just the lengths that its origin's rules have, so it meets only rules whose
    literal part it shares; wildcards are tried on those alone. The longest rule decides, and allow on ties.
    """
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    cut = paths.join(lengths, "origin").select("origin", "path", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))).alias("_n"))
    cut = cut.select("origin", "path", F.substring("path", F.lit(1), F.col("_n")).alias("prefix"))
    hits = cut.join(rules, ["origin", "prefix"]).filter(F.col("pattern").isNull() | F.rlike("path", F.coalesce("pattern", F.lit(""))))
    return hits.groupBy("origin", "path").agg(F.max(F.struct("length", "allow")).alias("_best")).select("origin", "path", F.col("_best.allow").alias("allow"))
