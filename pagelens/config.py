"""Configuration: one table of all settings, and what reads, merges and checks values by it.

A setting has a dotted name, a default and a reader; the reader gives the value in its final form or says why it is none.
Sections (`limits`, `scope.pages`) become objects whose attributes are their settings.
"""

from __future__ import annotations

import copy
import dataclasses
import json
import math
import re
import tomllib
from collections.abc import Callable, Mapping
from pathlib import Path
from typing import Any, NamedTuple
from urllib.parse import urlsplit

from pagelens.extract.html import LAZY
from pagelens.extract.rewrite import BUILT_IN, Rule
from pagelens.functions.binary import FORMATS


class ConfigError(ValueError):
    pass


# Readers: each takes a raw value and gives the final one, or raises ValueError with what is wrong.


def _kind(types: type | tuple[type, ...], name: str) -> Callable[[Any], Any]:
    def read(v: Any) -> Any:
        if not isinstance(v, types) or (isinstance(v, bool) and types is not bool):
            raise ValueError(f"{v!r} is no {name}")
        return v

    return read


text, flag = _kind(str, "text"), _kind(bool, "true or false")


def within(read: Callable[[Any], Any], low: float = -math.inf, high: float = math.inf, open_ends: str = "") -> Callable[[Any], Any]:
    """Values from `low` to `high`; `open_ends` names the ends that do not count themselves: "l", "h" or "lh"."""

    def check(v: Any) -> Any:
        v = read(v)
        if v < low or v > high or (v == low and "l" in open_ends) or (v == high and "h" in open_ends):
            raise ValueError(f"{v!r} is out of range")
        return v

    return check


count = within(_kind(int, "whole number"), 0)
some = within(_kind(int, "whole number"), 1)
more_than_none = within(_kind((int, float), "number"), 0, open_ends="l")
share = within(_kind((int, float), "number"), 0, 1, open_ends="h")


def parse_size(v: Any) -> int:
    """Bytes of `2048`, `"2KB"`, `"1.5k"`, `"5GiB"`; units are powers of 1024."""
    if isinstance(v, int) and not isinstance(v, bool):
        return v
    unit = re.search("[A-Za-z]*$", v.strip())[0].lower() if isinstance(v, str) else None
    try:
        power = {"": 0, "b": 0} | {p + end: k + 1 for k, p in enumerate("kmgt") for end in ("", "b", "ib")}
        number = v.strip()[: len(v.strip()) - len(unit)].strip()
        if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", number):
            raise ValueError
        return int(float(number) * 1024 ** power[unit])
    except (TypeError, KeyError, ValueError, AttributeError):
        raise ConfigError(f"not a size: {v!r} (2048, '2KB', '5GiB')") from None


size = within(parse_size, 0)


def maybe(read: Callable[[Any], Any]) -> Callable[[Any], Any]:
    return lambda v: None if v is None else read(v)


def many(read: Callable[[Any], Any]) -> Callable[[Any], list]:
    def all_of(v: Any) -> list:
        if not isinstance(v, (list, tuple)):
            raise ValueError("a list is needed")
        return [read(x) for x in v]

    return all_of


def one_of(allowed, what: str = "value", alias: Mapping[str, str] | None = None) -> Callable[[Any], str]:
    def read(v: Any) -> str:
        name = (alias or {}).get(text(v).lower(), v.lower() if alias is not None else v)
        if name not in allowed:
            raise ValueError(f"unknown {what} {v!r}; known are {sorted(allowed)}")
        return name

    return read


def bare_host(v: Any) -> str:
    """A host name alone, in lower case and as it stands in URLs: without a port, a final dot, or letters outside of ASCII."""
    name, colon, _ = text(v).strip().lower().rstrip(".").partition(":")
    if colon and ":" in _:
        name = v.strip().lower()  # an IPv6 address
    if not name or "/" in name:
        raise ValueError(f"not a bare host name: {v!r}")
    return name if name.isascii() else name.encode("idna").decode()


def rule_names(v: Any) -> list[str]:
    return sorted(BUILT_IN) if v == ["all"] else many(one_of(BUILT_IN, "built-in upgrade rule"))(v)


def custom_rule(v: Any) -> Rule:
    try:
        rule = v if isinstance(v, Rule) else Rule(**v)
        re.compile(rule.match)
    except (TypeError, re.error) as e:
        raise ValueError(f"{v!r} is no rule: {e}") from e
    return rule


class Key(NamedTuple):
    name: str
    default: Any
    read: Callable[[Any], Any]


#: The settings with their defaults and bounds.
KEYS = (
    Key("seeds", [], many(text)),
    Key("out", None, maybe(text)),
    Key("engagement.id", "", text),
    Key("engagement.notes", "", text),
    Key("engagement.contact", "", text),
    Key("scope.pages.hosts", [], many(bare_host)),
    Key("scope.pages.subdomains", False, flag),
    Key("scope.pages.include", ["/*"], many(text)),
    Key("scope.pages.exclude", [], many(text)),
    Key("scope.images.hosts", [], many(bare_host)),
    Key("scope.images.subdomains", False, flag),
    Key("scope.images.also_page_hosts", True, flag),
    Key("limits.max_pages", 5000, count),
    Key("limits.max_depth", 10, count),
    Key("limits.max_pages_per_pattern", 200, some),
    Key("limits.max_file_bytes", 50 << 20, size),
    Key("limits.max_total_bytes", 5 << 30, size),
    Key("limits.max_page_bytes", 10 << 20, size),
    Key("filters.min_file_bytes", 2048, size),
    Key("filters.formats", sorted(FORMATS), many(one_of(FORMATS, "format", {"jpg": "jpeg"}))),
    Key("filters.srcset", "largest", one_of(("largest", "all"))),
    Key("filters.data_uris", True, flag),
    Key("concurrency.global", 8, some),
    Key("concurrency.per_host", 2, some),
    Key("rate.per_host", 1.0, more_than_none),
    Key("rate.jitter", 0.3, share),
    Key("http.timeout", 30.0, more_than_none),
    Key("http.retries", 3, count),
    Key("http.user_agent", "", text),
    Key("http.proxy", "", text),
    Key("http.strip_page_params", ["utm_*", "fbclid", "gclid", "mc_cid", "mc_eid"], many(text)),
    Key("http.max_bad_streak", 15, some),
    Key("robots", "respect", one_of(("respect", "ignore"))),
    Key("render.mode", "auto", one_of(("never", "auto", "always"))),
    Key("render.pages", 2, some),
    Key("render.max_scrolls", 20, count),
    Key("render.idle_timeout", 10.0, more_than_none),
    Key("render.patterns", [], many(text)),
    Key("render.scan_json", False, flag),
    Key("auth.cookies_file", None, maybe(text)),
    Key("auth.headers_env", "PAGELENS_HEADERS", text),
    Key("discovery.lazy_attrs", list(LAZY), many(text)),
    Key("discovery.sitemaps", True, flag),
    Key("discovery.css", True, flag),
    Key("discovery.jsonld", True, flag),
    Key("discovery.manifest", True, flag),
    Key("upgrade", [], rule_names),
    Key("upgrade_rules", [], many(custom_rule)),
    Key("wayback.mode", "live", one_of(("live", "archive"))),
    Key("wayback.limit", 10000, some),
    Key("wayback.rate", 0.5, more_than_none),
)
_BY_NAME = {k.name: k for k in KEYS}


def section(path: str, name: str) -> type:
    """A class for the settings below `path`, in the order of the table; sections inside of it are objects of their own."""
    start = f"{path}." if path else ""
    fields: dict[str, Callable[[], Any]] = {}
    for k in KEYS:
        if k.name.startswith(start):
            own, dot, _ = k.name.removeprefix(start).partition(".")
            fields.setdefault(own, _SECTIONS[start + own] if dot else lambda d=k.default: copy.deepcopy(d))
    attributes = [(f + "_" * (f in ("global",)), Any, dataclasses.field(default_factory=make)) for f, make in fields.items()]
    cls = dataclasses.make_dataclass(name, attributes, module=__name__)
    _SECTIONS[path] = cls
    return cls


_SECTIONS: dict[str, type] = {}
Engagement = section("engagement", "Engagement")
PageScope = section("scope.pages", "PageScope")
ImageScope = section("scope.images", "ImageScope")
ScopeConfig = section("scope", "ScopeConfig")
Limits = section("limits", "Limits")
Filters = section("filters", "Filters")
Concurrency = section("concurrency", "Concurrency")
Rate = section("rate", "Rate")
Http = section("http", "Http")
Render = section("render", "Render")
Auth = section("auth", "Auth")
Discovery = section("discovery", "Discovery")
Wayback = section("wayback", "Wayback")
Config = section("", "Config")


def value_of(cfg: Any, name: str) -> Any:
    for part in name.split("."):
        cfg = getattr(cfg, part if hasattr(cfg, part) else part + "_")
    return cfg


def dotted(values: Mapping[str, Any]) -> dict[str, Any]:
    """Nested tables, or dotted names, or both, as dotted names; a later name replaces an earlier one."""
    out: dict[str, Any] = {}
    for name, v in values.items():
        inside = isinstance(v, Mapping) and name not in _BY_NAME
        out |= {f"{name}.{k}": x for k, x in dotted(v).items()} if inside and v else {} if inside else {name: v}
    return out


def build(cls: type, values: Mapping[str, Any]) -> Any:
    """A configuration, or a section, from nested tables or dotted names. Every name must be known and every value pass its reader."""
    at = next(p for p, c in _SECTIONS.items() if c is cls)
    given = dotted(values)
    start = f"{at}." if at else ""
    if unknown := sorted(n for n in given if start + n not in _BY_NAME):
        raise ConfigError(f"unknown keys: {', '.join(start + n for n in unknown)}")
    out = cls()
    for name, raw in given.items():
        try:
            final = _BY_NAME[start + name].read(raw)
        except ValueError as e:
            raise ConfigError(f"{start}{name}: {e}") from e
        *path, last = name.split(".")
        holder = value_of(out, ".".join(path)) if path else out
        setattr(holder, last if hasattr(holder, last) else last + "_", final)
    return out


def settled(cfg: Any) -> Any:
    """The same configuration with its scope made definite: without page hosts it is the hosts of the seeds, all of which must lie inside."""
    hosts = {}
    for seed in cfg.seeds:
        at = urlsplit(seed)
        if at.scheme not in ("http", "https") or not at.hostname:
            raise ConfigError(f"a seed must be an absolute http(s) URL: {seed!r}")
        hosts[seed] = bare_host(at.hostname)
    pages = cfg.scope.pages
    pages.hosts = pages.hosts or sorted(set(hosts.values()))
    known = set(pages.hosts)
    for seed, host in hosts.items():
        above = {host.split(".", k)[-1] for k in range(host.count(".") + 1)} if pages.subdomains else {host}
        if known.isdisjoint(above):
            raise ConfigError(f"seed {seed!r} is outside scope.pages.hosts {pages.hosts}")
    return cfg


Config.settle = settled


def check_runnable(cfg: Any) -> None:
    if not cfg.out:
        raise ConfigError("an output folder is needed: out = ...")
    if not (cfg.seeds or cfg.scope.pages.hosts):
        raise ConfigError("no seeds and no scope")


def plain(cfg: Any) -> dict[str, Any]:
    """All settings by dotted name, as JSON can hold them."""
    return {k.name: [r._asdict() if isinstance(r, Rule) else r for r in v] if isinstance(v := value_of(cfg, k.name), list) else v for k in KEYS}


def identity(cfg: Any) -> str:
    """The settings that decide what a run is about; an output folder belongs to one of them."""
    return json.dumps({n: sorted(v) if n == "seeds" else v for n, v in plain(cfg).items() if n == "seeds" or n.startswith("scope.")}, sort_keys=True)


def load(path: str | Path | None = None, overrides: Mapping[str, Any] | None = None) -> Any:
    """A configuration from a TOML file, with overrides by dotted name (None leaves the file's value); a relative `out` is taken from the file's folder."""
    given: dict[str, Any] = {}
    if path is not None:
        try:
            given = dotted(tomllib.loads(Path(path).read_text()))
        except (OSError, tomllib.TOMLDecodeError) as e:
            raise ConfigError(f"{path}: {e}") from e
        if given.get("out"):
            given["out"] = str((Path(path).parent / given["out"]).resolve())
    given |= {n: str(v) if isinstance(v, Path) else v for n, v in (overrides or {}).items() if v is not None}
    return settled(build(Config, given))


STARTER = """\
seeds = ["https://www.example.com/"]
out = "collected"

[scope.pages]
hosts = ["www.example.com"]
exclude = ["/logout*", "/search*"]

[scope.images]
hosts = ["cdn.example.com"]

[limits]
max_pages = 5000
max_depth = 10
max_total_bytes = "5GB"

[filters]
min_file_bytes = "2KB"
srcset = "largest"
"""


def starter(path: str | Path) -> None:
    """Writes a first configuration; an existing file is never overwritten."""
    with open(path, "x") as f:
        f.write(STARTER)
