"""Rules that rewrite resized images' URLs to the originals'.

Built-in rules look at the parts of a URL: what stands before its query, the folders and the name and extension of its
file, and the names in its query. Custom rules are a pattern and its replacement.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    match: str
    replace: str


#: Folders and hosts of public image services, their size names, and query parameters that ask for a size.
BLOG_FOLDER, CLOUD_FOLDER, SHOP_HOST = "/wp-content/uploads/", "/image/upload/", "cdn.shopify.com/"
SHOP_SIZES = "pico icon thumb small compact medium large grande".split()
SIZE_PARAMETERS = "w h width height resize fit size quality q crop".split()


def _digits(c: Column, empty: bool = False) -> Column:
    return (F.translate(c, "0123456789", "") == "") & (F.lit(empty) | (c != ""))


def _last(c: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the last `mark`, and behind it; both null where there is none."""
    end = F.substring_index(c, mark, -1)
    return F.when(c.contains(mark), F.left(c, F.length(c) - F.length(end) - F.lit(len(mark)))), F.when(c.contains(mark), end)


def _resized(url: Column, where: str, mark: str, size: Callable[[Column], Column]) -> Column:
    """The URL of a file below `where` without the size that follows the last `mark` of its name; null if it has none."""
    path = F.substring_index(url, "?", 1)
    query = F.substr(url, F.length(path) + 1)
    stem, extension = _last(path, ".")
    name, given = _last(stem, mark)
    # the size belongs to the file, and the folder stands before the name's mark
    fits = extension.rlike("^[A-Za-z0-9_]+$") & ~given.contains("/") & name.contains(where) & size(given)
    return F.when(fits, F.concat(name, F.lit("."), extension, query))


def _width_by_height(size: Column, one: bool = False) -> Column:
    """`300x200`; on request one of the numbers may be missing."""
    w, h = F.substring_index(size, "x", 1), F.substring_index(size, "x", -1)
    return (F.length(size) - F.length(F.replace(size, F.lit("x"), F.lit(""))) == 1) & _digits(w, one) & _digits(h, one) & (F.length(size) > 1)


def _shop_size(size: Column) -> Column:
    """A size name or `300x`, and what density is asked for (`@2x`)."""
    plain = F.substring_index(size, "@", 1)
    density = F.substr(size, F.length(plain) + 1)
    return (plain.isin(*SHOP_SIZES) | _width_by_height(plain, True)) & ((density == "") | ((F.length(density) == 3) & density.endswith("x") & _digits(F.substring(density, 2, 1))))


def _without_steps(url: Column) -> Column:
    """The URL without the transformations (`w_300,c_fill`) between the upload folder and the version (`v12`)."""
    rest = F.substring_index(url, CLOUD_FOLDER, -1)
    head = F.left(url, F.length(url) - F.length(rest))
    steps = F.split(rest, "/")
    version = F.array_position(F.transform(steps, lambda s: s.startswith("v") & _digits(F.substr(s, F.lit(2)))), True).cast("int")

    def step(s: Column) -> Column:
        name = F.substring_index(s, "_", 1)
        return s.contains("_") & F.length(name).between(1, 3) & (F.translate(name, "abcdefghijklmnopqrstuvwxyz", "") == "") & (F.length(s) > F.length(name) + 1)

    fits = url.contains(CLOUD_FOLDER) & (version > 1) & (F.size(steps) > version)
    before = F.slice(steps, 1, F.greatest(version - 1, F.lit(0)))
    after = F.slice(steps, F.greatest(version, F.lit(1)), F.size(steps))
    return F.when(fits, F.when(F.forall(before, step), F.concat(head, F.array_join(after, "/"))))


def _without_sizes(url: Column) -> Column:
    """The URL without its query, if that only asks for sizes."""
    path = F.substring_index(url, "?", 1)
    query = F.regexp_replace(F.substr(url, F.length(path) + 2), "&$", "")
    sized = F.forall(F.split(query, "&"), lambda p: p.contains("=") & F.substring_index(p, "=", 1).isin(*SIZE_PARAMETERS))
    return F.when((path != "") & (query != "") & sized, path)


BUILT_IN: dict[str, Callable[[Column], Column]] = {
    "cloudinary": _without_steps,
    "shopify-size-suffix": lambda url: _resized(url, SHOP_HOST, "_", _shop_size),
    "strip-size-params": _without_sizes,
    "wordpress-size-suffix": lambda url: _resized(url, BLOG_FOLDER, "-", _width_by_height),
}


def rules(names: Sequence[str] = (), custom: Sequence[Rule] = ()) -> list[str | Rule]:
    """Built-in rules by name (`all` for all of them), then custom ones."""
    names = sorted(BUILT_IN) if list(names) == ["all"] else list(names)
    if unknown := sorted(set(names) - set(BUILT_IN)):
        raise ValueError(f"unknown built-in rules {unknown}; there are {sorted(BUILT_IN)} and 'all'")
    for r in custom:
        re.compile(r.match)
    return names + list(custom)


def _rewritten(url: Column, rule: str | Rule) -> Column:
    if isinstance(rule, str):
        return BUILT_IN[rule](url)
    replacement = re.sub(r"\\(\d)", r"$\1", rule.replace.replace("$", r"\$"))
    return F.when(url.rlike(rule.match), F.regexp_replace(url, rule.match, replacement))


def variants(url: Column, active: Sequence[str | Rule]) -> Column:
    """An array of the rewritten URLs: each matching rule's, once each, in the order of the rules, without the URL itself."""
    if not active:
        return F.array().cast("array<string>")
    tries = [_rewritten(url, r) for r in active]
    return F.array_distinct(F.filter(F.array(*tries), lambda v: v.isNotNull() & (v != url)))
