"""Candidates of `srcset` and `image-set()`, and the choice among them."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = re.compile(r"[\s,]*(\S+)")
_UNITS = re.compile(r"(?i)(.*?)(w|x|dpi)")


class Candidate(NamedTuple):
    url: str
    width: float = 0.0
    density: float = 1.0


def described(url: str, words: str) -> Candidate:
    """A candidate with its descriptors: `800w`, `2x`, `192dpi`; what is no number is ignored, so `2dppx` leaves 1x."""
    width, density = 0.0, 1.0
    for word in words.split():
        m = _UNITS.fullmatch(word)
        try:
            value = float(m[1]) if m else None
        except ValueError:
            continue
        if value is None:
            continue
        unit = m[2].lower()
        if unit == "w":
            width = value
        else:
            density = value if unit == "x" else value / 96
    return Candidate(url, width, density)


def comma(text: str, start: int = 0) -> int:
    """The place of the first comma outside parentheses, or the end."""
    depth = 0
    for i in range(start, len(text)):
        c = text[i]
        if c == "," and depth == 0:
            return i
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
    return len(text)


def candidates(value: str) -> list[Candidate]:
    """A URL runs to the next white space, so it may hold commas; one at its end closes the candidate."""
    out, at = [], 0
    while m := _URL.match(value, at):
        url, at = m[1], m.end()
        words = ""
        if url[-1] == ",":
            url = url.rstrip(",")
        else:
            end = comma(value, at)
            words, at = value[at:end], end
        if url:
            out.append(described(url, words))
    return out


def choose(found: list[Candidate], mode: str) -> list[str]:
    """`largest`: the first of greatest width, then density. `all`: every URL once, in order."""
    if mode == "all":
        return list(dict.fromkeys(c.url for c in found))
    return [max(found, key=lambda c: c[1:]).url] if found else []


def largest(value: Column) -> Column:
    """The largest candidate of a srcset whose URLs hold no comma next to white space, without leaving the JVM."""
    items = F.filter(F.transform(F.split(F.regexp_replace(value, r",(?=\s|$)|(?<=\s[0-9.]{1,12}[wx]),", "\u0001"), "\u0001"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")

    def rank(s: Column, i: Column) -> Column:
        word = F.lower(F.regexp_extract(s, r" ([0-9.]+[wWxX])$", 1))
        value = F.substring_index(F.substring_index(word, "w", 1), "x", 1).try_cast("double")
        width = F.when(word.endswith("w"), value)
        density = F.when(word.endswith("x"), value)
        return F.struct(F.coalesce(width, F.lit(0.0)).alias("w"), F.coalesce(density, F.lit(1.0)).alias("d"), (-i).alias("i"), F.substring_index(s, " ", 1).alias("u"))

    return F.array_max(F.transform(items, rank)).u
