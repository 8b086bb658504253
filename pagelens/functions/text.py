"""Small text and number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(context: Column, most: int = 300) -> Column:
    """White space collapsed, trimmed, cut to `most` characters; empty becomes null."""
    out = F.substring(F.trim(F.regexp_replace(context, r"\s+", " ")), 1, most)
    return F.when(out != "", out)


def safe_segment(seg: Column) -> Column:
    """A path segment that every file system takes; `.`, `..` and nothing become empty."""
    s = F.replace(F.replace(seg, F.lit("\\"), F.lit("_")), F.lit("\x00"), F.lit(""))
    s = F.regexp_replace(s, r"""[<>:"|?*\p{Cntrl}\p{Cf}\p{Co}\p{Cn}\p{Zl}\p{Zp}]""", "_")
    s = F.regexp_replace(s, r"[\p{Zs}&&[^ ]]", "_")
    return F.when(seg.isin("", ".", ".."), "").otherwise(F.substring(s, 1, 150))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks to wait: a whole number, or an HTTP date against `now` (epoch seconds); at least 0."""
    v = F.trim(value)
    number = F.when(v.rlike(r"^[0-9]{1,9}$"), v.cast("double"))
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(v, r"^[A-Za-z]+, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))).cast("double") - now
    wait = F.coalesce(number, date)
    return F.when(wait.isNotNull(), F.greatest(F.lit(0.0), wait))


def backoff(attempt: Column, rand: Column, wait: Column | None = None) -> Column:
    """Seconds before the next attempt: doubling from 2 up to 30, jittered between half and full; a Retry-After of up to 300 goes first."""
    base = F.least(F.lit(30.0), 2 * F.pow(F.lit(2.0), attempt)) * (0.5 + rand / 2)
    return base if wait is None else F.coalesce(F.least(wait, F.lit(300.0)), base)


def jittered(interval: Column, jitter: float, rand: Column) -> Column:
    """An interval spread by up to `jitter` of itself to both sides."""
    return interval * (1 + jitter * (2 * rand - 1))


def size_literal(text: Column) -> Column:
    """Bytes of a size literal such as `2KB`, `1.5k` or `5GiB` (powers of 1024); null if it is none."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?\s*$"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    power = F.when(unit == "k", 1).when(unit == "m", 2).when(unit == "g", 3).when(unit == "t", 4).otherwise(0)
    return F.when(text.rlike(pattern), (F.regexp_extract(text, pattern, 1).cast("double") * F.pow(F.lit(1024.0), power)).cast("long"))


def summary(keys: Column, values: Column) -> Column:
    """`k: v, k: v` over a group, sorted by key."""
    pairs = F.array_sort(F.collect_list(F.struct(keys.alias("k"), values.alias("v"))))
    return F.array_join(F.transform(pairs, lambda p: F.concat(p.k, F.lit(": "), p.v.cast("string"))), ", ")
