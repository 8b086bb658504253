"""Request logs: bad-status streaks with slow-down and blocking, spacing of starts, retries and redirects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.operators.ordered import in_ranges
from pagelens.storage import kept

#: Statuses that count as a sign of overload, and those that are tried again.
BAD_STATUSES = (403, 429, 503)
RETRIED = (429, 500, 502, 503, 504)
REDIRECTS = (301, 302, 303, 307, 308)
MOST_HOPS = 10


def bad_streaks(log: DataFrame, host: str, order: list[str], bad: Column, interval: float, max_streak: int = 15, cap: float = 60.0) -> DataFrame:
    """Adds `streak` (bad requests in a row), `interval` (doubled at every third of a streak, up to `cap`, never lowered again) and `blocked` (some streak has reached `max_streak`).

    Rows are dealt by ranges of (host, order), so a hot host is split. A range hands on how many bad requests it ends with, and
    what it adds to the doublings and to the longest streak, which depends on the streak that it starts with.
    """
    dealt, w = in_ranges(log.withColumn("_bad", F.coalesce(bad, F.lit(False))), [host, *order])
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumns({"_n": F.row_number().over(w), "_good": F.max(F.when(~F.col("_bad"), F.row_number().over(w))).over(before)})
    # bad requests in a row inside of the range; those before its first good one go on with a streak from before
    dealt = kept(dealt.withColumn("_run", F.col("_n") - F.coalesce("_good", F.lit(0))), "runs")
    inside = dealt.groupBy("_range", host).agg(
        F.count("*").alias("n"), F.max_by("_run", "_n").alias("tail"), F.coalesce(F.min(F.when(~F.col("_bad"), F.col("_n"))) - 1, F.count("*")).alias("lead"),
        F.count(F.when(F.col("_bad") & F.col("_good").isNotNull() & (F.col("_run") % 3 == 0), 1)).alias("slows"), F.max(F.when(F.col("_bad") & F.col("_good").isNotNull(), F.col("_run"))).alias("longest"),
    )
    ranges = Window.partitionBy(host).orderBy("_range")  # a row for each range that a host is in
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum(F.when(F.col("lead") < F.col("n"), 1).otherwise(0)).over(earlier)
    chained = inside.withColumn("block", F.coalesce(whole, F.lit(0)))
    # the streak that a range starts with: the tail of the last range with a good request, and all ranges since
    since = Window.partitionBy(host, "block").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.lag(F.when(F.col("lead") < F.col("n"), F.col("tail"))).over(ranges)
    start = F.coalesce(F.sum("n").over(since), F.lit(0)) + F.coalesce(F.max("_last").over(Window.partitionBy(host, "block")), F.lit(0))
    chained = chained.withColumn("_last", last_tail).withColumn("_start0", start)
    thirds = lambda x: F.floor(x / 3)
    chained = chained.withColumns({
        "_slows": F.col("slows") + thirds(F.col("_start0") + F.col("lead")) - thirds(F.col("_start0")),
        "_longest": F.greatest(F.coalesce("longest", F.lit(0)), F.when(F.col("lead") > 0, F.col("_start0") + F.col("lead")).otherwise(0)),
    })
    handed = chained.select(F.col("_range").alias("_r"), F.col(host).alias("_host"), "_start0", F.coalesce(F.sum("_slows").over(earlier), F.lit(0)).alias("_slows0"), F.coalesce(F.max("_longest").over(earlier), F.lit(0)).alias("_longest0"))
    rows = dealt.join(handed, (F.col("_range") == F.col("_r")) & F.col(host).eqNullSafe(F.col("_host")))
    streak = F.when(F.col("_bad"), F.col("_run") + F.when(F.col("_good").isNull(), F.col("_start0")).otherwise(0)).otherwise(0)
    rows = rows.withColumn("streak", streak.cast("long"))
    slows = F.col("_slows0") + F.sum(F.when(F.col("_bad") & (F.col("streak") % 3 == 0), 1).otherwise(0)).over(before)
    longest = F.greatest(F.col("_longest0"), F.max("streak").over(before))
    return rows.select(
        *log.columns, "streak", F.least(F.lit(cap), F.lit(float(interval)) * F.pow(F.lit(2.0), F.least(slows, F.lit(60)))).alias("interval"), (longest >= max_streak).alias("blocked")
    )


def spaced(arrivals: DataFrame, host: str, at: str, order: list[str], interval: float) -> DataFrame:
    """Adds `start`: each request of a host starts at its arrival, but at least `interval` after the start before it.

    With k requests of the host before it, a request starts at k * interval plus the greatest slack (arrival - k * interval)
    so far; both the count and the maximum are carried over ranges of (host, order).
    """
    dealt, w = in_ranges(arrivals, [host, *order])
    dealt = dealt.withColumn("_k", F.row_number().over(w).cast("long") - 1)
    sizes = dealt.groupBy("_range", host).agg(F.count("*").alias("n"), F.max(F.col(at) - F.col("_k") * interval).alias("slack"))
    earlier = Window.partitionBy(host).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range that a host is in
    sizes = sizes.withColumn("_k0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    handed = sizes.withColumn("_slack0", F.max(F.col("slack") - F.col("_k0") * interval).over(earlier)).select(F.col("_range").alias("_r"), F.col(host).alias("_host"), "_k0", "_slack0")
    rows = dealt.join(handed, (F.col("_range") == F.col("_r")) & F.col(host).eqNullSafe(F.col("_host"))).withColumn("_k", F.col("_k") + F.col("_k0"))
    slack = F.greatest("_slack0", F.max(F.col(at) - F.col("_k") * interval).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select(*arrivals.columns, (slack + F.col("_k") * interval).alias("start"))


def numbered(log: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Adds `out`: how many rows of the same key stand before each, counted by ranges of (key, order)."""
    dealt, w = in_ranges(log, [key, *order])
    sizes = dealt.groupBy("_range", key).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    handed = sizes.select(F.col("_range").alias("_r"), F.col(key).alias("_key"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_k0"))
    rows = dealt.withColumn("_k", F.row_number().over(w).cast("long") - 1).join(handed, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    return rows.select(*log.columns, (F.col("_k") + F.col("_k0")).alias(out))


def final_attempts(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """For each URL of `attempts(url, attempt, status, ...)` the first answer that needs no retry, else the last one tried. A null status is a transport error."""
    tried = attempts.filter(F.col("attempt") <= retries)
    settled = F.col("status").isNotNull() & ~F.col("status").isin(*RETRIED)
    order = F.struct((~settled).cast("int"), F.when(settled, F.col("attempt")).otherwise(-F.col("attempt")))
    rest = [c for c in attempts.columns if c != "url"]
    best = tried.groupBy("url").agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select("url", *[F.col(f"_r.{c}").alias(c) for c in rest])


def redirect_steps(responses: DataFrame, reasons: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """`class, at, to, hops, why`: for every redirect of `responses(url, status, location)` and every class of scope check where it
    leads (`hops` 1), or that it leads nowhere because of `why` (`hops` 0)."""
    from pagelens.functions.url import resolve

    moved = responses.filter(F.col("status").isin(*REDIRECTS)).select(F.col("url").alias("at"), resolve(F.col("url"), F.col("location")).alias("next")).filter("next is not null")
    steps = None
    for name, reason in reasons.items():
        own = moved.select(F.lit(name).alias("class"), "at", "next", reason(F.col("next")).alias("why"))
        steps = own if steps is None else steps.unionByName(own)
    goes = F.col("why").isNull()
    return steps.select("class", "at", F.when(goes, F.col("next")).otherwise(F.col("at")).alias("to"), goes.cast("int").alias("hops"), "why")


def redirect_ends(steps: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """`class, at, final_url, hops, denied, error` of every redirect, by pointer doubling over the table of redirects alone.

    Steps of 1, 2, 4 ... hops are made by joining the table with itself, and those that make up `most` are put together, so a
    chain or a loop of any length takes log2(most) rounds and no row carries a chain. Where a hop is denied, it stands still.
    Joins deal both sides: the size of URLs is underrated before they are made and as files, so none is sent to all tasks.
    """
    steps = kept(steps, "redirects")
    if steps.isEmpty():
        none = F.lit(None).cast("string")
        return steps.select("class", "at", F.col("to").alias("final_url"), "hops", none.alias("denied"), none.alias("error"))

    def after(f: DataFrame, g: DataFrame) -> DataFrame:
        """The hops of f, then those of g."""
        g = g.select(F.col("class").alias("_class"), F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("hops").alias("_hops"))
        both = f.join(g.hint("merge"), (F.col("class") == F.col("_class")) & (F.col("to") == F.col("_at")), "left")
        return kept(both.select("class", "at", F.coalesce("_to", "to").alias("to"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops")), "hops")

    power, whole, left = steps.select("class", "at", "to", "hops"), None, most
    while left:
        if left & 1:
            whole = power if whole is None else after(whole, power)
        left >>= 1
        if left:
            power = after(power, power)
    if whole is None:
        whole = steps.select("class", "at", F.col("at").alias("to"), F.lit(0).alias("hops"))
    there = steps.select(F.col("class").alias("_class"), F.col("at").alias("_at"), "why", F.lit(True).alias("_more"))
    ends = whole.join(there.hint("merge"), (F.col("class") == F.col("_class")) & (F.col("to") == F.col("_at")), "left")
    return ends.select(
        "class", "at", F.col("to").alias("final_url"), "hops", F.concat("why", F.lit(":redirect")).alias("denied"), F.when(F.col("_more") & F.col("why").isNull(), "too many redirects").alias("error")
    )


def follow_redirects(wanted: DataFrame, responses: DataFrame, reasons: dict[str, Callable[[Column], Column]], by: Column | None = None, most: int = MOST_HOPS) -> DataFrame:
    """Where each `url` of `wanted` ends: adds `final_url, status, hops, denied, error`.

    `reasons` has a scope check of every hop for each class of rows, and `by` says which class a row is of; where there is but
    one, it may be left out.
    """
    ends = redirect_ends(redirect_steps(responses, reasons), most).withColumnsRenamed({"class": "_class", "at": "_from"})
    by = F.lit(next(iter(reasons))) if by is None else by
    at = wanted.withColumn("_by", by).join(ends.hint("merge"), (F.col("url") == F.col("_from")) & (F.col("_by") == F.col("_class")), "left")
    at = at.select(*wanted.columns, F.coalesce("final_url", "url").alias("final_url"), F.coalesce("hops", F.lit(0)).alias("hops"), "denied", "error")
    answers = responses.select(F.col("url").alias("_at"), F.col("status").cast("int").alias("status"))
    out = at.join(answers.hint("merge"), F.col("final_url") == F.col("_at"), "left").withColumn("error", F.coalesce("error", F.when(F.col("_at").isNull(), "no response")))
    return out.select(*wanted.columns, "final_url", "status", "hops", "denied", "error")


def failure_ratio(done: Column, failed: Column) -> Column:
    """Failed requests' share of all; above 0.2 a run ends with exit code 2."""
    return F.when(done + failed > 0, failed / (done + failed)).otherwise(F.lit(0.0))
