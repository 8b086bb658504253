import pandas as pd
from pyspark.sql import functions as F

from pagelens.config import ImageScope, PageScope, ScopeConfig
from pagelens.extract import robots
from pagelens.operators import ladder, ordered, policy, politeness

SCOPE = ScopeConfig(PageScope(["shop.example.org", "news.test"], False, ["/*"], ["/cart*", "/*/print"]), ImageScope(["img.pics.test"]))


def reasons(spark, urls, check):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return [r[0] for r in df.select(check(F.col("u"))).collect()]


def test_scope(spark):
    """Each check over a table of addresses of our own: (address, page, image)."""
    table = [
        ("https://shop.example.org/item/7", None, None), ("http://NEWS.test./today", None, None), ("https://shop.example.org/cart?id=4", "exclude", None), ("https://news.test/a/print", "exclude", None),
        ("https://m.news.test/", "scope", "scope"), ("https://img.pics.test/7.webp", "scope", None), ("https://img.pics.test.bad.test/7.webp", "scope", "scope"), ("https://badnews.test/", "scope", "scope"),
    ]
    urls = [u for u, _, _ in table]
    normal = [u.replace("NEWS.test.", "news.test") for u in urls]
    assert reasons(spark, normal, lambda u: policy.page_reason(u, SCOPE)) == [p for _, p, _ in table]
    assert reasons(spark, normal, lambda u: policy.image_reason(u, SCOPE)) == [i for _, _, i in table]
    below = ScopeConfig(PageScope(["news.test"], True), ImageScope(["img.pics.test"], False, False))
    assert reasons(spark, ["https://m.news.test/", "https://badnews.test/", "https://news.test/"], lambda u: policy.page_reason(u, below)) == [None, "scope", None]
    assert reasons(spark, ["https://news.test/1.png", "https://img.pics.test/1.png", "https://x.img.pics.test/1.png"], lambda u: policy.image_reason(u, below)) == ["scope", None, "scope"]
    hosts = spark.createDataFrame([("News.test",)], "host string")
    got = policy.join_hosts(spark.createDataFrame([(h,) for h in ("m.news.test", "news.test", "badnews.test", "test")], "h string"), "h", hosts, True).collect()
    assert {r.h: r.in_scope for r in got} == {"m.news.test": True, "news.test": True, "badnews.test": False, "test": False}


def test_robots_join(spark):
    files = spark.createDataFrame([("https://a.com", 200, "User-agent: *\nDisallow: /x\nAllow: /x/y$"), ("https://b.com", 404, None), ("https://c.com", 500, None)], "origin string, status int, body string")
    urls = ["https://a.com/x/1", "https://a.com/x/y", "https://a.com/", "https://b.com/x", "https://c.com/x", "https://c.com/robots.txt"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    table = policy.robots_table(files, "pagelens")
    assert {r.u: r.robots_ok for r in policy.with_robots(df, "u", table).collect()} == dict(zip(urls, [False, True, True, True, False, True]))
    assert all(r.robots_ok for r in policy.with_robots(df, "u", table, respect=False).collect())


def test_robots_index_equals_all_rules_tried(spark):
    """Random rules and paths: the index against every rule on every path, as regular expressions."""
    import random
    import re

    rng = random.Random(2)
    piece = lambda: "".join(rng.choice("ab/*$?%é") for _ in range(rng.randrange(1, 6)))
    body = "User-agent: *\n" + "".join(f"{rng.choice(('Allow', 'Disallow'))}: /{piece()}\n" for _ in range(400))
    paths = sorted({"/" + "".join(rng.choice("ab/$?") for _ in range(rng.randrange(0, 7))).rstrip("?") for _ in range(500)})
    rules = robots.parse(body, "x").rules
    want = {}
    for p in paths:
        hits = [(r.length, r.allow) for r in rules if re.search(r.pattern, p)]
        want[p] = max(hits)[1] if hits else True
    table = policy.robots_table(spark.createDataFrame([("https://a.test", 200, body)], "origin string, status int, body string"), "x")
    df = spark.createDataFrame([(p, f"https://a.test{p}") for p in paths], "p string, u string")
    assert {r.p: r.robots_ok for r in policy.with_robots(df, "u", table).collect()} == want


def test_redirects_by_doubling_equal_one_hop_at_a_time(spark):
    import random

    rng = random.Random(3)
    names = [f"https://a.test/{i}" for i in range(60)]
    to = {u: rng.choice([*names, "https://b.test/x"]) for u in names[:50]} | {f"https://a.test/c{i}": f"https://a.test/c{i + 1}" for i in range(14)}
    rows = [(u, 302, v) for u, v in to.items()] + [(u, 200, None) for u in names[50:]]
    responses = spark.createDataFrame(rows, "url string, status int, location string")
    denied = {"page": lambda v: v.startswith("https://b.") or v.endswith("7"), "asset": lambda v: v.endswith("c9")}
    reasons = {"page": lambda c: F.when(c.startswith("https://b.") | c.endswith("7"), "scope"), "asset": lambda c: F.when(c.endswith("c9"), "scope")}
    asked = [(u, k) for u in (*to, *names[50:], "https://a.test/none") for k in denied]
    got = {(r.url, r.k): (r.final_url, r.hops, r.denied, r.error) for r in politeness.follow_redirects(spark.createDataFrame(asked, "url string, k string"), responses, reasons, F.col("k")).collect()}
    answers = {u for u, _, _ in rows}
    for u, k in asked:
        at, hops, stop, error = u, 0, None, None
        while at in to:
            if denied[k](to[at]):
                stop = "scope:redirect"
                break
            if hops == 10:
                error = "too many redirects"
                break
            at, hops = to[at], hops + 1
        assert got[u, k] == (at, hops, stop, error or (None if at in answers else "no response"))


def test_redirects_send_no_table_to_all_tasks(spark):
    """Responses made of few rows look small to the optimizer, however many they are."""
    responses = spark.range(3).select(F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"), "id").select(
        F.format_string("https://e.com/%d/%d", "id", "i").alias("url"), F.when(F.col("i") < 5, 302).otherwise(200).alias("status"), F.when(F.col("i") < 5, F.format_string("https://e.com/%d/%d", "id", F.col("i") + 1)).alias("location")
    )
    wanted = spark.range(3).select(F.format_string("https://e.com/%d/0", "id").alias("url"))
    ends = politeness.follow_redirects(wanted, responses, {"page": lambda u: F.lit(None).cast("string")})
    assert "Broadcast" not in ends._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.final_url, r.hops, r.error) for r in ends.collect()) == [(f"https://e.com/{i}/5", 5, None) for i in range(3)]



def test_ranks_deal_rows_once(spark):
    """The rank of a row comes from its place in the sorted files: what it carries is not dealt again to be numbered."""
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), F.lit("x" * 50).alias("body"))
    df = df.withColumn("a", F.when(F.col("a") > 0, F.col("a")))
    got = ordered.rank(df, ["a"], "n")
    assert "body" not in "".join(s for s in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in s or "Aggregate" in s)
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and plan.count("hashpartitioning") == 1
    assert got.columns == ["a", "body", "n"] and sorted((r.a or 0, r.n) for r in got.collect()) == [(i, i + 1) for i in range(5000)]
    assert ordered.rank(df.limit(0), ["a"], "n").count() == 0


def test_spacing_and_streaks(spark):
    log = spark.createDataFrame([("h", i, 0.0, 429) for i in range(6)] + [("h", 6, 0.0, 200), ("h", 7, 0.0, 503)], "host string, seq int, at double, status int")
    got = sorted(politeness.bad_streaks(log, "host", ["seq"], F.col("status").isin(*politeness.BAD_STATUSES), 0.5, 6).collect(), key=lambda r: r.seq)
    assert [r.streak for r in got] == [1, 2, 3, 4, 5, 6, 0, 1] and got[5].interval == 2.0 == got[7].interval and got[5].blocked and not got[4].blocked
    starts = sorted(r.start for r in politeness.spaced(log.filter("seq < 3"), "host", "at", ["seq"], 0.5).collect())
    assert starts == [0.0, 0.5, 1.0]
    tries = spark.createDataFrame([("a", 0, 503), ("a", 1, 503), ("a", 2, 200), ("b", 0, None), ("b", 1, 500), ("c", 0, 404)], "url string, attempt int, status int")
    assert {r.url: (r.attempt, r.status) for r in politeness.final_attempts(tries).collect()} == {"a": (2, 200), "b": (1, 500), "c": (0, 404)}


def test_running_total_matches_a_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7 % 13).alias("x"))
    got = {r.id: r.b for r in ordered.running_total(df, ["id"], F.col("x"), "b").collect()}
    want = pd.Series([i * 7 % 13 for i in range(1000)]).cumsum().shift(fill_value=0)
    assert got == dict(enumerate(want))
    assert ordered.running_total(df.limit(0), ["id"], F.col("x"), "b").count() == 0
    assert sorted(r.n for r in ordered.rank(df, ["x", "id"], "n").collect()) == list(range(1, 1001))


def test_pattern_limit(spark):
    df = spark.createDataFrame([("p", i) for i in range(5)] + [("q", 0)], "pattern string, seq int")
    prior = spark.createDataFrame([("p", 1)], "pattern string, n long")
    got = {(r.pattern, r.seq): r.skip_reason for r in ladder.pattern_limited(df, prior, 3, ["seq"]).collect()}
    assert [got["p", i] for i in range(5)] == [None, None, "pattern_limit", "pattern_limit", "pattern_limit"] and got["q", 0] is None
    plan = ladder.pattern_limited(df, prior, 3, ["seq"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # a task sends on three rows of a pattern at most
    assert [r.seq for r in ladder.first_pages(df.filter("pattern = 'p'"), 2, ["seq"]).collect()] == [0, 1]
