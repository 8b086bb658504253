"""Tables in buckets, and the crawl's use of them: bodies read once, writes that follow the round."""

import pyarrow as pa
from pyspark.sql import functions as F

from pagelens.changes import Changes, beside, bucketed, n_buckets, undeclare
from pagelens.config import Config, build
from pagelens.extract import html
from pagelens.plans import crawl
from pagelens.plans.linkindex import LinkIndex
from pagelens.schema import RESPONSE


def test_changes_merge_on_read(spark, tmp_path):
    c = Changes(spark, f"file://{tmp_path}/c'1", "name string, n int", "state string, note string", 4)
    born = spark.createDataFrame([(i, f"r{i}", i, "queued", None) for i in range(100)], "u long, name string, n int, state string, note string")
    c.append(born, 0, born=True)
    c.append(spark.createDataFrame([(i, "done", "x") for i in range(0, 100, 2)], "u long, state string, note string"), 1, born=False)
    c.append(spark.createDataFrame([(500, "new", 7, "queued", None)], born.schema), 1, born=True)
    c.append(spark.createDataFrame([(0, "failed", None)], "u long, state string, note string"), 2, born=False)
    want = {i: (f"r{i}", i, "done" if i % 2 == 0 else "queued", "x" if i % 2 == 0 else None) for i in range(100)}
    at = lambda gen, t=c: {r.u: (r["name"], r.n, r.state, r.note) for r in t.current(gen).collect()}
    assert at(0) == {i: (f"r{i}", i, "queued", None) for i in range(100)}
    assert at(1) == want | {500: ("new", 7, "queued", None)}
    assert at(2) == want | {500: ("new", 7, "queued", None), 0: ("r0", 0, "failed", None)}
    assert sorted(r.u for r in c.keys(1).collect()) == [*range(100), 500] and c.keys(0).count() == 100
    asked = spark.createDataFrame([(1,), (500,), (501,), (99,), (100,)], "u long")
    assert sorted(r.u for r in c.unseen(asked, 1).collect()) == [100, 501] and sorted(r.u for r in c.unseen(asked, 0).collect()) == [100, 500, 501]
    again = Changes(spark, f"file://{tmp_path}/c'1", "name string, n int", "state string, note string", 4)  # as a later run finds it
    small = c.compact(f"file://{tmp_path}/c2", 2)
    assert at(2, again) == at(2) == at(2, small)
    undeclare(spark, c.path, small.path)


def test_what_meets_a_table_is_dealt_and_the_table_is_not(spark, tmp_path):
    c = Changes(spark, f"file://{tmp_path}/c", "name string", "state string", 4)
    c.append(spark.range(1000).select(F.col("id").alias("u"), F.lit("a").alias("name"), F.lit("b").alias("state")), 0, born=True)
    links = bucketed(spark.range(1000).select((F.col("id") % 97).alias("src"), "id"), f"file://{tmp_path}/l", "src", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = spark.range(900, 1100).select(F.col("id").alias("u"))
        for df, rows in ((fresh.join(c.keys(0), "u", "left_anti"), 100), (links.join(fresh.select((F.col("u") % 97).alias("src")), "src"), None), (c.current(0), 1000)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == (0 if df is not fresh and "max_by" in plan else 1) and "Bucketed: true" in plan
            assert rows is None or df.count() == rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = c.unseen(fresh, 0)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and plan.count("Bucketed: true") == 1 and c.unseen(fresh, 0).count() == 100
    undeclare(spark, c.path, f"file://{tmp_path}/l")


def test_a_crawl_reads_each_body_once_and_writes_what_is_new(spark, tmp_path):
    """A chain of pages, one a round, with a redirect in it: every response passes the reader once, and a round's files have its rows."""
    n = 5
    rows = [(f"https://a.test/{i}", 200, None, "text/html", f'<a href="/{i + 1}">x</a><a href="/0">x</a>'.encode()) for i in range(n) if i != 2] + [("https://a.test/2", 302, "/two", None, b""), ("https://a.test/two", 200, None, "text/html", b'<a href="3">x</a>')]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield pa.RecordBatch.from_arrays(b.columns, b.schema.names)

    columns = [f.split()[0] for f in RESPONSE.split(", ")]
    have = {"url": 0, "status": 1, "location": 2, "content_type": 3, "body": 4}
    df = spark.createDataFrame([tuple(r[have[c]] if c in have else None for c in columns) for r in rows], RESPONSE)
    cfg = build(Config, {"seeds": ["https://a.test/0"], "out": f"file://{tmp_path}/o", "discovery": {"sitemaps": False}, "render": {"mode": "never"}, "limits": {"max_depth": 20}}).settle()
    c = crawl.Crawl(spark, df.mapInArrow(counted, df.schema), cfg)
    c.store.open(cfg)
    sizes = []
    keep = crawl.Changes.append
    crawl.Changes.append = lambda self, d, gen, born: (sizes.append((gen, born, d.count())), keep(self, d, gen, born))[1]
    try:
        assert c.run() == "finished"
    finally:
        crawl.Changes.append = keep
    assert read.value == len(rows)
    assert sorted((r.url, r.state, r.skip_reason) for r in c.store.table("page").collect()) == sorted(
        [(f"https://a.test/{i}", "done", None) for i in range(n)] + [("https://a.test/two", "skipped", "duplicate:redirect"), (f"https://a.test/{n}", "failed", None)]
    )
    assert all(rows <= 2 for _, _, rows in sizes) and len({g for g, _, _ in sizes}) == n + 2
    assert [p.name for p in (tmp_path / "o/_state").iterdir() if p.name.startswith("run-")] == []


def test_buckets_follow_the_rows(spark):
    """A small crawl has a bucket for each core, however many shuffle partitions there are, and a large one has more than those."""
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert n_buckets(spark) == 200 and n_buckets(spark, 0) == n_buckets(spark, 50_000) == cores
        assert n_buckets(spark, 2_500_000) == 50 and n_buckets(spark, 20_000_001) == 401
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_is_asked_by_number_and_kind_leaves_the_buckets_where_they_are(spark, tmp_path):
    """Fewer buckets than shuffle partitions, and a kind beside the number: the table is neither dealt nor sent to all tasks."""
    links = bucketed(spark.range(600).select((F.col("id") % 100).alias("src"), F.when(F.col("id") % 3 == 0, "css").otherwise("page").alias("skind"), "id"), f"file://{tmp_path}/l", "src", 3)
    asked = spark.range(50).select(F.col("id").alias("fu"), F.lit("css").alias("k"))
    found = beside(asked, "fu", 3).join(links, (F.col("fu") == F.col("src")) & F.col("k").between(F.col("skind"), F.col("skind")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "ShuffledHashJoin" in plan
    assert sorted(r.id for r in found.collect()) == [i for i in range(600) if i % 100 < 50 and i % 3 == 0]
    undeclare(spark, f"file://{tmp_path}/l")


def test_bodies_are_dealt_before_they_are_read(spark, tmp_path):
    """All pages lie in one file: they are read in several tasks nonetheless, and bodies of images stay behind."""
    page, image = F.format_string("https://a.test/%d", "id"), F.format_string("https://a.test/%d.png", "id")
    pages = spark.range(400).select(page.alias("url"), F.lit("text/html").alias("content_type"), F.format_string('<a href="/%d">x</a>', F.col("id") + 1).cast("binary").alias("body"))
    images = spark.range(400).select(image.alias("url"), F.lit("image/png").alias("content_type"), F.repeat(F.lit("x"), 5000).cast("binary").alias("body"))
    rows = pages.unionByName(images).withColumn("status", F.lit(200))
    schema = spark.createDataFrame([], RESPONSE).schema
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).coalesce(1).write.parquet(f"file://{tmp_path}/s")
    cfg = build(Config, {"seeds": ["https://a.test/0"], "out": f"file://{tmp_path}/o", "render": {"mode": "never"}}).settle()
    index = LinkIndex(spark, f"file://{tmp_path}/run", cfg, html.Options())
    parsed = index._parsed(spark.read.schema(schema).parquet(f"file://{tmp_path}/s"))
    own = parsed.withColumn("part", F.spark_partition_id()).filter("is_page").groupBy("part").count().collect()
    assert len(own) == 4 and sum(r["count"] for r in own) == 400 and max(r["count"] for r in own) < 200
    assert parsed.filter("is_page").selectExpr("min(size(html.links))").first()[0] == 1 and parsed.filter("not is_page").count() == 400
