"""Files as sinks: one whole copy whatever happens to the tasks that write it."""

import csv
import json
import os

import pytest
from pyspark.sql import functions as F

from pagelens import export, storage
from pagelens.sources import sinks


def lines(spark, n: int, parts: int):
    return spark.range(0, n, 1, parts).select(F.concat(F.lit("line ü "), F.col("id").cast("string")).alias("line"))


@pytest.mark.parametrize("local", [True, False])
def test_one_file_from_many_tasks(spark, tmp_path, monkeypatch, local):
    if not local:  # the way of stores where no task can write at a place
        monkeypatch.setattr(sinks, "_put_at_places", lambda spark, index, parts, whole, total: sinks._copied(spark, index, parts, whole))
    path = f"file://{tmp_path}/doc.txt"
    (tmp_path / "doc.txt").mkdir()  # a folder that an earlier export left
    size = sinks.write_document(lines(spark, 5000, 7), path)
    assert (tmp_path / "doc.txt").read_text() == "".join(f"line ü {i}\n" for i in range(5000)) and size == (tmp_path / "doc.txt").stat().st_size
    assert sinks.write_document(lines(spark, 3, 3), path) == 3 * len("line ü 0\n".encode()) and (tmp_path / "doc.txt").read_text().count("\n") == 3
    assert sinks.write_document(lines(spark, 0, 2), path) == 0 and (tmp_path / "doc.txt").read_bytes() == b""
    assert os.listdir(tmp_path) == ["doc.txt"]


def test_null_lines_and_blank_texts(spark, tmp_path):
    rows = spark.createDataFrame([(None,), ("",), ("a" * 100_000,)], "line string").coalesce(1)
    sinks.write_document(rows, f"file://{tmp_path}/x")
    assert (tmp_path / "x").read_text().split("\n") == ["", "", "a" * 100_000, ""]


def test_parts_of_attempts_that_lost_are_left_out(spark, tmp_path):
    """Two attempts of a task wrote, one of them half: the commit names one, and only that gets into the file."""
    sinks.register(spark)
    parts = f"file://{tmp_path}/parts"
    os.mkdir(tmp_path / "parts")
    for name in ("00000000-killed", ".00000001-half.part"):
        (tmp_path / "parts" / name).write_text("line of another attempt\n")
    lines(spark, 10, 2).write.format("parts").option("path", parts).mode("append").save()
    index = json.loads((tmp_path / "parts" / sinks.INDEX).read_text())
    assert len(index) == 2 and not {"00000000-killed", ".00000001-half.part"} & {n for n, _ in index}
    sinks._copied(spark, index, parts, f"file://{tmp_path}/whole")
    assert (tmp_path / "whole").read_text() == "".join(f"line ü {i}\n" for i in range(10))


def test_a_failed_job_leaves_the_old_file(spark, tmp_path):
    path = f"file://{tmp_path}/doc"
    sinks.write_document(lines(spark, 4, 2), path)
    bad = lines(spark, 100, 4).withColumn("line", F.when(F.col("line") == "line ü 99", F.raise_error(F.lit("stop"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_document(bad, path)
    assert (tmp_path / "doc").read_text().count("\n") == 4 and os.listdir(tmp_path) == ["doc"]


def test_places_may_be_written_twice(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a").write_text("one\n")
    (tmp_path / "p/b").write_text("three\n")
    index = [("a", 4), ("b", 6)]
    for _ in range(2):
        sinks._put_at_places(spark, index, f"file://{tmp_path}/p", f"{tmp_path}/w", 10)
        assert (tmp_path / "w").read_text() == "one\nthree\n"


@pytest.mark.parametrize("stores", [set(), {"local"}])
def test_a_broken_stream_leaves_nothing(tmp_path, monkeypatch, stores):
    monkeypatch.setattr(storage, "OBJECT_STORES", stores)
    fs, root = storage.file_system(f"file://{tmp_path}")
    with pytest.raises(KeyError):
        with storage.written(fs, f"{root}/x") as out:
            out.write(b"half")
            raise KeyError
    assert os.listdir(tmp_path) == []
    with storage.written(fs, f"{root}/x") as out:
        out.write(b"whole")
    assert (tmp_path / "x").read_bytes() == b"whole" and os.listdir(tmp_path) == ["x"]


def test_files_by_their_content(spark, tmp_path):
    rows = spark.createDataFrame([("a/1", bytearray(b"x")), ("a/1", bytearray(b"x")), ("b/2", None), ("b/3", bytearray(b"y" * 9))], "path string, body binary")
    for _ in range(2):
        sinks.write_files(rows.repartition(4), f"file://{tmp_path}")
    got = {f"{d.name}/{f.name}": f.read_bytes() for d in tmp_path.iterdir() for f in d.iterdir()}
    assert got == {"a/1": b"x", "b/2": b"", "b/3": b"y" * 9}
    with pytest.raises(Exception, match="append"):
        rows.write.format("files").option("path", f"file://{tmp_path}").mode("overwrite").save()


def test_lines_of_csv_hold_what_needs_quotes(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "a,b"', None), (1, "two\nlines", ""), (None, "x", "y")], "image_id long, image_url string, state string")
    for c in ("skip_reason", "error", "sha256", "file", "status", "source"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    sinks.write_document(export.audit_lines(rows), f"file://{tmp_path}/u.csv")
    got = list(csv.reader(open(tmp_path / "u.csv", newline="")))
    assert got[0] == export.URL_COLUMNS and [r[:2] for r in got[1:]] == [["x", "y"], ["two\nlines", ""], ['say "a,b"', ""]]


def _tables(spark):
    page = spark.createDataFrame([(1, "https://e.com/1"), (2, "https://e.com/2")], "page_id long, url string")
    image = spark.createDataFrame(
        [(1, "https://e.com/a.png", "done", "x"), (2, "https://e.com/b.png", "done", "x"), (3, "https://e.com/c.png", "done", "y"), (4, "https://e.com/d.png", "failed", None)], "image_id long, url string, state string, sha256 string"
    ).selectExpr("*", "cast(null as string) final_url", "'n' url_filename", "200 status", "'image/png' content_type", "cast(null as timestamp) fetched_at")
    file = spark.createDataFrame([("x", "images/x.png", 5, "png"), ("y", "images/y.png", 6, "png")], "sha256 string, path string, bytes long, format string")
    occurrence = spark.createDataFrame([(1, 2, "html:img@src", "c"), (1, 1, "html:img@src", "c"), (1, None, "list", ""), (2, 9, "html:a@href", "c"), (4, 1, "html:img@src", "c")], "image_id long, page_id long, kind string, context string")
    return page, image, file, occurrence


def test_pages_are_looked_up_before_references_meet_images(spark):
    """What is dealt by pages has no columns of images, and references are gathered by image, as `nested` has them."""
    t = _tables(spark)
    rows = export.manifest(*t)
    joins = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2 and "image_id" in joins[0] and "page_id" in joins[1]
    by_file = lambda df: sorted(df.collect(), key=lambda r: r.file)
    got = by_file(export.nested_tables(*t))
    assert got == by_file(export.nested(rows)) and [[len(u.referenced_by) for u in r.urls] for r in got] == [[3, 1], [0]]


def test_lines_of_a_file_are_numbered_where_they_lie(spark, monkeypatch):
    """Their places in the file come from counts of its blocks: the lines are neither dealt nor written again."""
    from pagelens.operators import ordered
    from pagelens.plans import queries

    def never(*_):
        raise AssertionError("lines are written again")

    monkeypatch.setattr(ordered, "kept", never)
    for most in ("128m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            back = queries._written_lines(spark.range(500, numPartitions=3).select(F.concat(F.lit("line "), "id").alias("line")), "x.txt")
            assert sorted(map(tuple, back.collect())) == [(i + 1, f"line {i}") for i in range(500)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sorted_lines_carry_no_text_twice(spark):
    """Lines are made after the rows have been put in order."""
    plan = export.manifest_lines(export.manifest(*_tables(spark)))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_csv" in plan and plan.index("to_csv") < plan.index("Sort [")
