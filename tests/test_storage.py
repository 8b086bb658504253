"""Files that tasks write themselves, links, and tables that grow by parts."""

import os

import pytest
from pyspark.sql import functions as F

from pagelens import export, state, storage


def test_files_are_written_once(tmp_path):
    fs, root = storage.file_system(f"file://{tmp_path}")
    storage.put_once(fs, f"{root}/a/b.png", b"first")
    storage.put_once(fs, f"{root}/a/b.png", b"second")
    assert (tmp_path / "a/b.png").read_bytes() == b"first" and os.listdir(tmp_path / "a") == ["b.png"]
    assert storage.file_system(str(tmp_path))[1] == str(tmp_path)


def test_mirror_links(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images/x.png").write_bytes(b"x")
    paths = spark.createDataFrame([("images/x.png", "e.com/a/x.png"), ("images/x.png", "e.com/y.png")], "path string, target string").coalesce(1)
    assert export.link_tree(paths, f"file://{tmp_path}") == 2 and export.link_tree(paths, f"file://{tmp_path}") == 0
    assert os.path.samefile(tmp_path / "friendly/e.com/y.png", tmp_path / "images/x.png")


def test_tables_grow_by_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "MOST_PARTS", 3)
    store = state.Store(spark, f"file://{tmp_path}/out")
    for i in range(5):
        store.commit({}, {"occurrence": spark.createDataFrame([(i, i, "k", "c")], "image_id long, page_id long, kind string, context string")})
        assert sorted(r.image_id for r in store.table("occurrence").collect()) == list(range(i + 1))
    assert len(store.meta()["tables"]["occurrence"]) == 2 and len([d for d in os.listdir(tmp_path / "out/_state") if d.startswith("gen-")]) == 2
    store.commit({"occurrence": store.table("occurrence").filter("image_id > 3")})
    assert store.table("occurrence").count() == 1 and len(store.meta()["tables"]["occurrence"]) == 1
    assert not [n for n in os.listdir(tmp_path / "out/_state") if n.endswith(".tmp")]


def test_shared_folders_are_never_made_up_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://a:7077"

    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(Session(), "x")
    assert storage.shared_folder(spark, "x") != storage.shared_folder(spark, "x")


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    df = spark.read.parquet(f"file://{tmp_path}/one")
    assert storage.spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and storage.spread(df, "id").count() == 100
    spark.range(100).repartition(40).write.parquet(f"file://{tmp_path}/many")
    many = spark.read.parquet(f"file://{tmp_path}/many")
    assert storage.spread(many, "id") is many and F is not None
