"""Folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which goes when the driver ends; where that is unset on a single machine under a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pagelens-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder when the driver ends, if the session is still there."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended first
        pass


def kept(df: DataFrame, what: str) -> DataFrame:
    """The rows as files in shared storage: whatever reads them sees the same rows in the same places, also after executors are lost."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Schemes of Hadoop's connectors, and what Arrow calls the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "hdfs": "hdfs", "viewfs": "viewfs", "file": "file"}


def file_system(path: str):
    """Arrow's file system for a path of a Hadoop file system, and the path there: for tasks that write files themselves."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


#: Arrow's names of stores where a file is seen once it is closed, and where a rename is a copy.
OBJECT_STORES = {"s3", "gcs", "abfs"}


@contextmanager
def written(fs, path: str):
    """A stream to a file that is seen whole or not at all, and replaces what is there.

    Files and HDFS write under a hidden name and rename, in one step. Object stores show a file once it is closed, so it is
    written under its own name, without a rename; what an exception leaves there is deleted, and a killed task leaves nothing.
    """
    folder, _, base = path.rpartition("/")
    at = path if fs.type_name in OBJECT_STORES else f"{folder}/.{base}.{uuid.uuid4().hex}.part"
    out = fs.open_output_stream(at)
    try:
        yield out
        out.close()
    except BaseException:
        if not out.closed:
            out.close()
        fs.delete_file(at)
        raise
    if at != path:
        fs.move(at, path)


def put_once(fs, path: str, data: bytes) -> None:
    """Writes a file under a name that depends on its content; one that is there already stays."""
    from pyarrow.fs import FileType

    if fs.get_file_info(path).type == FileType.NotFound:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with written(fs, path) as f:
            f.write(data)


def spread(scan: DataFrame, *by: str) -> DataFrame:
    """The rows of a scanned table, dealt by `by` to all cores where the table lies in fewer files than there are cores
    and is small enough for two rounds of tasks; all other tables stay as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() > 2 * cores or len(scan.inputFiles()) >= cores:
        return scan
    return scan.repartition(cores, *by)
