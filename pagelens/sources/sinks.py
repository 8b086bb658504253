"""Files as sinks of Spark: `df.write.format("files")` and, through `write_document`, one file made by many tasks.

- `files`: rows of `path string, body binary`, each a file below the option `path`. Names depend on content alone, so an attempt
  that is repeated, or runs twice at a time, finds the same file there or writes it again, and none is ever seen half.
- `parts`: rows of `line string`, as one part for each task in the folder `path`. Every attempt writes under a name of its own;
  only what the committed attempts wrote stands in the index that the commit writes, and an abort takes all parts away.

Both go to any store that Arrow knows. What reaches the driver are counts, and names and sizes of parts, one for each task.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from pagelens.storage import file_system, put_once, written

_BLOCK = 4 << 20
INDEX = "_parts.json"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written."""

    partition: int
    name: str
    bytes: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        n = 0
        for batch in batches:
            for path, body in zip(batch.column("path"), batch.column("body")):
                data = body.as_py() or b""
                put_once(fs, f"{root}/{path.as_py()}", data)
                n += len(data)
        return Written(TaskContext.get().partitionId(), "", n)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        """Whole files under names of their content do no harm; `state.orphans` finds those that no table names."""


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator) -> Written:
        from pyspark import TaskContext

        fs, root = file_system(self.path)
        partition, n = TaskContext.get().partitionId(), 0
        name = f"{partition:08d}-{uuid.uuid4().hex}"
        with written(fs, f"{root}/{name}") as out:
            for batch in batches:
                for line in batch.column("line"):
                    data = (line.as_py() or "").encode() + b"\n"
                    out.write(data)
                    n += len(data)
        return Written(partition, name, n)

    def commit(self, messages: list) -> None:
        parts = sorted((m.partition, m.name, m.bytes) for m in messages if m is not None)
        fs, root = file_system(self.path)
        with written(fs, f"{root}/{INDEX}") as out:
            out.write(json.dumps([(name, size) for _, name, size in parts if size]).encode())

    def abort(self, messages: list) -> None:
        from pyarrow.fs import FileType

        fs, root = file_system(self.path)
        if fs.get_file_info(root).type == FileType.Directory:
            fs.delete_dir(root)


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, body binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("files that are there stay: use mode append")
        return FilesWriter(self.options["path"])


class PartsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "parts"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("parts go into a folder of their own: use mode append")
        return PartsWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSink)
    spark.dataSource.register(PartsSink)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes `files(path, body)` below `folder`."""
    register(files.sparkSession)
    files.select("path", "body").write.format("files").option("path", folder).mode("append").save()


def write_document(lines: DataFrame, path: str) -> int:
    """Writes the `line`s, in the order of the rows, as the one file `path`, each with a line feed behind it; gives its bytes.

    A null line is an empty one. Without rows the file is empty. What lies at `path` before is replaced once the new file is
    whole; a folder there goes first. Tasks write parts side by side. Where a store takes writes at a place of a file, tasks put
    the parts into one hidden file, each at its place, which then gets its name. Elsewhere one task copies the parts to the file,
    a block at a time, since such stores have no other way to one file that outlives the parts.
    """
    from pyarrow.fs import FileType

    spark = lines.sparkSession
    register(spark)
    folder, _, base = path.rpartition("/")
    parts = f"{folder}/.{base}.{uuid.uuid4().hex}"
    fs, root = file_system(parts)
    _, target = file_system(path)
    fs.create_dir(root, recursive=True)
    try:
        lines.select("line").write.format("parts").option("path", parts).mode("append").save()
        with fs.open_input_stream(f"{root}/{INDEX}") as f:
            index = json.loads(f.read())
        total = sum(size for _, size in index)
        if fs.get_file_info(target).type == FileType.Directory:
            fs.delete_dir(target)
        if fs.type_name == "local":
            _put_at_places(spark, index, parts, f"{root}/whole", total)
            os.replace(f"{root}/whole", target)
        else:
            _copied(spark, index, parts, path)
        if fs.get_file_info(target).size != total:
            raise OSError(f"{path} has not the {total} bytes of its parts")
    finally:
        if fs.get_file_info(root).type == FileType.Directory:
            fs.delete_dir(root)
    return total


def _put_at_places(spark: SparkSession, index: list, parts: str, whole: str, total: int) -> None:
    """Parts into one file, each from where those before it end. An attempt that is repeated writes the same bytes again."""
    with open(whole, "wb") as f:
        f.truncate(total)
    places, at = [], 0
    for name, size in index:
        places.append((name, at))
        at += size

    def put(batches):
        import pandas as pd

        fs, root = file_system(parts)
        for t in batches:
            for name, place in zip(t.name, t.place):
                with fs.open_input_stream(f"{root}/{name}") as src, open(whole, "r+b") as dst:
                    dst.seek(place)
                    while block := src.read(_BLOCK):
                        dst.write(block)
            yield pd.DataFrame({"n": [len(t)]})

    if places:
        spark.createDataFrame(places, "name string, place long").repartition(len(places), "place").mapInPandas(put, "n long").count()


def _copied(spark: SparkSession, index: list, parts: str, path: str) -> None:
    """Parts one after another into one file, by one task that holds a block of them."""

    def copy(batches):
        import pandas as pd

        fs, root = file_system(parts)
        _, target = file_system(path)
        for _ in batches:
            with written(fs, target) as out:
                for name, _ in index:
                    with fs.open_input_stream(f"{root}/{name}") as src:
                        while block := src.read(_BLOCK):
                            out.write(block)
            yield pd.DataFrame({"n": [len(index)]})

    spark.range(1, numPartitions=1).mapInPandas(copy, "n long").collect()
