"""URL lists and archive indexes as data sources of Spark: `spark.read.format("urls")`, `format("cdx")`, and the same as streams.

Both are files of lines. They are read in ranges of bytes: a range has the lines that begin in it, so a large file is read by
many tasks and no task holds more than a block of it. As streams, files may grow and new ones may come: an offset says how far
each file has been read, and a micro-batch has the whole lines behind it.

- `urls`: `url`; blank lines and lines with `#` in front are none.
- `cdx`: `pos, original, timestamp, mimetype` of a JSON array of arrays with a row on each line, the first of which names the
  columns, as index servers send it. `pos` is where a line begins. Filters on these columns are applied to the rows as they are
  read. What is no row of strings is passed over.

Options: `path`, a file or a folder on any store that Arrow knows, and `bytes` of a range (default 32 MiB).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from pagelens.storage import file_system

_BLOCK = 1 << 20
_CHECKS = {
    EqualTo: lambda f, v: v == f.value, In: lambda f, v: v in f.value, StringStartsWith: lambda f, v: v is not None and v.startswith(f.value),
    StringEndsWith: lambda f, v: v is not None and v.endswith(f.value), StringContains: lambda f, v: v is not None and f.value in v,
}


class Range(NamedTuple):
    path: str
    start: int
    stop: int
    head: bytes


class RangePartition(InputPartition):
    def __init__(self, range_: Range):
        super().__init__(tuple(range_))


class _Files:
    """The files below a path, and their lines."""

    def __init__(self, path: str):
        self.fs, self.root = file_system(path)

    def sizes(self) -> dict[str, int]:
        from pyarrow.fs import FileSelector, FileType

        info = self.fs.get_file_info(self.root)
        found = [info] if info.type == FileType.File else self.fs.get_file_info(FileSelector(self.root, recursive=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == FileType.File and f.base_name[0] not in "._"}

    def first_line(self, path: str) -> bytes:
        with self.fs.open_input_file(path) as f:
            out = b""
            while b"\n" not in out and (more := f.read(1 << 16)):
                out += more
        return out.partition(b"\n")[0]

    def whole(self, path: str, start: int, size: int) -> int:
        """The end of the last line that ends at or before `size`, not before `start`."""
        with self.fs.open_input_file(path) as f:
            at = size
            while at > start:
                a = max(start, at - (1 << 16))
                f.seek(a)
                last = f.read(at - a).rfind(b"\n")
                if last >= 0:
                    return a + last + 1
                at = a
        return start

    def lines(self, path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in the range; the last of them may end behind it."""
        with self.fs.open_input_file(path) as f:
            at, rest = max(0, start - 1), b""
            f.seek(at)
            skipping = start > 0  # what ends at the byte before the range is of an earlier one
            while block := f.read(_BLOCK):
                parts = (rest + block).split(b"\n")
                rest = parts.pop()
                for line in parts:
                    if not skipping:
                        yield at, line
                    at, skipping = at + len(line) + 1, False
                    if at >= stop:
                        return
            if rest and not skipping and at < stop:
                yield at, rest


class _Reader:
    """What readers of both sources share: ranges of files, and rows of their lines."""

    def __init__(self, source: LineSource):
        self.path, self.headed, self.columns = source.options["path"], source.headed, source.columns
        self.most = int(source.options.get("bytes", 32 << 20))
        self.wanted: list = []

    def ranges(self, files: dict[str, tuple[int, int]]) -> list[RangePartition]:
        own = _Files(self.path)
        out = []
        for path, (start, stop) in files.items():
            head = own.first_line(path) if self.headed and start < stop else b""
            out += [RangePartition(Range(path, a, min(a + self.most, stop), head)) for a in range(start, stop, self.most)]
        return out or [RangePartition(Range("", 0, 0, b""))]

    def read(self, partition: RangePartition) -> Iterator[tuple]:
        path, start, stop, head = partition.value
        if path:
            yield from self.rows(_Files(self.path).lines(path, start, stop), head)

    def rows(self, lines: Iterator[tuple[int, bytes]], head: bytes) -> Iterator[tuple]:
        if not self.headed:
            for _, line in lines:
                url = line.decode("utf-8", "replace").strip()
                if url and url[0] != "#":
                    yield (url,)
            return
        names = _row(head) or []
        at = [names.index(c) if c in names else None for c in self.columns]
        checks = [(at[self.columns.index(f.attribute[0])], f) for f in self.wanted]
        for place, line in lines:
            row = _row(line)
            if row is None or (place == 0 and row == names):
                continue
            value = lambda k: row[k] if k is not None and k < len(row) else None  # noqa: E731, B023
            if all(_CHECKS[type(f)](f, value(k)) for k, f in checks):
                yield (place, *map(value, at))


def _row(line: bytes) -> list | None:
    """A row of the array, with the brackets and commas of the array itself left out."""
    text = line.strip().rstrip(b",").strip()
    if text.startswith(b"[["):
        text = text[1:]
    if text.endswith(b"]]"):
        text = text[:-1]
    try:
        row = json.loads(text)
    except ValueError:
        return None
    return row if isinstance(row, list) and row and all(x is None or isinstance(x, str) for x in row) else None


class LineReader(_Reader, DataSourceReader):
    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if self.headed and type(f) in _CHECKS and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self) -> list[RangePartition]:
        return self.ranges({p: (0, n) for p, n in _Files(self.path).sizes().items()})


class LineStream(_Reader, DataSourceStreamReader):
    """Offsets are `{file: bytes}`."""

    def __init__(self, source: LineSource):
        super().__init__(source)
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        own = _Files(self.path)
        for path, size in own.sizes().items():
            done = self.known.get(path, 0)
            if size > done:
                self.known[path] = own.whole(path, done, size)
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[RangePartition]:
        return self.ranges({p: (start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)})


class LineSource(DataSource):
    headed = False
    columns = ("url",)

    @classmethod
    def name(cls) -> str:
        return "urls"

    def schema(self) -> str:
        return "url string"

    def reader(self, schema) -> LineReader:
        return LineReader(self)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self)


class CdxSource(LineSource):
    headed = True
    columns = ("original", "timestamp", "mimetype")

    @classmethod
    def name(cls) -> str:
        return "cdx"

    def schema(self) -> str:
        return "pos long, original string, timestamp string, mimetype string"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets filters reach them: Spark asks for that where a reader takes any."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineSource)
    spark.dataSource.register(CdxSource)
