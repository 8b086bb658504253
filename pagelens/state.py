"""The state of a crawl in generations: whole tables in a folder of their own, made current by one small file written last.

A round that fails halfway leaves the last generation in force, so a resumed run repeats the round and nothing else.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelens import __version__
from pagelens.changes import Changes
from pagelens.config import Config, ConfigError, identity, plain
from pagelens.schema import STATE

#: Internal columns beside those of the schema: the bytes of data URIs until they are stored.
EXTRA = {"image_url": ", inline binary"}
#: What a page row has from its birth, and what changes: the columns of the changes that a run under way keeps.
FIXED = "page_id long, url string, kind string, depth int, discovered_from long, pattern string"
VARYING = "state string, skip_reason string, status int, final_url string, content_type string, rendered boolean, fetched_at timestamp, error string"
#: Parts of a table beyond which it is written as one.
MOST_PARTS = 16


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


class Store:
    """Reads and commits generations under `out/_state`, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self.root = f"{self.out}/_state"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """Replaces a small file in one step."""
        fs, tmp = self._fs(path + ".tmp")
        stream = fs.create(tmp, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        files = context.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
        how[0] = context.Options.Rename.OVERWRITE  # the old file is there until the new one is
        files.rename(tmp, self._fs(path)[1], how)

    def meta(self) -> dict:
        return json.loads(self._read(f"{self.root}/meta.json") or self._read(f"{self.root}/meta.json.tmp") or "{}")

    def set_meta(self, **values) -> dict:
        meta = self.meta() | values
        self._put(f"{self.root}/meta.json", json.dumps(meta, sort_keys=True))
        return meta

    def schema(self, name: str) -> StructType:
        return StructType.fromDDL(STATE[name] + EXTRA.get(name, ""))

    def table(self, name: str) -> DataFrame:
        """A table as it stands; while a run is under way, its changes are the pages."""
        schema, meta = self.schema(name), self.meta()
        if name == "page" and (run := meta.get("open_run")):
            pages = Changes(self.spark, run["path"], FIXED, VARYING, run["buckets"]).current(run["gen"])
            return pages.select(*schema.names)
        parts = meta.get("tables", {}).get(name)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in STATE}

    def commit(self, changed: dict[str, DataFrame], added: dict[str, DataFrame] | None = None, **meta) -> None:
        """Writes the changed tables, and the rows added to others, as a new generation, then makes it current. What is neither
        changed nor added to stays where it is; a table of more than MOST_PARTS parts is written anew."""
        old = self.meta()
        gen = old.get("generation", 0) + 1
        at = dict(old.get("tables", {}))
        for name, df in (changed | (added or {})).items():
            parts = [] if name in changed else at.get(name, [])
            if len(parts) >= MOST_PARTS:
                parts, df = [], self.table(name).unionByName(df)
            at[name] = [*parts, f"gen-{gen:06d}/{name}.parquet"]
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema(name)]).write.mode("overwrite").parquet(f"{self.root}/{at[name][-1]}")
        self.set_meta(generation=gen, tables=at, **meta)
        used = {p.split("/")[0] for parts in at.values() for p in parts}
        fs, root = self._fs(self.root)
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("gen-") and name not in used and name < f"gen-{gen:06d}":
                fs.delete(s.getPath(), True)

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def clear(self) -> None:
        """Deletes what runs that broke off have left."""
        fs, root = self._fs(self.root)
        used = (self.meta().get("open_run") or {}).get("path", "")
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("run-") and f"/{name}/" not in used:
                fs.delete(s.getPath(), True)

    def open(self, cfg: Config, overwrite: bool = False, resume: bool = True) -> bool:
        """Readies the output folder and says whether it goes on from an earlier run. Another run's folder is refused, as is one with files that are not ours."""
        meta = self.meta()
        fs, out = self._fs(self.out)
        if meta and not overwrite:
            if meta["scope_key"] != identity(cfg):
                raise ConfigError(f"{self.out} was made with other seeds or another scope")
            if not resume:
                raise ConfigError(f"{self.out} holds a run already")
            return True
        if meta:
            self.purge()
        elif fs.exists(out) and len(fs.listStatus(out)):
            raise ConfigError(f"{self.out} is not empty and holds no run")
        self.set_meta(schema_version="1", created_at=now(), config=plain(cfg), scope_key=identity(cfg), status="new", generation=0, tables={}, runs=[])
        return False

    def begin(self) -> int:
        runs = self.meta().get("runs", [])
        runs.append({"run_id": len(runs) + 1, "started_at": now(), "ended_at": None, "status": "running", "engine_version": __version__})
        self.set_meta(runs=runs, status="running")
        return len(runs)

    def end(self, run_id: int, status: str, statistics: dict | None = None) -> None:
        runs = self.meta()["runs"]
        runs[run_id - 1] |= {"ended_at": now(), "status": status, "statistics": statistics}
        self.set_meta(runs=runs, status=status)

    def purge(self) -> list[str]:
        """Deletes our own files and folders only; the output folder goes if nothing else is in it."""
        gone = []
        for name in ("_state", "images", "friendly", "manifest.csv", "manifest.json", "urls.csv"):
            fs, p = self._fs(f"{self.out}/{name}")
            if fs.exists(p) and fs.delete(p, True):
                gone.append(name)
        fs, out = self._fs(self.out)
        if fs.exists(out) and not len(fs.listStatus(out)):
            fs.delete(out, False)
        return gone


def requeue_failed(table: DataFrame) -> DataFrame:
    """Failed rows queued again, their errors forgotten."""
    failed = F.col("state") == "failed"
    return table.withColumns({"error": F.when(~failed, F.col("error")), "state": F.when(failed, "queued").otherwise(F.col("state"))})


def recover(table: DataFrame) -> DataFrame:
    """Rows that were under way when a run broke off queued again."""
    return table.withColumn("state", F.when(F.col("state") == "in_progress", "queued").otherwise(F.col("state")))


def orphans(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Stored paths that no file row knows."""
    return paths.join(files.select("path"), "path", "left_anti")
