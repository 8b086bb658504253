"""Tables in buckets of a key, so that what meets them is dealt once and they themselves are never dealt again.

`Changes` is a table of append-only changes: each generation adds the rows that are new and, for rows that have changed, the
columns that differ. What a generation writes follows what has changed in it, not the table. Reading merges the changes of a
key, which lie in one bucket; looking up keys reads their column alone. `compact` writes the merged rows as a new table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows that a bucket holds before a table gets more buckets than there are cores.
ROWS_A_BUCKET = 50_000


def n_buckets(spark: SparkSession, rows: int | None = None) -> int:
    """As many as there are shuffle partitions. Where the rows have been counted the number follows them, as each bucket is a task
    and a file of every step, and what meets a bucket is held in memory."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return most if rows is None else max(min(most, spark.sparkContext.defaultParallelism), -(-rows // ROWS_A_BUCKET))


def _name(path: str) -> str:
    return f"pagelens_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _declare(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> str:
    """The session's name for the files under a path; files that are there already are its rows."""
    name = _name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return name


def bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """The rows written in buckets of `key`, and read again."""
    spark = df.sparkSession
    name = _declare(spark, path, df.schema, key, buckets)
    df.repartition(buckets, key).write.mode("append").insertInto(name)
    return spark.table(name)


def beside(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows dealt as the buckets are. In a join with a table in buckets they are the hash table of each bucket, and the table is
    passed over once, neither dealt nor sorted nor sent to all tasks, however many buckets and shuffle partitions there are."""
    return rows.repartition(buckets, key).hint("shuffle_hash")


def undeclare(spark: SparkSession, *paths: str) -> None:
    """Forgets the names; the files stay."""
    for path in paths:
        spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")


class Changes:
    """Rows by a long key `u`. `fixed` columns are given once, when a row is born; `varying` ones by the latest generation."""

    def __init__(self, spark: SparkSession, path: str, fixed: str, varying: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.fixed, self.varying = (StructType.fromDDL(x) for x in (fixed, varying))
        self.schema = StructType.fromDDL(f"u long, {fixed}, {varying}, born boolean, gen int")
        self.name = _declare(spark, path, self.schema, "u", buckets)

    def append(self, df: DataFrame, gen: int, born: bool) -> None:
        """Adds new rows (`u` and all columns), or changed ones (`u` and the varying columns)."""
        have = {f.name for f in self.varying} | {"u"} | ({f.name for f in self.fixed} if born else set())
        own = {"born": F.lit(born), "gen": F.lit(gen)}
        cells = [(own[f.name] if f.name in own else F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        df.select(*cells).repartition(self.buckets, "u").write.mode("append").insertInto(self.name)

    def _upto(self, gen: int) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("gen") <= gen)

    def keys(self, gen: int) -> DataFrame:
        """`u` of all rows up to a generation."""
        return self._upto(gen).filter("born").select("u")

    def unseen(self, rows: DataFrame, gen: int) -> DataFrame:
        """Those of `rows(u, ...)`, one for each key, whose key no row has up to a generation. The few that are known are found first, by
        a hash table of the asking keys in each bucket: the table is passed over once, and neither sorted nor dealt."""
        known = self.keys(gen).join(beside(rows.select("u"), "u", self.buckets), "u", "left_semi")
        return rows.join(known, "u", "left_anti")

    def current(self, gen: int) -> DataFrame:
        """The rows as they stand at a generation."""
        last = F.max_by(F.struct(*[f.name for f in self.varying]), "gen").alias("_last")
        once = [F.max(F.when(F.col("born"), F.col(f.name))).alias(f.name) for f in self.fixed]
        merged = self._upto(gen).groupBy("u").agg(last, *once)
        return merged.select("u", *[f.name for f in self.fixed], *[F.col(f"_last.{f.name}").alias(f.name) for f in self.varying])

    def compact(self, path: str, gen: int) -> "Changes":
        """A new table with one row for each key."""
        out = object.__new__(Changes)
        out.__dict__ |= self.__dict__ | {"path": path, "name": _declare(self.spark, path, self.schema, "u", self.buckets)}
        out.append(self.current(gen), gen, born=True)
        return out

