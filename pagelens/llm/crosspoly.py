"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) turns a unit vector; its hash is the
signed axis closest to the turned vector. Several tables with rotations of their own are kept. Every vector has one cell
in a table; a query probes the cells of its closest axes, best first, in each table. Vectors in a probed cell are
candidates and are compared exactly, in double precision, on the original vectors; the best of all cells are the answer.

Vectors that are equal are one entry of the index, with as many of their smallest ids as an answer can need, so a vector
that a third of all rows share fills no cell. Cells are searched in parts: a cell's vectors in parts of about PART_ROWS and
the queries that probe it in parts of about PART_QUERIES, by the size of that very cell, so popular directions are split on
both sides. Each part sends on only its best for each query.

A query has k rows, or all other rows where there are fewer. Queries for which the cells give fewer are compared with the
whole index, in parts of bounded size that again send on only their best; their answer is exact.

Rows: vectors that are null, empty, zero, or hold null or non-finite components take no part; rows with null vec_id
neither. Vectors of different lengths have no cosine: those of each length are searched among themselves. Of rows that
share a vec_id the one with the smallest vector counts. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import n_partitions, written

#: Vectors that a part of a cell holds on average, and queries that meet them.
PART_ROWS, PART_QUERIES = 2000, 4000
#: Queries that meet a part of the index together where cells gave too few rows.
SHORT_QUERIES = 20_000
SCHEMA = "query_id long, rank int, vec_id long, score double"
NAMES = ["t", "cell", "part", "asks", "v", "ids", "query_id"]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Rotations:
    """Pseudo-random rotations for some tables; vectors are padded with zeros to a power of two."""

    def __init__(self, dim: int, tables: int, seed: int):
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    def axes(self, x: np.ndarray, table: int) -> np.ndarray:
        """How far each unit vector reaches along every signed axis of a table."""
        y = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        for s in self.signs[table]:
            y = hadamard(y * s)
        return np.hstack([y, -y])


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each row summed alone, so that equal pairs have equal scores wherever they are computed."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _best(pairs: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best with their rank, by score downwards and id upwards."""
    pairs = pairs.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    pairs = pairs.assign(rank=pairs.groupby("query_id").cumcount() + 1)
    return pairs[pairs["rank"] <= k]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _counted(times: np.ndarray) -> np.ndarray:
    """0, 1, ... for each number, as far as it says."""
    return np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id, v` (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 5, tables: int = 8, probes: int | None = None, seed: int = 3) -> DataFrame:
    """`query_id, rank, vec_id, score`: for each row of `vectors(vec_id, embedding)` where `is_query` (a column) holds, the k nearest found among all other rows. Unless given, the probes grow with the width: 20 up to 64 dimensions."""
    spark = vectors.sparkSession
    rows = written(usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()  # a row for each length that occurs
    found = spark.createDataFrame([], SCHEMA)
    for dim, n in sorted(lengths):
        found = found.unionByName(_nearest(rows.filter(F.size("v") == dim), dim, n, is_query, k, tables, probes, seed))
    return found


def _nearest(rows: DataFrame, dim: int, n_rows: int, is_query, k: int, tables: int, probes: int | None, seed: int) -> DataFrame:
    """nearest() among `rows(vec_id, v)` of one length."""
    spark = rows.sparkSession
    parts = n_partitions(spark)
    none = pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
    turn = spark.sparkContext.broadcast(Rotations(dim, tables, seed))
    width = 2 * turn.value.width
    probes = min(width, probes if probes is not None else max(20, width * 10 // 64))

    def fewest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 smallest ids of each vector in this partition: a query's own id may be one of them."""
        seen: dict[bytes, list[int]] = {}
        for b in batches:
            v = _matrix(b.column(1), dim) + 0.0  # no negative zeros
            for i, x in zip(b.column(0).to_pylist(), v):
                ids = seen.setdefault(x.tobytes(), [])
                if i not in ids:
                    ids.append(i)
                    ids.sort()
                    del ids[k + 1 :]
            if len(seen) >= 20_000:  # what comes again is merged with it below
                yield from entries(seen)
                seen = {}
        yield from entries(seen)

    def entries(seen: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
        items = list(seen.items())
        for a in range(0, len(items), 5_000):
            part = items[a : a + 5_000]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.binary()), pa.array([i for _, i in part], pa.list_(pa.int64()))], ["v", "ids"])

    local = rows.mapInArrow(fewest, "v binary, ids array<long>")
    merged = local.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))  # at most k + 1 ids from each partition
    index = written(merged, "index")
    n = index.count()

    def occupied(batches: Iterable[pa.RecordBatch], asks: bool) -> Iterator[pa.RecordBatch]:
        """How many vectors (or, of queries, probes) of this partition each cell gets."""
        got = np.zeros(tables * width, np.int64)
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column(1), dim) if asks else np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(-1, dim))
                for t in range(tables):
                    got += np.bincount(t * width + closest(x, t, probes if asks else 1).ravel(), minlength=len(got))
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["at", "n"])

    def closest(x: np.ndarray, t: int, m: int) -> np.ndarray:
        axes = turn.value.axes(x, t)
        return np.argsort(-axes, axis=1, kind="stable")[:, :m] if m > 1 else axes.argmax(1)[:, None]

    def in_parts(df: DataFrame, asks: bool, most: int) -> np.ndarray:
        """Parts of every cell: tables x width numbers, whatever the size of the table."""
        out = np.ones(tables * width, np.int64)
        for r in df.mapInArrow(lambda it: occupied(it, asks), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = -(-r["n"] // most)
        return out.reshape(tables, width)

    asked = rows.filter(is_query)
    split = spark.sparkContext.broadcast((in_parts(index, False, PART_ROWS), in_parts(asked, True, PART_QUERIES)))

    def batch(t: int, cell: np.ndarray, part: np.ndarray, asks: np.ndarray, raw: pa.Array, ids: pa.Array, query: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), t, np.int32)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(asks.astype(np.int32)), raw, ids, query], NAMES)

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each index row in its part of its cells, for every part of the queries there."""
        for b in batches:
            raw = b.column(0).to_pylist()
            if not raw:
                continue
            x = unit(np.frombuffer(b"".join(raw)).reshape(-1, dim))
            own = np.array([hash_bytes(r) for r in raw], np.uint64) >> np.uint64(1)
            for t in range(tables):
                cell = closest(x, t, 1)[:, 0]
                times = split.value[1][t, cell]
                which = np.repeat(np.arange(len(raw)), times)
                part = own.astype(np.int64)[which] % split.value[0][t, cell[which]]
                take = pa.array(which)
                yield batch(t, cell[which], part, _counted(times), b.column(0).take(take), b.column(1).take(take), pa.nulls(len(which), pa.int64()))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query in its part of the cells that it probes, for every part of the vectors there."""
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                c = b.slice(a, 1000)
                v = _matrix(c.column(1), dim) + 0.0
                raw = pa.array([x.tobytes() for x in v], pa.binary())
                own = np.array([hash_bytes(i.to_bytes(8, "little", signed=True)) for i in c.column(0).to_pylist()], np.uint64) >> np.uint64(1)
                x = unit(v)
                for t in range(tables):
                    cell = closest(x, t, probes).ravel()
                    times = split.value[0][t, cell]
                    at = np.repeat(np.arange(len(cell)), times)
                    which = at // probes
                    part = own.astype(np.int64)[which] % split.value[1][t, cell[at]]
                    take = pa.array(which)
                    yield batch(t, cell[at], _counted(times), part, raw.take(take), pa.nulls(len(which), pa.list_(pa.int64())), c.column(0).take(take))

    def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The best of one part of a cell for the queries that probe it."""
        out = [none]
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left.v)).reshape(-1, dim)
            ids, ux = left.ids.tolist(), unit(x)
            for a in range(0, len(right), 512):
                block = right.iloc[a : a + 512]
                q = np.frombuffer(b"".join(block.v)).reshape(-1, dim)
                s = unit(q) @ ux.T
                m = min(k + 1, len(x))  # the query's own vector may be among them
                edge = np.partition(s, len(x) - m, axis=1)[:, len(x) - m] - 1e-9
                qi, xi = np.nonzero(s >= edge[:, None])
                sizes = np.array([len(ids[i]) for i in xi])
                pairs = pd.DataFrame({
                    "query_id": np.repeat(block.query_id.to_numpy(np.int64)[qi], sizes),
                    "vec_id": np.concatenate([ids[i] for i in xi]).astype(np.int64),
                    "score": np.repeat(_cosine(q[qi], x[xi]), sizes),
                })
                out.append(_best(pairs[pairs.vec_id != pairs.query_id], k))
        return pd.concat(out)[["query_id", "vec_id", "score"]]

    entry = "t int, cell int, part int, asks int, v binary, ids array<long>, query_id long"
    by = ["t", "cell", "part", "asks"]
    entries = index.mapInArrow(cells, entry)
    queries = asked.mapInArrow(probe, entry)
    found = entries.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a query's rows are here; they come sorted by query."""
        rest = None
        for b in batches:
            t = b.to_pandas()
            t = t if rest is None else pd.concat([rest, t])
            last = t.query_id == t.query_id.iloc[-1] if len(t) else None
            if last is not None:
                rest, t = t[last], t[~last]
                yield from answer(t)
        if rest is not None:
            yield from answer(rest)

    def answer(t: pd.DataFrame) -> Iterator[pa.RecordBatch]:
        if len(t):
            t = _best(t.drop_duplicates(["query_id", "vec_id"]), k)
            yield pa.RecordBatch.from_arrays([pa.array(t.query_id), pa.array(t["rank"].astype("int32")), pa.array(t.vec_id), pa.array(t.score)], ["query_id", "rank", "vec_id", "score"])

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.repartition(parts, "query_id").sortWithinPartitions("query_id").mapInArrow(best, SCHEMA)

    first = written(ranked(found), "answers")
    least = min(k, n_rows - 1)
    full = first.groupBy("query_id").count().filter(F.col("count") >= least).select("query_id")
    short = written(asked.select(F.col("vec_id").alias("query_id"), "v").join(full, "query_id", "left_anti"), "short")
    n_short = short.count() if least else 0
    if not n_short:
        return first
    blocks, pieces = -(-n_short // SHORT_QUERIES), -(-n // PART_ROWS)

    def everywhere(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each index row in its piece, for every block of queries."""
        for b in batches:
            piece = np.array([hash_bytes(r) % pieces for r in b.column(0).to_pylist()], np.int64)
            for block in range(blocks if b.num_rows else 0):
                yield batch(-1, np.zeros(b.num_rows), piece, np.full(b.num_rows, block), b.column(0), b.column(1), pa.nulls(b.num_rows, pa.int64()))

    def ask_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query in its block, for every piece of the index."""
        for b in batches:
            if not b.num_rows:
                continue
            raw = pa.array([x.tobytes() for x in _matrix(b.column(1), dim) + 0.0], pa.binary())
            block = np.array([hash_bytes(i.to_bytes(8, "little", signed=True)) % blocks for i in b.column(0).to_pylist()], np.int64)
            for piece in range(pieces):
                yield batch(-1, np.zeros(b.num_rows), np.full(b.num_rows, piece), block, raw, pa.nulls(b.num_rows, pa.list_(pa.int64())), b.column(0))

    exact = index.mapInArrow(everywhere, entry).groupBy(*by).cogroup(short.mapInArrow(ask_all, entry).groupBy(*by)).applyInPandas(search, "query_id long, vec_id long, score double")
    return first.join(short.select("query_id"), "query_id", "left_anti").unionByName(ranked(exact))


def hash_bytes(x: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(x)
