"""Packing by non-negative least squares on the histogram of lengths.

A window is a number of tokens that needs no padding: the capacity of a sequence, or a smaller power of two. Documents longer
than the capacity are cut into whole sequences and a rest, so lengths run up to the capacity and their histogram does not grow
with the data. `combinations` lists the shallow ways (up to three lengths) to fill a window; `least_squares` finds how often
each should be repeated so that together they come near the histogram; `solve` rounds these counts down, as far as there are
documents, and then repeats greedily what still fits. Small windows lie one after another, the large ones first, so that they
fill whole sequences.

What is left over is packed greedily in one row behind the windows, and cut where a sequence ends. The last, unfinished
sequence is cut into powers of two. So each sequence holds the capacity, or a power of two: nothing is padded, and a document
that fits a sequence is only cut where it lies across an end.

Every piece finds its place from its rank among the pieces of its length. Pieces that lie across an end meet their ids again
in a join; all others are placed without them.

Rows: null text counts as empty: a piece of the end id alone. Rows that share a doc_id, and null doc_ids, are packed like any
others; `row` tells them apart. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import n_partitions, release, slices, texts_of, word_encoder, written

#: Pieces of a length that are ranked together at most, on average; pieces across an end that are broadcast at most (40 bytes each).
RANKED, FEW = 1 << 17, 200_000
#: Triples of a window beyond this size have their shortest length on a grid of a 64th of the window.
DENSE, GRID = 512, 64


def power_windows(capacity: int) -> list[int]:
    """The capacity and the powers of two below it, largest first."""
    return [capacity, *(1 << k for k in reversed(range(capacity.bit_length())) if 1 << k < capacity)]


def combinations(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows and the lengths (n x 3, 0: none) of all combinations of the given lengths that fill a window."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    windows, parts = [], []

    def add(window: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> None:
        windows.append(np.full(len(a), window))
        parts.append(np.stack([a, b, c], 1))

    for w in power_windows(capacity):
        one = np.array([w] * int(there[w]), np.int64)
        add(w, one, 0 * one, 0 * one)
        b = np.arange(1, w // 2 + 1)
        b = b[there[b] & there[w - b]]
        add(w, w - b, b, 0 * b)
        step = max(1, w // GRID) if w > DENSE else 1
        for c in range(step, w // 3 + 1, step):
            if there[c]:
                b = np.arange(c, (w - c) // 2 + 1)
                b = b[there[b] & there[w - c - b]]
                add(w, w - c - b, b, np.full(len(b), c))
    return np.concatenate(windows), np.concatenate(parts)


def least_squares(parts: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 that brings the sum of x times the combinations near the counts by length, weighed by length: accelerated
    projected gradients, started anew whenever a step goes against the gradient."""
    n, size = len(parts), len(counts)
    if not n:
        return np.zeros(0)
    weight = np.sqrt(np.arange(size) / max(1, size - 1))
    weight[0] = 0  # length 0 stands for none
    target = weight * counts

    def apply(x: np.ndarray) -> np.ndarray:
        return weight * sum(np.bincount(parts[:, k], x, size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        r = weight * r
        return r[parts[:, 0]] + r[parts[:, 1]] + r[parts[:, 2]]

    v = np.ones(n)
    for _ in range(20):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 0.9 / norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        grad = back(apply(y) - target)
        new = np.maximum(0, y - step * grad)
        if grad @ (new - x) > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def solve(counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, tuple[int, ...], int]], np.ndarray]:
    """(window, lengths, times) of every combination that is used, large windows first, and the counts by length that remain."""
    rest = counts.astype(np.int64).tolist()
    windows, parts = combinations(np.flatnonzero(counts), capacity)
    x = least_squares(parts, counts / max(1, counts.max(initial=0))) * counts.max(initial=0)
    used: dict[int, int] = defaultdict(int)
    need: dict[int, dict[int, int]] = {}

    def repeat(k: int, most: int) -> None:
        if k not in need:
            own: dict[int, int] = defaultdict(int)
            for s in parts[k].tolist():
                if s:
                    own[s] += 1
            need[k] = own
        times = min([most, *(rest[s] // m for s, m in need[k].items())])
        if times:
            used[k] += times
            for s, m in need[k].items():
                rest[s] -= times * m

    whole = np.floor(x + 1e-6).astype(np.int64)
    order = np.argsort(-x * windows, kind="stable")
    for k in order[whole[order] > 0].tolist():
        repeat(k, int(whole[k]))
    for k in np.lexsort((-x, -windows)).tolist():
        a, b, c = parts[k].tolist()
        if rest[a] and (not b or rest[b]) and (not c or rest[c]):
            repeat(k, 1 << 62)
    plan = [(int(windows[k]), tuple(s for s in parts[k].tolist() if s), n) for k, n in used.items()]
    return sorted(plan, key=lambda p: (-p[0], p[1])), np.array(rest, np.int64)


def places(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Where the pieces of each length go, as rows `length, first rank, first position, pieces a step, step`: rank r of a length
    lies at first position + (r - first rank) // pieces a step * step + (r - first rank) % pieces a step * length."""
    plan, rest = solve(counts, capacity)
    rows, at, seen = [], 0, np.zeros(len(counts), np.int64)
    for window, lengths, times in plan:
        inside = 0
        for s in dict.fromkeys(lengths):
            m = lengths.count(s)
            rows.append((s, seen[s], at + inside, m, window))
            seen[s] += m * times
            inside += m * s
        at += window * times
    for s in np.flatnonzero(rest)[::-1].tolist():
        rows.append((s, seen[s], at, 1, s))
        at += s * int(rest[s])
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ends(total: int, capacity: int) -> np.ndarray:
    """Where the sequences behind the last whole one begin and end: the last tokens in powers of two, largest first."""
    out = [total // capacity * capacity]
    left = total - out[0]
    while left:
        out.append(out[-1] + (1 << left.bit_length() - 1))
        left -= 1 << left.bit_length() - 1
    return np.array(out, np.int64)


def sequence_of(position: np.ndarray, last: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, its first position, its end) of each position."""
    seq = position // capacity
    first, end = seq * capacity, (seq + 1) * capacity
    late = position >= last[0]
    if late.any():
        k = np.searchsorted(last, position[late], "right") - 1
        seq[late], first[late], end[late] = last[0] // capacity + k, last[k], last[k + 1]
    return seq, first, end


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """`row, doc_id, start, length, ids_crc32, doc_tokens, ids` of every document, cut where it holds more than a whole sequence."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = word_encoder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], enc.dtype)
        for b in slices(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(texts_of(b))):
                ids = np.concatenate((ids, end))
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    out.append((n, doc_id, a, len(part), _crc(part), len(ids), part.tobytes()))
                n += 1
                if len(out) >= 2_000:
                    yield _batch(out, _PIECE)
                    out = []
            if out:
                yield _batch(out, _PIECE)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")


_PIECE = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
_PLACED = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(zip(*rows), names)], names)


def ranked(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """The rows `row, start, length, ...` with their rank among those of their length. A length that many rows share is ranked in parts."""
    most = max(1, min(RANKED, sum(counts.values()) // (4 * n_partitions(rows.sparkSession))))
    parts = rows.sparkSession.createDataFrame([(k, -(-n // most)) for k, n in counts.items()], "length long, parts long")  # a row for each length
    dealt = rows.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row", "start"), "parts").cast("int")).drop("parts")
    before = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "start")).cast("long") - 1)
    return local.join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Pieces of `docs(doc_id, text)`: `row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`."""
    cut = written(pieces(docs, tokenizer, end_id, capacity), "windows")
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        histogram[k] = n
    table = places(histogram, capacity)
    last = ends(int(histogram @ np.arange(capacity + 1)), capacity)
    send = spark.sparkContext.broadcast((table, last))
    light = [c for c in _PIECE if c != "ids"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last = send.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            col = {n: b.column(b.schema.get_field_index(n)) for n in [*light, "rank"]}
            length, rank = col["length"].to_numpy(), col.pop("rank").to_numpy()
            _, first, position, each, step = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            k = rank - first
            position = position + k // each * step + k % each * length
            seq, begin, end = sequence_of(position, last, capacity)
            yield pa.RecordBatch.from_pydict(col | {"position": pa.array(position), "sequence_id": pa.array(seq), "offset": pa.array(position - begin), "across": pa.array(position + length > end)})

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, last = send.value
        dtype = word_encoder(tokenizer).dtype
        for b in batches:
            out: list[tuple] = []
            for row, doc_id, start, length, tokens, position, ids in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("row", "doc_id", "start", "length", "doc_tokens", "position", "ids"))):
                ids, a = np.frombuffer(ids, dtype), 0
                while a < length:
                    (seq,), (begin,), (end,) = sequence_of(np.array([position + a]), last, capacity)
                    n = min(length - a, int(end) - position - a)
                    out.append((row, doc_id, start + a, n, _crc(ids[a : a + n]), tokens, int(seq), int(position + a - begin)))
                    a += n
                if len(out) >= 10_000:
                    yield _batch(out, _PLACED)
                    out = []
            if out:
                yield _batch(out, _PLACED)
        release()

    schema = ", ".join(f"`{n}` long" for n in light)
    placed = ranked(cut.select(*light), counts).mapInArrow(place, f"{schema}, position long, sequence_id long, `offset` long, across boolean")
    placed = written(placed, "placed")
    across = placed.filter("across").select("row", "start", "doc_id", "length", "doc_tokens", "position")
    if placed.filter("across").count() <= FEW:
        across = F.broadcast(across)
    halves = cut.select("row", "start", "ids").join(across, ["row", "start"]).mapInArrow(split, ", ".join(f"`{n}` long" for n in _PLACED))
    return placed.filter("NOT across").select(*_PLACED).unionByName(halves)
