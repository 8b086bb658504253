"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Documents become pieces: only documents of more than `capacity` tokens are cut, into pieces of `capacity` tokens and a
last one that may be shorter. How many pieces there are of each length decides the packing, and lengths are whole numbers
up to `capacity`; so the packing is worked out on the table of counts by length, whose size does not grow with the data.
It gives patterns (a list of lengths, and how many sequences look like that). Each piece then finds its place from its
rank among the pieces of its length.

Dominance: for an item j, a set F that holds j dominates another such set G if G's items other than j can be split into
groups, each no heavier than an item of F of its own. If F dominates all feasible sets with j, some optimal packing has
F as one of its sequences, so F can be fixed for good. `reduce_counts` fixes F = {j}, {j, a} or {j, a, b} where this holds.

Rows: null text counts as empty: a piece of the end id alone. Rows that share a doc_id, and null doc_ids, are packed
like any others. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import slices, texts_of, word_encoder, written

#: Pieces of one length that are ranked together on average, so that no length is ranked by one task.
RANKED = 1 << 17

Pattern = tuple[tuple[int, ...], int]


class _Counts:
    """Counts by length, with the lengths that occur in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.keys = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.keys.remove(length)

    def at_most(self, limit: int, used: Counter) -> int | None:
        """The largest length up to `limit` of which an item is left beside those in `used`."""
        i = bisect_right(self.keys, limit) - 1
        while i >= 0 and self.n[self.keys[i]] <= used[self.keys[i]]:
            i -= 1
        return self.keys[i] if i >= 0 else None

    def smallest(self, k: int, used: Counter) -> list[int]:
        out: list[int] = []
        for x in self.keys:
            out += [x] * min(k - len(out), self.n[x] - used[x])
            if len(out) == k:
                break
        return out


def _dominating(c: _Counts, j: int, capacity: int) -> tuple[int, ...] | None:
    """A set with j that dominates all feasible sets with j, or None."""
    room, used = capacity - j, Counter([j])
    low = c.smallest(3, used)
    fit = next((k for k in (3, 2, 1) if len(low) >= k and sum(low[:k]) <= room), 0)
    if fit == 0:
        return (j,)  # nothing goes beside j
    a = c.at_most(room, used)
    if fit == 1 or a == room:
        return (j, a)  # one item at most goes beside j, or a fills the sequence
    if fit == 3:
        return None
    best, pair, most_second = 0, None, 0
    for i, x in enumerate(c.keys):  # the smaller item of a pair
        if 2 * x > room:
            break
        if c.n[x] <= used[x]:
            continue
        y = c.at_most(room - x, used + Counter([x]))
        if y is None or y < x:
            continue
        most_second = x
        if x + y >= best:
            best, pair = x + y, (y, x)
    if pair is None or a >= best:
        return (j, a)  # any two items together weigh no more than a
    if pair[0] == a and most_second <= pair[1]:
        return (j, *pair)  # single items weigh no more than a, and second items no more than b
    return None


def reduce_counts(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """The sets that dominance fixes, and the counts that remain."""
    c, fixed = _Counts(counts), []
    i = len(c.keys) - 1
    while i >= 0:
        j = c.keys[i]
        found = _dominating(c, j, capacity)
        if found is None:
            i -= 1
            continue
        need = Counter(found)
        times = min(c.n[x] // k for x, k in need.items())
        for x, k in need.items():
            c.take(x, times * k)
        fixed.append((found, times))
        i = min(i, len(c.keys) - 1)
        while i + 1 < len(c.keys) and c.keys[i] < j:
            i += 1  # lengths below j may have gone: stay at j or just below
        if i >= 0 and c.keys[i] > j:
            i = bisect_right(c.keys, j) - 1
    return fixed, dict(c.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: each length goes to the fullest sequences that still have room."""
    room: list[tuple[int, int]] = []  # (room left, number of the pattern), ascending
    patterns: list[list] = []  # [lengths, count]

    def put(lengths: tuple[int, ...], n: int, left: int) -> None:
        patterns.append([lengths, n])
        if left:
            insort(room, (left, len(patterns) - 1))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_right(room, (s, -1))
            if i < len(room):
                left, p = room.pop(i)
                lengths, have = patterns[p]
                patterns[p][1] = 0
            else:
                left, lengths, have = capacity, (), n
            each = left // s  # a sequence just filled has the least room, so the next of this length joins it
            full = min(have, n // each)
            if full:
                put((*lengths, *[s] * each), full, left - each * s)
                n -= full * each
            rest = have - full
            if rest and n:
                k = min(n, each)
                put((*lengths, *[s] * k), 1, left - k * s)
                n -= k
                rest -= 1
            if rest and lengths:
                put(lengths, rest, left)
    return [(p, n) for p, n in patterns if n]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns for all pieces counted by length."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed, rest = reduce_counts(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """For each length and pattern: the first rank that goes there, the pattern's first sequence, items a sequence, first offset."""
    rows, first, seen = [], 0, Counter()
    for lengths, n in patterns:
        at = 0
        for x, k in Counter(lengths).items():
            rows.append((x, seen[x], first, k, at))
            seen[x] += n * k
            at += x * k
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """`row, doc_id, piece, start, length, ids_crc32` and on request `ids` of every piece; `row` tells documents apart that share a doc_id."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = word_encoder(tokenizer), TaskContext.get().partitionId() << 40
        end = np.array([end_id], enc.dtype)
        for b in slices(batches):
            out: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(texts_of(b))):
                ids = np.concatenate((ids, end))
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity].astype("<u4")
                    out.append((n, doc_id, k, a, len(part), zlib.crc32(part.tobytes())) + ((part.astype(np.int32),) if with_ids else ()))
                n += 1
                if len(out) >= 5_000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of `docs(doc_id, text)` with `sequence_id` and `offset`, and the `row` of their document, which tells copies apart; with_ids adds the ids of each piece."""
    cut = written(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    spark = cut.sparkSession
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = slots(plan(totals, capacity))
    salts = np.zeros(capacity + 2, np.int64)
    for k, n in totals.items():
        salts[k + 1] = -(-n // RANKED)
    start = np.cumsum(salts)  # where the salts of a length start in one row of all salts
    salted = spark.createDataFrame([(k, int(salts[k + 1])) for k in totals], "length long, salts long")
    cut = cut.join(F.broadcast(salted), "length").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), "salts").cast("int")).drop("salts")
    by = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows and one for each RANKED pieces
    base = np.zeros(start[-1], np.int64)
    for r in by:
        base[start[r.length] + r.salt] = r.n
    for k in totals:  # ranks before a salt
        part = base[start[k] : start[k + 1]]
        part[:] = np.cumsum(part) - part
    send = spark.sparkContext.broadcast((base, start, table))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, start, table = send.value
        keys = table[:, 0] * (1 << 44) + table[:, 1]
        for b in batches:
            length, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "salt", "local_rank"))
            r = base[start[length] + salt] + rank
            i = np.searchsorted(keys, length * (1 << 44) + r, "right") - 1
            _, first, seq, each, at = table[i].T
            k = r - first
            cols = {n: b.column(b.schema.get_field_index(n)) for n in names}
            yield pa.RecordBatch.from_pydict(cols | {"sequence_id": pa.array(seq + k // each), "offset": pa.array(at + k % each * length)})

    names = [f.name for f in cut.schema if f.name != "salt"]
    w = Window.partitionBy("length", "salt").orderBy("row", "piece")
    ranked = cut.withColumn("local_rank", F.row_number().over(w).cast("long") - 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, `offset` long")
