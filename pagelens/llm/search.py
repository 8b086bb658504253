"""Ranked lexical search over inverted treaps.

Documents are read in blocks. A block is an inverted index of its own: its documents in ascending order of doc_id, and for
each term the places of the documents that hold it and how often they do. `build_index` writes the blocks, with all terms,
so that one index answers any items. Counts over all documents (documents, terms, documents of a term) are sums over blocks.

A search brings the items to the blocks. Each term of an item gets a treap over its postings: documents in order across,
impacts (what a posting adds to the score) in heap order down, so that the root of a subtree bounds all below it. A treap's
shape follows from its documents and impacts, so its nodes are made when a traversal first asks for them, and items share them.
All treaps of an item are walked at once over intervals of documents, the interval with the largest sum of roots first: the
largest root is scored and splits its interval, roots that lie outside of an interval give way to their subtrees, and an
interval goes when its sum of roots cannot enter the k best found so far, which a task carries from block to block. Intervals
with few postings are summed as a whole.

Items are brought in chunks of bounded size, so neither the driver nor a task holds all of them where they are many. Each
task gives its k best for an item, and these are ranked in two steps.

Rows: null and empty texts have no terms; such documents are never found, and such items have no rows. Null doc_ids come
last among equal scores and are found like others. Rows that share a doc_id are documents of their own, rows that share an
item_id are items of their own. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.common import release, slices, texts_of, written
from pagelens.llm.tokencount import pack_arrays, unpack_arrays

#: Bytes of text in a block; bytes of items in a chunk; postings that are summed as a whole; parts in which an item's results are ranked first.
BLOCK_BYTES, CHUNK_BYTES, LEAF, PARTS = 16_000_000, 16_000_000, 32_768, 64
#: Fixed: bytes of terms are digits, Latin letters in lower case and all bytes beyond ASCII; any other byte ends a term.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LAST = 1 << 63  # where null doc_ids stand among equal scores


def terms(text: str) -> list[bytes]:
    """The maximal runs of letters and digits, in which every character beyond ASCII counts as a letter and A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


class _Block:
    """Documents in the making of a block."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.number: dict[bytes, int] = {}
        self.flat = array("I")
        self.bytes = 0

    def add(self, doc_id: int | None, text: str) -> None:
        found, number = terms(text), self.number
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.flat.extend([number.setdefault(w, len(number)) for w in found])
        self.bytes += len(text) + 64

    def row(self, block: int) -> pa.RecordBatch:
        n = len(self.ids)
        order = np.array(sorted(range(n), key=lambda k: (self.ids[k] is None, self.ids[k] or 0)))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        sizes = np.array(self.sizes, np.int64)
        has = np.array([i is not None for i in self.ids], np.uint8)[order]
        ids = np.array([i or 0 for i in self.ids], np.int64)[order]
        pair, tf = np.unique(np.frombuffer(self.flat, np.uint32).astype(np.int64) * n + np.repeat(place, sizes), return_counts=True)
        term, doc = pair // n, pair % n
        words = list(self.number)
        text = np.frombuffer(b"".join(words), np.uint8)
        uses = np.bincount(term, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        cells = [[block], [int((sizes > 0).sum())], [int(sizes.sum())], [pack_arrays(has, ids.view(np.uint64), sizes[order])], [pack_arrays(text, np.array([len(w) for w in words], np.int64), uses)], [pack_arrays(doc, tf)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int64()] * 3 + [pa.binary()] * 3)], ["block", "n_docs", "n_terms", "docs", "terms", "posts"])


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The index of `docs(doc_id, text)`, a row for each block, written to shared storage."""

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, _Block()
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b)):
                block.add(doc_id, text)
                if block.bytes >= block_bytes:
                    yield block.row(number)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.row(number)
        del block
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(blocks, "block long, n_docs long, n_terms long, docs binary, terms binary, posts binary"), "search-index")


def _found(data: bytes, wanted: dict[bytes, int]) -> Iterator[tuple[int, int, int]]:
    """(number of the wanted term, first posting, end of postings) for each wanted term of a block."""
    text, sizes, uses = unpack_arrays(data)
    raw, ends, stops = text.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist(), np.cumsum(uses, dtype=np.int64).tolist()
    a = first = 0
    get = wanted.get
    for e, stop in zip(ends, stops):
        if (k := get(raw[a:e])) is not None:
            yield k, first, stop
        a, first = e, stop


def document_counts(index: DataFrame, wanted: dict[bytes, int]) -> np.ndarray:
    """How many documents hold each wanted term; a task sends one number for each term at most."""
    send = index.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(send.value), np.int64)
        for b in batches:
            for data in b.column(0):
                for k, first, stop in _found(data.as_py(), send.value):
                    n[k] += stop - first
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # as many rows as the chunk has terms
        out[r["term"]] = r["n"]
    return out


class Treap:
    """A term's postings in a block: documents ascend from left to right, impacts descend from the root. A subtree is a range of
    postings, and its root the posting of the largest impact in it, the middle one of several."""

    __slots__ = ("docs", "impact", "made")

    def __init__(self, docs: np.ndarray, impact: np.ndarray):
        self.docs, self.impact, self.made = docs, impact, {}

    def root(self, lo: int, hi: int) -> tuple[int, int, int]:
        """(place, document, impact) of the root of the subtree of postings lo to hi."""
        got = self.made.get((lo, hi))
        if got is None:
            part = self.impact[lo:hi]
            top = part.max()
            at = np.flatnonzero(part == top)
            k = lo + int(at[len(at) // 2])
            got = self.made[lo, hi] = (k, int(self.docs[k]), int(top))
        return got

    def within(self, lo: int, hi: int, a: int, b: int) -> tuple[int, int, int, int] | None:
        """(lo, hi, document, impact) of the lowest subtree that has all its parent's postings of documents a to b."""
        while lo < hi:
            k, doc, impact = self.root(lo, hi)
            if doc < a:
                lo = k + 1
            elif doc >= b:
                hi = k
            else:
                return lo, hi, doc, impact
        return None


class Best:
    """The k best (score, doc_id) so far: higher scores first, then smaller doc_ids."""

    __slots__ = ("k", "rows")

    def __init__(self, k: int):
        self.k, self.rows = k, []  # (-score, doc_id), ascending

    def add(self, scores: list[int], ids: list[int]) -> None:
        self.rows = heapq.nsmallest(self.k, [*self.rows, *zip([-s for s in scores], ids)])

    def hopeless(self, bound: int, first_id: int) -> bool:
        """Whether documents from first_id on, with scores up to bound, cannot enter."""
        return bound <= 0 or len(self.rows) == self.k and (-bound, first_id) >= self.rows[-1]


def traverse(treaps: list[Treap], ids: list[int], best: Best, leaf: int = LEAF) -> None:
    """Brings the best documents of a block into `best`. `ids` are the doc_ids of the block's documents, in ascending order."""
    n = len(ids)
    open_: list[tuple[int, int, int, list]] = []

    def push(a: int, b: int, parts: Iterable[tuple[Treap, int, int]]) -> None:
        if a >= b:
            return
        nodes = [(t, *w) for t, lo, hi in parts if (w := t.within(lo, hi, a, b)) is not None]
        bound = sum(x[4] for x in nodes)
        if not best.hopeless(bound, ids[a]):
            heapq.heappush(open_, (-bound, a, b, nodes))

    push(0, n, ((t, 0, len(t.docs)) for t in treaps))
    while open_:
        bound, a, b, nodes = heapq.heappop(open_)
        if best.hopeless(-bound, ids[a]):
            continue
        if sum(x[2] - x[1] for x in nodes) <= leaf:
            total = np.zeros(b - a, np.int64)
            for t, lo, hi, _, _ in nodes:
                docs = t.docs[lo:hi]
                i, j = np.searchsorted(docs, (a, b))
                total[docs[i:j] - a] += t.impact[lo + i : lo + j]
            least = max(1, -best.rows[-1][0]) if len(best.rows) == best.k else 1
            at = np.flatnonzero(total >= least)
            if len(at) > best.k:  # documents ascend, so of equal scores the first stay
                at = at[np.argsort(-total[at], kind="stable")[: best.k]]
            if len(at):
                best.add(total[at].tolist(), [ids[a + k] for k in at.tolist()])
            continue
        d = max(nodes, key=lambda x: x[4])[3]
        score = 0
        for t, lo, hi, doc, impact in nodes:
            if doc == d:
                score += impact
            else:
                k = lo + int(np.searchsorted(t.docs[lo:hi], d))
                if k < hi and t.docs[k] == d:
                    score += int(t.impact[k])
        best.add([score], [ids[d]])
        push(a, d, (x[:3] for x in nodes))
        push(d + 1, b, (x[:3] for x in nodes))


def _chunks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items with their distinct terms, in chunks of about `most` bytes of text."""
    part, size = [], 0
    for r in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        if found := sorted(set(terms(r[1] or ""))):
            part.append((r[0], found))
            size += len(r[1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _search(index: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int, all_docs: int, all_terms: int, leaf: int) -> DataFrame:
    spark = index.sparkSession
    wanted: dict[bytes, int] = {}
    asked = [[wanted.setdefault(t, len(wanted)) for t in found] for _, found in items]
    df = document_counts(index, wanted)
    weight = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    send = spark.sparkContext.broadcast((wanted, asked, weight, [i for i, _ in items]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, asked, weight, names = send.value
        best = [Best(k) for _ in asked]
        for batch in batches:
            for row in range(batch.num_rows):
                docs, words, posts = (batch.column(c)[row].as_py() for c in range(3))
                has, ids, sizes = unpack_arrays(docs)
                ids = [i if h else _LAST for h, i in zip(has.tolist(), ids.astype(np.uint64).view(np.int64).tolist())]
                m = 10 + 90 * sizes.astype(np.int64) * all_docs // max(1, all_terms)
                doc, tf = unpack_arrays(posts)
                treaps = {}
                for t, first, stop in _found(words, wanted):
                    if weight[t] > 0:
                        d, n = doc[first:stop].astype(np.int64), tf[first:stop].astype(np.int64)
                        treaps[t] = Treap(d, weight[t] * (1_000_000_000 * n // (1000 * n + 8 * m[d])))
                for own, item in zip(best, asked):
                    if found := [treaps[t] for t in item if t in treaps]:
                        traverse(found, ids, own, leaf)
        rows = [(q, names[q], None if i == _LAST else i, -s) for q, own in enumerate(best) for s, i in own.rows]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 10_000])], ["item", "item_id", "doc_id", "score"])
        release()

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = index.select("docs", "terms", "posts").mapInArrow(run, "item long, item_id long, doc_id long, score long").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: DataFrame, items: DataFrame, k: int = 10, chunk_bytes: int = CHUNK_BYTES, leaf: int = LEAF) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k best documents of the index for each row of `items(item_id, text)`."""
    n = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    out = None
    for chunk in _chunks(items, chunk_bytes):
        found = _search(index, chunk, k, n["docs"] or 0, n["terms"] or 0, leaf)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else index.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
    WITH words AS (
        SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
    ), totals AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM words),
    held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM words) GROUP BY r, term),
    asked AS (
        SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT item_id, text, row_number() OVER () AS i FROM benchmark)
    ), weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM held GROUP BY term), totals),
    lengths AS (SELECT r, doc_id, 10 + (90 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM words, totals WHERE len(ts) > 0),
    scored AS (
        SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
        FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN lengths USING (r) GROUP BY i, item_id, doc_id, r
    ), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
