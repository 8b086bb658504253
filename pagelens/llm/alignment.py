"""How the tokens of two tokenizers lie over the same bytes.

Both tokenizers cut the same bytes: a space and the text. Tokenizer A is a byte-level BPE, B a piece model that adds the space
itself. The tokens of B are intervals in ascending order, a static index; each token of A finds by two bisections which of them
overlap it (the first that ends after its start, and the last that starts before its end). A gap between two tokens of A that
no token of B spans is a group boundary. This runs over the tokens of many documents at once, one text behind the other.

What pairs of ids are linked, and in how many documents, is counted over all documents. Documents are read in blocks; a block
keeps, for each of its distinct pairs, in which of its documents it occurs and how often, and sends one row for each distinct
pair. Pairs are summed and compared with the best of their A id by plain aggregates and joins; then the counts come back to
their blocks, where each document sums them. So a pair that all documents hold has one row for each block.

Rows: texts that are null or empty, or whose bytes B does not give back (such as those with U+2581), have no tokens: all
counts are 0 and the digest is ''. Special tokens' strings are plain text. Rows that share a doc_id, and null doc_ids, are rows
of their own. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import n_partitions, release, slices, texts_of, written
from pagelens.llm.tokencount import PreTokens, pack_arrays, unpack_arrays

#: Characters of text in a block, and of texts that are aligned at once.
BLOCK_CHARS, GROUP_CHARS = 24_000_000, 1_000_000
#: Parts of texts that are remembered, and the longest of them.
KNOWN, LONGEST = 400_000, 64


class _Remembered:
    """Ids of parts of texts; the most recent `KNOWN` to twice as many are remembered."""

    def __init__(self):
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            got = self.old.get(part)
            if got is None:
                got = self.encode(part)
            if len(part) <= LONGEST:
                if len(self.known) >= KNOWN:
                    self.known, self.old = {}, self.known
                self.known[part] = got
        return got

    def encode(self, part: str) -> bytes:
        raise NotImplementedError

    def of(self, full: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids, self.parts(full))), np.uint32)


class ByteLevel(_Remembered):
    """Tokens of a byte-level BPE, by its pre-tokens."""

    def __init__(self, path: str):
        super().__init__()
        pre = PreTokens(path)
        pre.added = []  # their strings are plain text here
        self.parts, self.letters, self.model = pre.of, pre.letters, pre.tok.model
        back = {c: b for b, c in self.letters.items()}
        n = pre.tok.get_vocab_size()
        tokens = [pre.tok.id_to_token(k) or "" for k in range(n)]
        self.bytes = [bytes(back.get(c, 63) for c in t) for t in tokens]
        self.size = np.array([len(b) for b in self.bytes], np.int64)

    def encode(self, part: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()


class Pieces(_Remembered):
    """Tokens of a piece model that puts a space before a text. Where no piece holds a space behind another character, merges
    never pass from one word to the next, so words are encoded one by one; else whole texts are."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        import regex

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        by_word = not any("▁" in p.lstrip("▁") for p in names) and self._whole("a b") == self._whole("a") + self._whole("b")
        self.parts = regex.compile(" +[^ ]*").findall if by_word else lambda full: [full]

    def _whole(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def encode(self, part: str) -> bytes:
        if part.strip(" ") or len(part) > 1:
            ids = self._whole(part[1:])
        else:  # a lone space behind a word: by itself it would be nothing
            ids = self._whole("a" + part)[len(self._whole("a")) :]
        return array("I", ids).tobytes()

    def gives_back(self, ids: np.ndarray, full: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == full


_MODELS: dict[tuple[type, str], _Remembered] = {}


def _model(kind: type, path: str):
    if (kind, path) not in _MODELS:
        _MODELS[kind, path] = kind(path)
    return _MODELS[kind, path]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of A and B over the same bytes, given by their ends: the first and the last token of B (not included) that
    overlap each token of A."""
    a_start = np.concatenate(([0], a_end[:-1]))
    b_start = np.concatenate(([0], b_end[:-1]))
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")


def links(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of A, token of B) that overlap."""
    n = stop - first
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n - first, n)


def closes(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether a group ends with each token of A: no token of B spans the gap behind it."""
    out = np.ones(len(first), bool)
    out[:-1] = stop[:-1] <= first[1:]
    return out


class _Names:
    """Ids in decimal with the sign that follows them; the table is made once for each worker."""

    def __init__(self, n_a: int, n_b: int):
        self.text = [f"{k}{sign}" for n, signs in ((n_a, ",|"), (n_b, ",;")) for sign in signs for k in range(n)]
        self.n_a, self.n_b = n_a, n_b

    def digests(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, stop: np.ndarray, docs_a: np.ndarray) -> list[bytes]:
        """SHA-256 of the groups of each document; docs_a: how many tokens of A each has."""
        close_a = closes(first, stop)
        group_a = np.cumsum(close_a) - close_a
        close_b = np.zeros(len(b), bool)
        close_b[stop[close_a] - 1] = True
        group_b = np.cumsum(close_b) - close_b
        order = np.argsort(np.concatenate((group_a * 2, group_b * 2 + 1)), kind="stable")
        code = np.concatenate((a.astype(np.int64) + self.n_a * close_a, 2 * self.n_a + b.astype(np.int64) + self.n_b * close_b))[order].tolist()
        after_b = np.concatenate(([0], stop))[np.cumsum(docs_a)].tolist() if len(docs_a) else []
        out, at = [], 0
        for end_a, end_b in zip(np.cumsum(docs_a).tolist(), after_b):
            out.append(hashlib.sha256("".join(map(self.text.__getitem__, code[at : end_a + end_b]))[:-1].encode()).digest())
            at = end_a + end_b
        return out


class _Block:
    """Documents in the making of a block."""

    def __init__(self, a: ByteLevel, b: Pieces, names: _Names):
        self.a, self.b, self.names = a, b, names
        self.ids: list[int | None] = []
        self.n: list[tuple[int, int, int, int]] = []
        self.sha: list[bytes] = []
        self.codes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.wait: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.chars = self.waiting = 0

    def add(self, doc_id: int | None, text: str) -> None:
        k = len(self.ids)
        self.ids.append(doc_id)
        self.n.append((0, 0, 0, 0))
        self.sha.append(b"")
        self.chars += len(text) + 64
        if text:
            full = " " + text
            raw, a, b = full.encode(), self.a.of(full), self.b.of(full)
            if self.b.gives_back(b, raw) and int(self.a.size[a].sum()) == len(raw):
                self.wait.append((k, a, b))
                self.waiting += len(text)
                if self.waiting >= GROUP_CHARS:
                    self.align()

    def align(self) -> None:
        """Aligns the documents that wait, one text behind the other: ends of documents are ends of tokens of both."""
        if not self.wait:
            return
        docs, all_a, all_b = zip(*self.wait)
        self.wait, self.waiting = [], 0
        docs, a, b = np.array(docs), np.concatenate(all_a), np.concatenate(all_b)
        n_a, n_b = np.array([len(x) for x in all_a]), np.array([len(x) for x in all_b])
        first, stop = overlaps(np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b]))
        doc_of_a = np.repeat(np.arange(len(docs)), n_a)
        n_groups = np.bincount(doc_of_a, closes(first, stop), len(docs)).astype(np.int64)
        n_links = np.bincount(doc_of_a, stop - first, len(docs)).astype(np.int64)
        for k, *n, sha in zip(docs.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), self.names.digests(a, b, first, stop, n_a)):
            self.n[k], self.sha[k] = tuple(n), sha
        i, j = links(first, stop)
        self.codes.append(a[i].astype(np.int64) * len(self.b.size) + b[j])
        self.docs.append(docs[doc_of_a[i]])

    def row(self, block: int) -> pa.RecordBatch:
        """The block: its documents, its pairs in ascending order, and the documents of each pair with how often they hold it."""
        self.align()
        n = len(self.ids)
        code = np.concatenate([*self.codes, np.zeros(0, np.int64)])
        pair, freq = np.unique(code * n + np.concatenate([*self.docs, np.zeros(0, np.int64)]), return_counts=True)
        codes, uses = np.unique(pair // n, return_counts=True)
        has = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64).view(np.uint64)
        data = pack_arrays(has, ids, *np.array(self.n, np.int64).T, np.array([len(s) for s in self.sha]), np.frombuffer(b"".join(self.sha), np.uint8), codes, uses, pair % n, freq)
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack_arrays(codes, uses)]), pa.array([data])], ["block", "pairs", "data"])


def align(docs: DataFrame, byte_level: str, pieces: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256` for each row of `docs(doc_id, text)`."""
    parts = n_partitions(docs.sparkSession)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _model(ByteLevel, byte_level), _model(Pieces, pieces)
        names = _Names(len(a.size), len(b.size))
        number, block = TaskContext.get().partitionId() << 32, _Block(a, b, names)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                block.add(doc_id, text)
                if block.chars >= block_chars:
                    yield block.row(number)
                    number, block = number + 1, _Block(a, b, names)
        if block.ids:
            yield block.row(number)
        del block
        release()

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_b = len(_model(Pieces, pieces).size)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, uses = unpack_arrays(data.as_py())
                for at in range(0, len(codes), 20_000):
                    c = codes[at : at + 20_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), block)), pa.array(c), pa.array((c // n_b).astype(np.int32)), pa.array(uses[at : at + 20_000].astype(np.int64))], ["block", "code", "a", "n"])

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, code, n, best in _by_block(batches):
            yield from _results(data, code, n, best)
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = written(rows.mapInArrow(blocks, "block long, pairs binary, data binary"), "alignment")
    pairs = written(made.select("block", "pairs").mapInArrow(unpack, "block long, code long, a int, n long"), "pairs")
    counts = pairs.groupBy("code", "a").agg(F.sum("n").alias("n"))
    counts = written(counts, "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    judged = counts.join(top, "a").select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    back = pairs.select("block", "code").join(judged, "code").select("block", F.lit(1).alias("kind"), "code", "n", "best", F.lit(None).cast("binary").alias("data"))
    heads = made.select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("best"), "data")
    met = heads.unionByName(back).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(total, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, codes, counts, best) of each block; rows come sorted by block, its head first."""
    data, got = None, []

    def whole():
        return data, *(np.concatenate([x[k] for x in got]) if got else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, bool)))

    for batch in batches:
        heads = np.flatnonzero(batch.column(1).to_numpy() == 0).tolist()
        cuts = [0, *heads, batch.num_rows]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if i:  # from here on a new block
                if data is not None:
                    yield whole()
                data, got = batch.column(5)[a].as_py(), []
                a += 1
            if a < b:
                part = batch.slice(a, b - a)
                got.append((part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_numpy(zero_copy_only=False)))
    if data is not None:
        yield whole()


def _results(data: bytes, code: np.ndarray, n: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
    has, ids, *sizes, sha_len, sha, codes, uses, doc, freq = unpack_arrays(data)
    order = np.argsort(code)
    if not np.array_equal(code[order], codes.astype(np.int64)):
        raise ValueError("a block has not got the counts of its pairs")
    k, doc, freq = np.repeat(order, uses), doc.astype(np.int64), freq.astype(np.float64)
    n_docs = len(ids)
    n_best = np.bincount(doc, freq * best[k], n_docs).astype(np.int64)
    n = n[k]  # summed in two halves, each exact in doubles
    count_sum = np.bincount(doc, freq * (n & 0xFFFFF), n_docs).astype(np.int64) + (np.bincount(doc, freq * (n >> 20), n_docs).astype(np.int64) << 20)
    text, ends = sha.tobytes(), np.cumsum(sha_len, dtype=np.int64).tolist()
    digests = [text[a:b].hex() for a, b in zip([0, *ends], ends)]
    ids = pa.array(ids.astype(np.uint64).view(np.int64), mask=has == 0)
    cols = [ids, *(pa.array(s.astype(np.int64)) for s in sizes), pa.array(n_best), pa.array(count_sum), pa.array(digests)]
    out = pa.RecordBatch.from_arrays(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
    for a in range(0, n_docs, 10_000):
        yield out.slice(a, 10_000)
