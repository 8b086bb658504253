"""Token counts without token ids.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each by itself, so a document has as many tokens as
its pre-tokens have pieces. Documents are read in blocks. A block gives one row for each distinct pre-token in it, with
the frequencies of that pre-token in the block's documents. One shuffle on the pre-token brings the rows of a pre-token
together: its pieces are counted once, joined to all its frequencies and summed for each document of each block. A last
shuffle adds up the sums of a block. No ids are made beyond those of the distinct pre-tokens. A block's pre-tokens go
into buckets by a checksum and travel packed, a row for each bucket, so that millions of short rows cost no more than
their bytes.

Rows: null text counts as empty and has no bytes and no tokens. Rows that share a doc_id, and null doc_ids, are rows of
their own. Extra columns are ignored. Empty tables give no rows. A special string inside a text is one token, as the
library has it by default.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import byte_letters, n_partitions, slices, texts_of

#: Fixed value: the public byte-level pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text in a block, and buckets of pre-tokens for each shuffle partition.
BLOCK_CHARS, SPREAD = 24_000_000, 8
_FIELDS = "bucket int, block long, head boolean, data binary"


class PreTokens:
    """Pre-tokens of texts, and pieces of pre-tokens, as the tokenizer in a file has them."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("a byte-level tokenizer that splits by the public pattern is needed")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.letters = byte_letters()
        self.find = regex.compile(PATTERN).findall
        # letters and marks that all versions of Unicode know alike; any other text is cut by the library
        self.usual = regex.compile(r"[\x00-\u036f\u0384-\u0481\u2000-\u2064\u20a0-\u20bf\u2190-\u21ff]*+").fullmatch

    def of(self, text: str) -> list[str]:
        """The pre-tokens of a text, added tokens among them as they are."""
        parts = [text]
        for t in self.added:
            parts = [x for p in parts for x in ([p] if p in self.added else self._cut(p, t))]
        out: list[str] = []
        for p in parts:
            if p in self.added:
                out.append(p)
            elif self.usual(p):
                out += self.find(p)
            else:
                out += [p[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(p)]
        return out

    @staticmethod
    def _cut(text: str, token: str) -> list[str]:
        if token not in text:
            return [text]
        out: list[str] = []
        for k, p in enumerate(text.split(token)):
            out += ([token] if k else []) + ([p] if p else [])
        return out

    def pieces(self, key: str) -> int:
        """How many tokens a pre-token has: the model gets its bytes as the letters that stand for them."""
        if key in self.added:
            return 1
        if key.isascii() and key[1:].isalnum():
            key = key.replace(" ", "\u0120")
        else:
            key = key.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return len(self.tok.model.tokenize(key))


_PRE: dict[str, PreTokens] = {}


def _pre(path: str) -> PreTokens:
    if path not in _PRE:
        _PRE[path] = PreTokens(path)
    return _PRE[path]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers in one string of bytes: for each its width and length, then all of them, each as narrow as its values allow."""
    head, body = [], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        a = a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")
        head += [a.dtype.itemsize, len(a)]
        body.append(a.tobytes())
    return np.array([len(arrays), *head], "<u4").tobytes() + b"".join(body)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head = np.frombuffer(data, "<u4", 2 * n, 4).reshape(n, 2).tolist()
    at, out = 4 + 8 * n, []
    for width, length in head:
        out.append(np.frombuffer(data, f"<u{width}", length, at))
        at += width * length
    return out


class _Block:
    """Documents in the making of a block: their pre-tokens as numbers."""

    def __init__(self):
        self.ids: list = []
        self.sizes: list[int] = []
        self.ends: list[int] = []
        self.number: dict[str, int] = {}
        self.flat = array("I")
        self.chars = 0

    def add(self, doc_id, text: str, words: list[str]) -> None:
        number = self.number
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.flat.extend([number.setdefault(w, len(number)) for w in words])
        self.ends.append(len(self.flat))
        self.chars += len(text)

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        """The block's documents, and for each bucket its pre-tokens with the documents they stand in and how often."""
        has = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64).view(np.uint64)
        yield block % buckets, block, True, pack_arrays(has, ids, np.array(self.sizes, np.uint64))
        if not self.number:
            return
        keys = [w.encode("utf-8", "surrogatepass") for w in self.number]
        bucket = np.fromiter((zlib.crc32(k) % buckets for k in keys), np.int64, len(keys))
        n = len(self.ids)
        doc = np.repeat(np.arange(n), np.diff([0, *self.ends]))
        by_key, freq = np.unique(np.frombuffer(self.flat, np.uint32).astype(np.int64) * n + doc, return_counts=True)
        key, doc = by_key // n, by_key % n
        edges = np.searchsorted(key, np.arange(len(keys) + 1))
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                uses = edges[own + 1] - edges[own]
                first = np.cumsum(uses) - uses
                at = np.arange(uses.sum()) + np.repeat(edges[own] - first, uses)
                words = [keys[k] for k in own]
                sizes = np.array([len(w) for w in words])
                yield b, block, False, pack_arrays(np.frombuffer(b"".join(words), np.uint8), sizes, uses, doc[at], freq[at])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["bucket", "block", "head", "data"])


def _in_batches(rows: Iterable[tuple], n: int = 64) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == n:
            yield _batch(part)
            part = []
    if part:
        yield _batch(part)


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[bool, bytes]]]]:
    """The rows of each block; rows come sorted by block."""
    block, rows = None, []
    for b in batches:
        for at, head, data in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))):
            if at != block and rows:
                yield block, rows
                rows = []
            block = at
            rows.append((head, data))
    if rows:
        yield block, rows


def _add(sums: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(docs):
        return sums
    got = np.bincount(docs.astype(np.int64), weights=counts)  # exact: sums stay far below 2 ** 53
    if len(got) > len(sums):
        sums, got = got, sums
    sums[: len(got)] += got
    return sums


def count_tokens(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`doc_id, n_bytes, n_tokens` for each row of `docs(doc_id, text)`."""
    parts = n_partitions(docs.sparkSession)
    buckets = SPREAD * parts

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, number, block = _pre(tokenizer), TaskContext.get().partitionId() << 32, _Block()
        for b in slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), texts_of(b)):
                block.add(doc_id, text, pre.of(text))
                if block.chars >= block_chars:
                    yield from _in_batches(block.rows(number, buckets))
                    number, block = number + 1, _Block()
        if block.ids:
            yield from _in_batches(block.rows(number, buckets))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of pieces for each document of each block, over the pre-tokens of this partition."""
        pre, known = _pre(tokenizer), {}
        for block, rows in _by_block(batches):
            sums = np.zeros(0)
            for head, data in rows:
                if head:
                    yield _batch([(0, block, True, data)])
                    continue
                text, sizes, uses, doc, freq = unpack_arrays(data)
                raw, ends = text.tobytes(), np.cumsum(sizes, dtype=np.int64).tolist()
                pieces, a = [], 0
                for e in ends:
                    key = raw[a:e]
                    n = known.get(key)
                    if n is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        n = known[key] = pre.pieces(key.decode("utf-8", "surrogatepass"))
                    pieces.append(n)
                    a = e
                sums = _add(sums, doc, np.repeat(pieces, uses) * freq.astype(np.float64))
            at = np.flatnonzero(sums)
            yield _batch([(0, block, False, pack_arrays(at, sums[at].astype(np.uint64)))])

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_block(batches):
            sums = np.zeros(0)
            for head, data in rows:
                if head:
                    has, ids, sizes = unpack_arrays(data)
                else:
                    sums = _add(sums, *unpack_arrays(data))
            n = len(has)
            out = np.zeros(n, np.int64)
            out[: len(sums)] = sums.astype(np.int64)
            ids, sizes = (x.astype(np.uint64).view(np.int64) for x in (ids, sizes))
            for a in range(0, n, 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 10_000], mask=has[a : a + 10_000] == 0), pa.array(sizes[a : a + 10_000]), pa.array(out[a : a + 10_000])], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, _FIELDS)
    by_key = rows.repartition(parts, "bucket").sortWithinPartitions("block").mapInArrow(count, _FIELDS)
    return by_key.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(total, "doc_id long, n_bytes long, n_tokens long")
