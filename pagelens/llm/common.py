"""What the operators of this subpackage share: shared storage, tokenizers, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.storage import spread  # noqa: F401 - entries and the pipeline take it from here

#: The characters that separate words, as a class of regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that no column of `df` has in any case, in which Spark compares names."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col):
    """Lower-cases A-Z and leaves all other letters. Texts of one byte a character take the quick way."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset on a single machine one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='pagelens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may have ended first
        pass


def new_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder in shared storage; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/pagelens-{what}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to shared storage and read again: later stages start from the files, also after executors are lost."""
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pagelens_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that written() made and nothing reads any more."""
    delete(df.sparkSession, df._pagelens_path)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that few texts are Python objects at a time. At the end of a task a worker that lives on gives free memory back, for executors count it as theirs."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
    release()


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only the GNU C library has it
        pass


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: bytes that print stand for themselves, the rest follow from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts by a tokenizer whose pre-tokens never span white space.

    Such a tokenizer gives a text the ids of its white-space separated words one after another,
    so each distinct word is encoded once and remembered. At `limit` words the memory starts anew; words that
    occur again then come over from the last one, so that frequent words stay.
    Words of plain Latin letters with full stops or commas behind go straight to the BPE model,
    where the tokenizer is found to lower-case and to split them as expected; all others take the whole way.
    """

    _PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00DE\u00DF-\u00F6\u00F8-\u00FF]*)([.,]*)")

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.bytes = byte_letters()
        self.stops: dict[str, bytes] = {}
        model = self.tok.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # every word comes once, so the model's own memory only costs
        self.tokenize = model.tokenize
        self.direct = True
        for probe in ("Hello", "\u00c9t\u00e9,", "stra\u00dfe...", "\u00c0\u00de\u00ff.,", "."):
            self.direct = self.direct and self._direct(probe) == self._whole([probe])[0]

    def _direct(self, word: str) -> bytes | None:
        if word.isascii() and word.isalpha():
            return self._plain(word.lower())
        m = self._PLAIN.fullmatch(word)
        if m is None:
            return None
        part, stops = m.groups()
        part = part.lower()
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(self.bytes)
        ids = self._plain(part) if part else b""
        if stops:
            if stops not in self.stops:
                self.stops[stops] = self._plain(stops)
            ids += self.stops[stops]
        return ids

    def _plain(self, part: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenize(part)]).tobytes()

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, new: set[str]) -> None:
        if len(self.known) > self.limit:
            self.known, self.old = {}, self.known
        known, old, rest = self.known, self.old, []
        for w in new - known.keys():
            got = old.get(w)
            if got is None:
                got = self._direct(w) if self.direct else None
            if got is None:
                rest.append(w)
            else:
                known[w] = got
        for k in range(0, len(rest), 10_000):
            known.update(zip(rest[k : k + 10_000], self._whole(rest[k : k + 10_000])))

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Yields the ids of each text in order."""
        for group in _groups(texts, 4_000_000):
            words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in group]
            self.learn(set().union(*words))
            find = self.known.__getitem__
            for ws in words:
                yield np.frombuffer(b"".join(map(find, ws)), self.dtype)


def _groups(texts: Iterable[str], n_chars: int) -> Iterator[list[str]]:
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= n_chars:
            yield group
            group, n = [], 0
    if group:
        yield group


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker; workers that live on keep what they know."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Where the file of a public tokenizer lies; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
