"""Token ids as length-delimited binary records with a separate offset index.

A shard `shard-NNNNN.rec` is a row of frames, each

    u64 length | u32 masked CRC of these 8 bytes | payload | u32 masked CRC of the payload

all little-endian, with CRC-32 and the usual mask (rotate right by 15, add 0xA282EAD8). The payload is

    u8 has_id | i64 doc_id | u8 bytes per id | ids (little-endian, unsigned)

`shard-NNNNN.idx` has one entry `u64 offset of the frame | u32 number of ids` for each record,
so that a reader can seek to any record without reading those before it.

Rows: null text counts as empty and gives a record with the end id alone. Null doc_ids come first and are kept as
null. Rows that share a doc_id follow one another by a hash of the text and may lie in several shards. Extra columns are ignored. Empty tables give no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import n_partitions, new_dir, slices, texts_of, word_encoder
from pagelens.storage import file_system

_MASK, _HEAD, _ENTRY = 0xA282EAD8, struct.Struct("<BqB"), np.dtype([("offset", "<u8"), ("n", "<u4")])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(read) -> Iterator[bytes]:
    """The payloads of a stream of frames; `read(n)` gives up to n bytes. Broken frames raise ValueError."""
    while size := read(8):
        if len(size) < 8 or struct.pack("<I", masked_crc(size)) != read(4):
            raise ValueError("a frame's length is damaged")
        n = struct.unpack("<Q", size)[0]
        payload = read(n)
        if len(payload) < n or struct.pack("<I", masked_crc(payload)) != read(4):
            raise ValueError("a frame's payload is damaged")
        yield payload


def pack_record(doc_id: int | None, ids: np.ndarray) -> bytes:
    return _HEAD.pack(doc_id is not None, doc_id or 0, ids.dtype.itemsize) + ids.tobytes()


def unpack_record(payload: bytes) -> tuple[int | None, np.ndarray]:
    has, doc_id, width = _HEAD.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload, f"<u{width}", offset=_HEAD.size)


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int) -> list[tuple[int, int, int]]:
    """Encodes `docs(doc_id, text)` into shards under `out`, in ascending doc_id order over all shards.

    Returns (shard, records, ids) for each shard that holds records: as many entries as there are partitions.
    A shard gets its final name only when it is whole, and its bytes depend on its rows alone, so that
    repeated and speculative attempts agree.
    """
    spark = docs.sparkSession
    _, path = file_system(out)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(out)
        shard, enc = TaskContext.get().partitionId(), word_encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        final, tmp = f"{path}/shard-{shard:05d}", f"{path}/_tmp-{shard}-{uuid.uuid4().hex}"
        entries: list[tuple[int, int]] = []
        at = n_ids = 0
        sink = None
        for b in slices(batches):
            if sink is None:
                fs.create_dir(path, recursive=True)
                sink = fs.open_output_stream(tmp + ".rec", buffer_size=1 << 20)
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(texts_of(b))):
                ids = np.concatenate((ids, end))
                entries.append((at, len(ids)))
                n_ids += len(ids)
                at += sink.write(f := frame(pack_record(doc_id, ids))) or len(f)
        if sink is None:
            return
        sink.close()
        with fs.open_output_stream(tmp + ".idx") as f:
            f.write(np.array(entries, _ENTRY).tobytes())
        fs.move(tmp + ".idx", final + ".idx")
        fs.move(tmp + ".rec", final + ".rec")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "records": pa.array([len(entries)], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(n_partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .mapInArrow(write, "shard int, records long, ids long")
    )
    return sorted((r.shard, r.records, r.ids) for r in rows.collect())


def scan_shard(out: str, shard: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """All records of a shard in order, with their checksums verified."""
    fs, path = file_system(out)
    with fs.open_input_stream(f"{path}/shard-{shard:05d}.rec", buffer_size=1 << 20) as f:
        yield from map(unpack_record, unframe(f.read))


def read_shuffled(out: str, shard: int, order: Iterable[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of a shard at the given places of its index, in the order asked for."""
    fs, path = file_system(out)
    with fs.open_input_stream(f"{path}/shard-{shard:05d}.idx") as f:
        entries = np.frombuffer(f.read(), _ENTRY)
    with fs.open_input_file(f"{path}/shard-{shard:05d}.rec") as f:
        for k in order:
            f.seek(int(entries["offset"][k]))
            yield unpack_record(next(unframe(f.read)))


def read_records(spark, out: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of every record, from the files; a task reads one shard as a stream."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc_id, ids in scan_shard(out, shard):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    starts = np.cumsum([0, *(n for _, _, n in shards)]).tolist()
    parts = spark.createDataFrame([(s, a) for (s, _, _), a in zip(shards, starts)], "shard int, start long")
    return parts.repartition(max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_records(docs: DataFrame, tokenizer: str, end_id: int, out: str | None = None) -> DataFrame:
    """Writes the records of `docs` and returns what their files hold. They stay in the folder `out`, or where none is named lie in
    shared storage until the driver ends."""
    out = out or new_dir(docs.sparkSession, "records")
    return read_records(docs.sparkSession, out, write_records(docs, out, tokenizer, end_id))


