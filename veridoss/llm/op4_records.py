"""Token ids in length-delimited binary records with masked checksums and an offset index.

A shard file is MAGIC, the width of an id in bytes, three zero bytes, and then records:

    u64 payload length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of it

The payload is u8 (1: the id is null), i64 document id, and the token ids, u16 or u32 by the
vocabulary's size. All numbers are little-endian. A checksum is masked by rotating it right by
15 bits and adding a constant, so that a checksum of data holding checksums stays sound.
Beside each shard lies an index: for each record u64 offset, u64 tokens before it in the shard,
u32 tokens - enough to read records in any order with one seek each.

Documents are range-partitioned by id, so shards follow one another in ascending order. A
task writes to a name of its own attempt and only the name in its result row is used later:
a lost executor or a second attempt leaves an unused file, never a mixed one.

Defined results. Null or empty text: the end id alone. Null ids come first. Repeated rows are
written as often as they occur, by text. Very long texts are encoded a stretch at a time and written whole.
An empty table writes no record. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.shared import bounded_batches, id_buckets, keep, new_path, trimmed
from veridoss.llm.tokens import encoder

MAGIC = b"VDRC"
END_ID = 2
_MASK = 0xA282EAD8
_INDEX = np.dtype([("offset", "<u8"), ("before", "<u8"), ("tokens", "<u4")])


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def payload_of(doc_id: int | None, ids: bytes) -> bytes:
    return struct.pack("<Bq", doc_id is None, doc_id or 0) + ids


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_frame(source) -> bytes | None:
    """The next record's payload, both checksums verified; None at the end of the file."""
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("a record's length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = source.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:n]


def split_payload(payload: bytes, width: int) -> tuple[int | None, np.ndarray]:
    null, doc = struct.unpack_from("<Bq", payload)
    return (None if null else doc), np.frombuffer(payload, f"<u{width}", offset=9)


def read_at(path: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number, through the index: a shuffled read."""
    fs, name = _fs(path)
    with fs.open_input_file(name + ".idx") as f:
        f.seek(number * _INDEX.itemsize)
        entry = np.frombuffer(f.read(_INDEX.itemsize), _INDEX)[0]
    with fs.open_input_file(name) as f:
        width = f.read(8)[4]
        f.seek(int(entry["offset"]))
        return split_payload(read_frame(f), width)


def write_records(spark: SparkSession, docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards and indexes below path; a table of shards: shard, file, records, tokens."""
    bounded_batches(spark)
    path = path or new_path(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket, n = id_buckets(rows, F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), n)
    dealt = rows.repartitionById(n, bucket.cast("int")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        shard = TaskContext.get().partitionId()
        file = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.rec"
        fs, name = _fs(file)
        out, index, at, tokens = None, [], 8, 0
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                if out is None:
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(name, buffer_size=1 << 20)
                    out.write(MAGIC + bytes([width, 0, 0, 0]))
                ids = body.tobytes() + end
                record = frame(payload_of(doc, ids))
                out.write(record)
                index.append((at, tokens, len(ids) // width))
                at += len(record)
                tokens += len(ids) // width
        if out is None:
            return
        out.close()
        with fs.open_output_stream(name + ".idx") as f:
            f.write(np.array(index, _INDEX).tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [file], "records": pa.array([len(index)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return keep(spark, dealt.mapInArrow(trimmed(write), "shard int, file string, records long, tokens long"), "shards")


def read_records(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """Every record of the shards, in global token positions; checks frames and indexes."""
    rows = sorted((r.shard, r.file, r.tokens) for r in shards.collect())  # one row a shard
    at, placed = 0, []
    for _, file, tokens in rows:
        placed.append((file, at))
        at += tokens
    todo = spark.createDataFrame(placed, "file string, at long").repartition(max(1, len(placed)), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _fs(file)
                with fs.open_input_file(name + ".idx") as f:
                    index = np.frombuffer(f.read(), _INDEX)
                out: list[tuple] = []
                with fs.open_input_stream(name, buffer_size=1 << 20) as f:
                    head = f.read(8)
                    if head[:4] != MAGIC:
                        raise ValueError(f"{file} is no record file")
                    place = 8
                    for k, entry in enumerate(index):
                        payload = read_frame(f)
                        doc, ids = split_payload(payload, head[4])
                        if entry["offset"] != place or entry["tokens"] != len(ids):
                            raise ValueError(f"{file}: the index disagrees at record {k}")
                        place += len(payload) + 16
                        out.append((doc, start + int(entry["before"]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(out) == 5000 or k == len(index) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            out = []

    return todo.mapInArrow(trimmed(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
