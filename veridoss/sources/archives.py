"""npz and zip archives as data sources: partitions are ranges of rows or members, planned from headers alone.

The driver reads an archive's directory and an array's header; tasks read their own byte ranges. Paths are
those of a folder that executors share, or addresses that pyarrow's file systems open.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 65_536  # of an array a task
BYTES = 64 << 20  # of packed members a task
BATCH = 4_096


def local(path: str) -> str | None:
    """The path in the mounted file system, if it is one."""
    return re.sub("^file:(//)?", "", path) if path.startswith("file:") or "://" not in path else None


def _remote(path: str):
    from pyarrow import fs  # starts threads of its own, so only where it is needed

    return fs.FileSystem.from_uri(path)


@contextmanager
def opened(path: str):
    if name := local(path):
        with open(name, "rb") as f:
            yield f
        return
    system, name = _remote(path)
    with system.open_input_file(name) as f:
        yield f


def listed(path: str, suffix: str) -> list[str]:
    """Files with a suffix at or below a path, in order of name."""
    if name := local(path):
        return [path] if os.path.isfile(name) else sorted(os.path.join(d, f) for d, _, names in os.walk(name) for f in names if f.endswith(suffix))
    from pyarrow import fs

    system, name = _remote(path)
    if system.get_file_info(name).type == fs.FileType.File:
        return [path]
    scheme = path[: path.index("://") + 3]
    return sorted(scheme + x.path for x in system.get_file_info(fs.FileSelector(name, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(suffix))


def put(path: str, body: bytes) -> None:
    """Write a file beside its place and rename it: no reader sees half of one."""
    beside = f"{path[: path.rindex('/')]}/.{uuid.uuid4().hex}"
    if name := local(path):
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(local(beside), "wb") as f:
            f.write(body)
        os.replace(local(beside), name)
        return
    system, name = _remote(path)
    aside = _remote(beside)[1]
    system.create_dir(name[: name.rindex("/")])
    with system.open_output_stream(aside) as out:
        out.write(body)
    system.move(aside, name)


def data_offset(f, info: zipfile.ZipInfo) -> int:
    """Where a member's bytes begin: behind its local header, whose name and extra field have their own lengths."""
    f.seek(info.header_offset)
    head = f.read(30)
    name, extra = struct.unpack("<HH", head[26:30])
    return info.header_offset + 30 + name + extra


@dataclass
class Array:
    """A stored array of an archive: shape, type and the place of its first row."""

    shape: tuple[int, ...]
    dtype: np.dtype
    at: int
    stored: bool  # neither packed nor in columns, so that rows are byte ranges

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def array_header(path: str, member: str) -> Array:
    """From the archive's directory and the member's first bytes."""
    with opened(path) as f, zipfile.ZipFile(f) as z:
        try:
            info = z.getinfo(member)
        except KeyError:
            raise ValueError(f"the archive lacks {member}: {path}") from None
        with z.open(member) as m:
            version = npy.read_magic(m)
            shape, columns, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(m)
            head = m.tell()
        packed = info.compress_type != zipfile.ZIP_STORED
        return Array(shape, dtype, 0 if packed else data_offset(f, info) + head, not (packed or columns and len(shape) > 1 or dtype.hasobject))


def rows_of(path: str, member: str, array: Array, start: int, stop: int) -> np.ndarray:
    """Rows start to stop; a packed member is unpacked up to there."""
    if array.stored:
        with opened(path) as f:
            f.seek(array.at + start * array.row_bytes)
            return np.frombuffer(f.read((stop - start) * array.row_bytes), array.dtype).reshape(stop - start, *array.shape[1:])
    with opened(path) as f, zipfile.ZipFile(f) as z, z.open(member) as m:
        return npy.read_array(m, allow_pickle=False)[start:stop]


@dataclass
class Rows(InputPartition):
    path: str
    vectors: Array
    ids: Array
    start: int
    stop: int


class NpzReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.method = options["path"], options.get("method")
        self.vectors, self.ids = options.get("vectors", "emb") + ".npy", options.get("ids", "review_id") + ".npy"
        self.rows = int(options.get("rowspertask") or options.get("rowsPerTask") or ROWS)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path, ".npz"):
            vectors, ids = array_header(path, self.vectors), array_header(path, self.ids)
            if vectors.shape[0] != ids.shape[0]:
                raise ValueError(f"ids and vectors differ in number: {path}")
            if self.method is not None:
                found = _method(path)
                if found != self.method:
                    raise ValueError(f"embedding method is {found}, not {self.method}: {path}")
            step = self.rows if vectors.stored and ids.stored else max(1, vectors.shape[0])
            out += [Rows(path, vectors, ids, at, min(vectors.shape[0], at + step)) for at in range(0, vectors.shape[0], step)]
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(part, Rows):
            return
        step = BATCH if part.vectors.stored else part.stop - part.start
        for at in range(part.start, part.stop, step):
            end = min(part.stop, at + step)
            ids = rows_of(part.path, self.ids, part.ids, at, end).astype(str)
            flat = rows_of(part.path, self.vectors, part.vectors, at, end).astype("float32")
            width = flat.shape[1] if flat.ndim > 1 else 1
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) * width + 1, width, dtype=np.int32)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(ids)), pa.array(ids.tolist(), pa.string()), pa.array(range(at, end), pa.int64()), lists], names=["file", "review_id", "position", "embedding"])


def _method(path: str) -> str:
    with opened(path) as f, zipfile.ZipFile(f) as z, z.open("method.npy") as m:
        return str(npy.read_array(m, allow_pickle=False))


class NpzSource(DataSource):
    """Rows of npz archives: options path, method, vectors, ids, rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "npz_rows"

    def schema(self) -> str:
        return "file string, review_id string, position bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options)


@dataclass
class File(InputPartition):
    path: str


class NpzHeaderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [File(p) for p in listed(self.path, ".npz")] or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if isinstance(part, File):
            with opened(part.path) as f, zipfile.ZipFile(f) as z:
                names = [n for n in z.namelist() if n.endswith(".npy")]
            for n in names:
                array = array_header(part.path, n)
                yield part.path, n.removesuffix(".npy"), [int(k) for k in array.shape], array.dtype.str


class NpzHeaders(DataSource):
    """Members of npz archives with shape and type; no array is read."""

    @classmethod
    def name(cls) -> str:
        return "npz_headers"

    def schema(self) -> str:
        return "file string, member string, shape array<bigint>, dtype string"

    def reader(self, schema) -> DataSourceReader:
        return NpzHeaderReader(self.options)


@dataclass
class Members(InputPartition):
    path: str
    members: list[tuple[str, int, int, int, int]]  # name, place of the header, packed size, method, check sum


class ZipReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.bytes = int(options.get("bytespertask") or options.get("bytesPerTask") or BYTES)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in listed(self.path, ".zip"):
            with opened(path) as f, zipfile.ZipFile(f) as z:
                infos = sorted((i for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)), key=lambda i: i.header_offset)
            held, size = [], 0
            for i in infos:
                if i.flag_bits & 1 or i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{i.filename} of {path} is locked or packed in another way")
                if held and size + i.compress_size > self.bytes:
                    out.append(Members(path, held))
                    held, size = [], 0
                held.append((i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC))
                size += i.compress_size
            if held:
                out.append(Members(path, held))
        return out or [InputPartition(None)]

    def read(self, part: InputPartition) -> Iterator[tuple]:
        if not isinstance(part, Members):
            return
        with opened(part.path) as f:
            for name, header, size, method, crc in part.members:
                info = zipfile.ZipInfo(name)
                info.header_offset = header
                f.seek(data_offset(f, info))
                body = f.read(size)
                if method == zipfile.ZIP_DEFLATED:
                    body = zlib.decompress(body, -15)
                if zlib.crc32(body) != crc:
                    raise ValueError(f"{name} of {part.path} is damaged")
                yield part.path, name, body


class ZipSource(DataSource):
    """Members of zip archives: options path, suffix, bytesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, name string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], path: str, **options: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(path=path, **options).load()


def npz_rows(spark: SparkSession, path: str, method: str | None = None, rows_per_task: int = ROWS) -> DataFrame:
    """(file, review_id, position in the file, embedding) of one npz archive or all below a folder."""
    return _load(spark, NpzSource, path, rowsPerTask=str(rows_per_task), **({"method": method} if method else {}))


def npz_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, member, shape, dtype) of every array."""
    return _load(spark, NpzHeaders, path)


def zip_members(spark: SparkSession, path: str, suffix: str = "", bytes_per_task: int = BYTES) -> DataFrame:
    """(archive, name, content) of members whose name ends in suffix, of one archive or all below a folder."""
    return _load(spark, ZipSource, path, suffix=suffix, bytesPerTask=str(bytes_per_task))
