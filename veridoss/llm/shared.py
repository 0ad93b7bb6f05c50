"""Shared-folder tables, small bounded reductions and Arrow helpers for the operators.

Every intermediate that is used twice is written as a table below the folder that the
cluster names in ``spark.checkpoint.dir``; a lost executor then costs a re-read, not a
recomputation of the lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application's own, below ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) does a temporary
    folder serve; on a cluster without the setting this raises.
    """
    bounded_batches(spark)
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="veridoss-")
        _ROOTS[app] = f"{base.rstrip('/')}/veridoss-{uuid.uuid4().hex}"
        atexit.register(_drop_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the JVM may already be gone at exit
        return


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep_at(spark: SparkSession, df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder; a DataFrame that reads it, and its path."""
    path = new_path(spark, name)
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path), path


def keep(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and return a DataFrame that reads it."""
    return keep_at(spark, df, name, **options)[0]


def bounded_batches(spark: SparkSession, rows: int = 2_000, size: str = "8m") -> None:
    """Let Arrow batches hold at most ``rows`` rows and about ``size``, so that whole texts in them stay within memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


Batches = Iterator[pa.RecordBatch]


def trimmed(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """work, after which a worker gives its freed memory back to the system rather than hold it while idle."""

    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def id_buckets(df: DataFrame, key: Column, n: int) -> tuple[Column, int]:
    """A column that puts ids in at most n buckets of consecutive ids and about equal rows.

    The bounds come from one pass over the ids alone; a binary search finds an id's bucket.
    """
    bounds = df.select(key.alias("k")).agg(F.percentile_approx("k", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0), 1
    held = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << j for j in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when((lo + s <= len(bounds)) & (F.get(held, lo + s - 1) <= key), lo + s).otherwise(lo))
    return found, len(bounds) + 1


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than that."""
    return df.limit(most_rows + 1).count() <= most_rows


def maybe_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint only if it was counted to have at most most_rows rows."""
    return F.broadcast(df) if small(df, most_rows) else df


def named(column: str) -> Column:
    """The column of that very name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names for private columns that none of the taken ones equals, letters' case aside."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without copying; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not (pa.types.is_string(array.type) or pa.types.is_large_string(array.type)):
        array = array.cast(pa.large_string())
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    n, at = len(array), array.offset
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if array.null_count:  # what lies under a null is not specified
        array = array.fill_null("")
        return utf8(array)
    return body[offs[0] : offs[-1]], offs - offs[0]


def sum_counters(df: DataFrame, key: str, blob: str, dtype: str, length: int) -> np.ndarray:
    """Add equal-sized counter blocks by key in two levels; the driver gets each block once.

    df has (key int, salt int, blob binary of zlib-packed dtype counters). The result has
    a fixed size, whatever the number of rows or tasks.
    """
    import zlib

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column(blob).to_pylist():
            block = np.frombuffer(zlib.decompress(x), dtype)
            total = block.astype(dtype) if total is None else total + block
        return pa.table({key: table.column(key)[:1], blob: pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = f"{key} int, {blob} binary"
    once = df.groupBy(key, "salt").applyInArrow(add, schema)
    rows = once.groupBy(key).applyInArrow(add, schema).collect()
    out = np.zeros(length, dtype)
    for r in rows:
        block = np.frombuffer(zlib.decompress(r[blob]), dtype)
        out[r[key] * len(block) : r[key] * len(block) + len(block)] = block
    return out
