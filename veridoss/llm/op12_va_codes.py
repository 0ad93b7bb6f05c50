"""Vector code compression: part codebooks, with the nearest entry found by VA-file filtering.

A vector's components become integers; it is cut into PARTS consecutive parts, and each part
gives way to the number of its nearest codebook entry. The search for that entry is a VA-file's:

- the coordinates of the entries are quantised to BITS bits each, so an entry is a row of cells;
- for a part, look-up tables hold the least and the greatest squared distance to each cell of each
  coordinate; their sums bound the distance to every entry from below and from above;
- entries whose lower bound exceeds the least upper bound cannot be nearest; the distances of the
  others, and only of those, are computed in integers.

Each round is one pass over the vectors: a task adds up its parts by entry, Spark adds up the
tasks' sums (a fixed number of rows a task), and the driver gets one codebook's worth of numbers.
No vector is shuffled; a lost task is computed again from the source.

Defined results. A vector that is null or holds a null, NaN or infinite component is dropped. Where
lengths differ, or are no multiple of the number of parts, shorter vectors go on as zeros up to the
longest. With fewer rows than entries, the codebooks are as short as the rows are few. Null ids
come last, and equal ids follow one another by vector, when the first entries are chosen; repeated
rows each get their row. An empty table gives an empty result. Sums and distances are exact for
components of any size below 2**120; errors beyond 2**63 - 1 are given as that. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoss.llm.shared import bounded_batches, keep, maybe_broadcast, named, trimmed

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BITS = 2
BLOCK = 1 << 18  # numbers in a look-up table
MOST = (1 << 63) - 1
LABELS = 100_000  # sums by label are broadcast up to so many rows, and joined by key beyond
_LIMB = 60

Book = list[np.ndarray]


def usable(vector: Column) -> Column:
    """Whether a vector has none but finite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, a row each, zeros after the last one; Python's integers where they are large."""
    offsets = np.asarray(vectors.offsets.to_numpy())
    sizes, body = np.diff(offsets), np.asarray(vectors.values.to_numpy(zero_copy_only=False))[offsets[0] : offsets[-1]]
    scaled = np.floor(body * SCALE)
    large = len(scaled) > 0 and np.abs(scaled).max() >= 1 << 62
    whole = np.array([int(v) for v in scaled.tolist()], object) if large else scaled.astype(np.int64)
    out = np.zeros((len(sizes), width), object if large else np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(body)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = whole
    return out


def matched(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as machine integers if no sum of squared differences can overflow, else as Python's."""
    top = max((int(abs(a).max()) for a in (x, book) if a.size), default=0)
    kind = np.int64 if (2 * top) ** 2 * max(1, x.shape[1]) < 1 << 62 else object
    return x.astype(kind), book.astype(kind)


class CellFile:
    """A codebook's entries by cells of their coordinates."""

    def __init__(self, book: np.ndarray, bits: int = BITS) -> None:
        cells, low = 1 << bits, book.min(0)
        steps = np.arange(cells + 1)[:, None].astype(book.dtype)
        self.book, self.edges = book, low + (book.max(0) - low + 1) * steps // cells
        self.cell = (book[:, None, :] >= self.edges[None, 1:-1, :]).sum(1)  # of each entry and coordinate

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row to each entry."""
        below = self.edges[None, :-1, :] - x[:, None, :]
        above = x[:, None, :] - (self.edges[None, 1:, :] - 1)
        least = np.maximum(np.maximum(below, above), 0) ** 2
        most = np.maximum(abs(below), abs(above)) ** 2
        lower = sum(least[:, self.cell[:, j], j] for j in range(x.shape[1]))
        return lower, sum(most[:, self.cell[:, j], j] for j in range(x.shape[1]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest entry, its squared distance) of each row, the lowest number on ties; and distances computed."""
        lower, upper = self.bounds(x)
        rows, entries = np.nonzero(lower <= upper.min(1)[:, None])
        exact = ((x[rows] - self.book[entries]) ** 2).sum(1)
        near = np.full((len(x), len(self.book)), exact.max() + 1, x.dtype)
        near[rows, entries] = exact
        code = near.argmin(1)
        return code, near[np.arange(len(x)), code], len(rows)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of the rows of x, a block at a time."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    x, book = matched(x, book)
    file, step = CellFile(book), max(1, BLOCK // (x.shape[1] << BITS))
    found = [file.nearest(x[at : at + step])[:2] for at in range(0, len(x), step)]
    return np.concatenate([c for c, _ in found]), np.concatenate([d for _, d in found])


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def first_entries(rows: DataFrame, width: int, parts: int, entries: int) -> Book:
    """The parts of the vectors with the smallest ids."""
    got = [r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()]
    return _parts(integers(pa.array(got, pa.list_(pa.float64())), width), parts)


SUMS = "part int, entry int, at int, n long, high decimal(38,0), low decimal(38,0)"


def part_sums(rows: DataFrame, width: int, book: Book) -> DataFrame:
    """Sums and counts of the parts of each entry, by task; a sum is high * 2**60 + low."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in book]
        counts = [np.zeros(len(b), np.int64) for b in book]
        for batch in batches:
            for p, x in enumerate(_parts(integers(batch.column(0), width), len(book))):
                code, _ = nearest(x, book[p])
                for e in np.unique(code):
                    mine = x[code == e]
                    counts[p][e] += len(mine)
                    # machine sums are exact: a batch has few rows, and larger numbers are Python's already
                    sums[p][e] += mine.astype(object if mine.dtype != object and abs(mine).max(initial=0) >= 1 << 44 else mine.dtype).sum(0)
        out = [(p, e, j, int(counts[p][e]), Decimal(int(s) >> _LIMB), Decimal(int(s) & (1 << _LIMB) - 1)) for p in range(len(book)) for e in range(len(book[p])) if counts[p][e] for j, s in enumerate(sums[p][e])]
        if out:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38), pa.decimal128(38)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["part", "entry", "at", "n", "high", "low"])

    return rows.select("v").mapInArrow(trimmed(add), SUMS)


def refined(rows: DataFrame, width: int, book: Book) -> Book:
    """One round: every entry becomes the floored mean of its parts; an unused one stays."""
    total = part_sums(rows, width, book).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [b.astype(object) for b in book]
    for r in total.collect():  # one number for each component of the codebooks
        out[r["part"]][r["entry"], r["at"]] = ((int(r["high"]) << _LIMB) + int(r["low"])) // r["n"]
    return [b.astype(np.int64) if not b.size or abs(b).max() < 1 << 62 else b for b in out]


def digest(book: Book) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in book for entry in b for v in entry).encode()).hexdigest()


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Book, int]:
    """Codebooks of rows (id, v), and the width vectors are brought to."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    book = first_entries(rows, width, parts, entries)
    for _ in range(rounds if len(book[0]) else 0):
        book = refined(rows, width, book)
    return book, width


def encode(rows: DataFrame, book: Book, width: int) -> DataFrame:
    """(id, label, code, error) of every row of (id, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [nearest(x, b) for x, b in zip(_parts(integers(batch.column(2), width), len(book)), book, strict=True)]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            errors = [min(MOST, int(e)) for e in sum(d.astype(object) for _, d in found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], names=["id", "label", "code", "error"])

    fields = [rows.schema["id"], rows.schema["label"]]
    return rows.select("id", "label", "v").mapInArrow(trimmed(run), T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: its code and error, the error summed over its label, and the codebooks' digest.

    entries is 256 at most, as a code has two hexadecimal digits a part.
    """
    bounded_batches(spark)
    rows = vectors.where(usable(named(vector_col))).select(named(id_col).alias("id"), named(label_col).alias("label"), named(vector_col).cast("array<double>").alias("v"))
    book, width = train(rows, parts, entries, rounds)
    coded = keep(spark, encode(rows, book, width), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    both = coded.join(maybe_broadcast(keep(spark, sums, "label_errors"), LABELS), F.col("label").eqNullSafe(F.col("of")), "left")
    return both.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))
