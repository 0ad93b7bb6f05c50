"""Packing: best-fit decreasing over a segment tree indexed by remaining capacity.

Documents are tokenised where they lie (no text is shuffled). An overlong document is cut
into full windows first; each is a sequence of its own and gets its number where it is cut. The
remainders, at most one a document and a few numbers a row, are dealt by hash into groups of about
GROUP rows; a group is packed in one task, the longest first, each into the open window with the least
room that still fits. The hash takes in a row's place in its task, so that rows alike in all else spread
over the groups; full windows only pass through and are held nowhere.

Defined results. Null or empty text: one piece holding the end id. Null ids are kept. Very long texts are
encoded a stretch at a time and cut into windows. Repeated rows are packed as often as they occur. An empty
table gives no row. Ties in length go by id, start and checksum, so a retried task packs alike, given that
docs come in the order they came in before, as from a table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.shared import bounded_batches, named, trimmed
from veridoss.llm.tokens import SLOT_BITS, encoder

WINDOW = 4096
END_ID = 2
GROUP = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """How many open windows have each remaining capacity, with successor search."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i, count = room + self.size, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least need: (its room, its number)."""
        i, count = need + self.size, self.count
        while not count[i]:
            while i & 1:  # a right child: go up
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i <<= 1
            if not count[i]:
                i += 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence number and offset for each length, in the order given (longest first)."""
    tree, sequences, offsets, used = CapacityTree(window), [], [], 0
    for n in lengths:
        got = tree.take(n)
        if got is None:
            got = window, used
            used += 1
        room, sequence = got
        sequences.append(sequence)
        offsets.append(window - room)
        if room > n:
            tree.put(room - n, sequence)
    return sequences, offsets, used


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", slot_bits: int = SLOT_BITS, groups: int = 0) -> DataFrame:
    """Full windows and remainders of every document, with checksums of their ids.

    place is a row's number in its task; windows have sequence ids, from ``groups`` on by task, and remainders none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer, slot_bits)
        place, sequence = 0, groups + TaskContext.get().partitionId() << 32
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                ids = np.append(body, end_id).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    whole = len(part) == window
                    out.append((doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), place, sequence if whole else None))
                    place, sequence = place + 1, sequence + whole
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place", "sequence_id"])

    return docs.select(named(id_col).cast("long"), named(text_col)).mapInArrow(trimmed(cut), PIECES + ", place long, sequence_id long")


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, slot_bits: int = SLOT_BITS) -> DataFrame:
    """One row per piece: its document, place, checksum, and sequence_id with offset.

    sequence_id is the group's number times 2**32 plus a number within the group; full windows have those
    of the tasks that cut them, after the groups. A worker keeps the ids of 2**slot_bits units of text at most.
    """
    bounded_batches(spark)
    groups = max(1, -(-docs.count() // group))
    rows = pieces(docs, tokenizer, window, end_id, id_col, text_col, slot_bits, groups)
    dealt = rows.repartition(groups, F.xxhash64("doc_id", "start", "ids_crc32", "place")).drop("place")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        held = []
        for batch in batches:
            whole = batch.column("sequence_id").is_valid()
            full = batch.filter(whole)
            if full.num_rows:
                yield full.append_column("offset", pa.array(np.zeros(full.num_rows, np.int64)))
            if full.num_rows < batch.num_rows:
                held.append(batch.filter(pc.invert(whole)).drop_columns(["sequence_id"]))
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset, _ = best_fit_decreasing(table.column("length").to_pylist(), window)
        table = table.append_column("sequence_id", pa.array(np.array(sequence, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(trimmed(fill), PIECES + ", sequence_id long, offset long")
