"""Media columns: MPEG transport streams in binary columns.

``mux`` stores a payload of 8-bit samples as one program: a program association table, a
program map table and one elementary stream of PES packets, each with a presentation time
stamp; every RAP_EVERY-th packet is a random-access point and carries a clock reference, and
the tables are repeated before it. ``demux`` takes nothing from the writer but the bytes: it
puts table sections together (over as many packets as they take, checksums verified), finds the
programs' streams in them, checks continuity counters, reassembles the elementary packets and returns
the payload with time stamps and the byte offsets of random-access points. Null packets are passed over,
a packet repeated once counts once, packets without payload do not count, and a jump that the
discontinuity flag announces is no error. ``media_digests`` writes the streams as a table in the
shared folder and reads them back from there.

Defined results. Null or empty text: one unit of padding. Repeated rows: equal results; null ids stay.
Very long texts are stored whole, as more elementary packets. An empty table gives no row. Extra
columns are ignored by ``media_column`` and ``media_digests`` and kept by ``parse_media``, whose results
replace input columns of the same name. Damage is counted: packets marked faulty, sections with a wrong
checksum, elementary packets cut short or without a header. Where synchronisation is lost or no
program can be found, a ValueError tells.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.shared import keep, trimmed

PACKET = 188
UNIT = 576
ACCESS_UNIT = 8 * UNIT
RATE = 48_000  # samples a second
CLOCK = 90_000
RAP_EVERY = 4
NULL_PID = 0x1FFF
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE = 0x100, 0x101, 1, 0x06
_BATCH = 16 << 20


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The checksum of table sections: CRC-32, most significant bit first, not inverted."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


PAT = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
PMT = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    return (struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10 | counter & 15) + b"\0" + section).ljust(PACKET, b"\xff")


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _pes_packets(data: bytes, pts: int, rap: bool, counter: int) -> np.ndarray:
    """Transport packets of one PES packet; the first has an adaptation field, the last stuffing."""
    pes = b"\0\0\1\xbd" + struct.pack(">HBBB", len(data) + 8, 0x84, 0x80, 5) + _pts_bytes(pts) + data
    extra = bytes([0x50]) + struct.pack(">I", pts >> 1 & 0xFFFFFFFF) + bytes([(pts & 1) << 7 | 0x7E, 0]) if rap else bytes([0])
    room = PACKET - 5 - len(extra)
    n = 1 + max(0, -(-(len(pes) - room) // (PACKET - 4)))
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 3] |= 0x20
    raw = np.frombuffer(pes, np.uint8)
    first = min(room, len(raw))
    out[0, 4] = PACKET - 5 - first
    out[0, 5 : 5 + len(extra)] = np.frombuffer(extra, np.uint8)
    out[0, PACKET - first :] = raw[:first]
    rest = raw[first:]
    whole = len(rest) // (PACKET - 4)
    out[1 : 1 + whole, 4:] = rest[: whole * (PACKET - 4)].reshape(whole, PACKET - 4)
    tail = rest[whole * (PACKET - 4) :]
    if len(tail):
        fill = PACKET - 4 - len(tail)
        out[-1, 3] |= 0x20
        out[-1, 4] = fill - 1
        if fill > 1:
            out[-1, 5] = 0
        out[-1, PACKET - len(tail) :] = tail
    return out


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """text followed by bytes 255 up to a positive multiple of unit."""
    return text + b"\xff" * (-len(text) % unit if text else unit)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload."""
    parts, es, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), ACCESS_UNIT)):
        rap = k % RAP_EVERY == 0
        if rap:
            parts += [_table_packet(0, PAT, tables), _table_packet(PMT_PID, PMT, tables)]
            tables += 1
        packets = _pes_packets(payload[at : at + ACCESS_UNIT], at * CLOCK // RATE & (1 << 33) - 1, rap, es)
        es += len(packets)
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)  # program number: table's PID
    streams: dict[int, int] = field(default_factory=dict)  # PID: stream type
    pts: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)  # byte offsets in the stream
    packets: int = 0
    continuity_errors: int = 0
    clock_references: int = 0
    damaged: int = 0  # faulty packets, sections and elementary packets


def _cut(held: bytes) -> tuple[list[bytes], bytes]:
    """The whole sections that held begins with, and the rest; stuffing is no rest."""
    out = []
    while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
        out.append(held[:n])
        held = held[n:]
    return out, b"" if held[:1] == b"\xff" else held


def _sections(rows: list[tuple[bytes, bool]]) -> Iterator[bytes]:
    """Whole sections of one PID from its payloads, each with whether a section begins in it."""
    held = None  # nothing has begun
    for body, begins in rows:
        if begins:
            at = 1 + body[0]
            if held:
                yield from _cut(held + body[1:at])[0]
            held = body[at:]
        elif held is None:
            continue
        else:
            held += body
        whole, held = _cut(held)
        yield from whole


def _tables(x: np.ndarray, mine: np.ndarray, start: np.ndarray, begins: np.ndarray, kind: int, out: Stream) -> Iterator[tuple[int, bytes]]:
    """(identifier, body) of the sections of one kind that are in force."""
    for section in _sections([(x[i, start[i] :].tobytes(), bool(begins[i])) for i in mine]):
        if section[0] != kind:
            continue
        if len(section) < 12 or crc32_mpeg(section):
            out.damaged += 1
        elif section[5] & 1:
            yield section[3] << 8 | section[4], section[8:-4]


def _elementary(body: bytes, out: Stream) -> bytes:
    """The data of one elementary packet; its time stamp goes to out."""
    if body[:3] != b"\0\0\1" or len(body) < 6:
        out.damaged += 1
        return b""
    size = body[4] << 8 | body[5]
    if size and size + 6 > len(body):
        out.damaged += 1
        return b""
    body = body[: size + 6] if size else body
    if body[3] == 0xBE:  # padding
        return b""
    if body[3] == 0xBF:  # private data without the optional header
        return body[6:]
    if len(body) < 9 or len(body) < 9 + body[8]:
        out.damaged += 1
        return b""
    if body[7] & 0x80:
        p = body[9:14]
        out.pts.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
    return body[9 + body[8] :]


def demux(data: bytes) -> Stream:
    """Parse a transport stream from its bytes alone."""
    out = Stream()
    if len(data) % PACKET:
        raise ValueError("not a whole number of packets")
    x = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (x[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    out.packets = len(x)
    pid = (x[:, 1].astype(np.int32) & 0x1F) << 8 | x[:, 2]
    faulty = (x[:, 1] & 0x80) > 0
    begins = (x[:, 1] & 0x40) > 0
    adapted, carries = (x[:, 3] & 0x20) > 0, (x[:, 3] & 0x10) > 0
    start = np.where(adapted, 5 + x[:, 4].astype(np.int32), 4)
    flags = np.where(adapted & (x[:, 4] > 0), x[:, 5], 0)
    bad = (faulty | (start > PACKET)) & (pid != NULL_PID)
    out.damaged += int(bad.sum())
    used = carries & ~bad & (start < PACKET) & (pid != NULL_PID)
    packets: dict[int, np.ndarray] = {}
    for one in np.unique(pid[used]):
        mine = np.flatnonzero(used & (pid == one))
        step = np.diff((x[mine, 3] & 15).astype(np.int16)) & 15
        odd = np.flatnonzero(step != 1) + 1
        if len(odd):
            again = np.array([j for j in odd if step[j - 1] == 0 and _same(x[mine[j - 1]], x[mine[j]]) and not (j > 1 and step[j - 2] == 0 and _same(x[mine[j - 2]], x[mine[j]]))], np.int64)
            told = (flags[mine[odd]] & 0x80) > 0
            out.continuity_errors += int((~np.isin(odd, again) & ~told).sum())
            mine = np.delete(mine, again)
        packets[int(one)] = mine
    none = np.zeros(0, np.int64)
    for _, body in _tables(x, packets.get(0, none), start, begins, 0, out):
        out.programs |= {n: p & 0x1FFF for n, p in struct.iter_unpack(">HH", body[: len(body) // 4 * 4]) if n}
    for table in sorted(set(out.programs.values())):
        for _, body in _tables(x, packets.get(table, none), start, begins, 2, out):
            at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
            while at + 5 <= len(body):
                kind, es, more = struct.unpack_from(">BHH", body, at)
                out.streams[es & 0x1FFF] = kind
                at += 5 + (more & 0xFFF)
    if not out.streams:
        raise ValueError("no program was found")
    parts = []
    for es in sorted(out.streams):
        every = np.flatnonzero((pid == es) & ~bad)
        out.access_points += [int(i) * PACKET for i in every[(flags[every] & 0x40) > 0]]
        out.clock_references += int(((flags[every] & 0x10) > 0).sum())
        mine = packets.get(es, none)
        if not len(mine):
            continue
        body = x[mine][np.arange(PACKET) >= start[mine][:, None]].tobytes()
        ends = np.cumsum(PACKET - start[mine])
        firsts = (ends - (PACKET - start[mine]))[begins[mine]].tolist() + [len(body)]
        parts += [_elementary(body[a:b], out) for a, b in zip(firsts, firsts[1:])]
    out.payload = b"".join(parts)
    return out


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b repeats a; only a clock reference may differ."""
    if (a[1:4] != b[1:4]).any():
        return False
    clock = a[3] & 0x20 and a[4] >= 7 and a[5] & 0x10
    return bool((a[4:6] == b[4:6]).all() and (a[12:] == b[12:]).all()) if clock else bool((a == b).all())


def feature(s: Stream) -> str:
    """A stable one-line description of a parsed stream."""
    mean = np.frombuffer(s.payload, np.uint8).mean() if s.payload else 0.0
    span = f"{s.pts[0]}-{s.pts[-1]}" if s.pts else "-"
    kinds = ",".join(f"{p:x}:{k:x}" for p, k in sorted(s.streams.items()))
    return f"programs={len(s.programs)};streams={kinds};packets={s.packets};pes={len(s.pts)};pts={span};rap={len(s.access_points)};pcr={s.clock_references};continuity_errors={s.continuity_errors};damaged={s.damaged};mean={mean:.6f}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, n_bytes and media: the transport stream of each text's padded UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.large_binary()).cast(pa.binary())], names=[id_col, "n_bytes", "media"])

        ids, sizes, media, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                ids.append(doc)
                sizes.append(len(raw))
                media.append(mux(padded(raw)))
                held += len(media[-1])
                if held > _BATCH:
                    yield out()
                    ids, sizes, media, held = [], [], [], 0
        if ids:
            yield out()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(trimmed(run), f"`{id_col}` long, n_bytes long, media binary")


PARSED = "payload binary, programs int, streams string, pts array<long>, access_points array<long>, packets long, continuity_errors long, damaged long"


def parse_media(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """Parsed columns beside the others: payload, time stamps, random-access points, errors."""
    results = [f.split(" ")[0] for f in PARSED.split(", ")]
    names = [c for c in rows.columns if c != media_col and c.lower() not in results]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [demux(m.as_py() or b"") for m in batch.column(batch.schema.get_field_index(media_col))]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            cols += [pa.array([s.payload for s in found], pa.binary()), pa.array([len(s.programs) for s in found], pa.int32()), pa.array([",".join(f"{p}:{k}" for p, k in sorted(s.streams.items())) for s in found], pa.string()), pa.array([s.pts for s in found], pa.list_(pa.int64())), pa.array([s.access_points for s in found], pa.list_(pa.int64())), pa.array([s.packets for s in found], pa.int64()), pa.array([s.continuity_errors for s in found], pa.int64()), pa.array([s.damaged for s in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *results])

    return rows.mapInArrow(trimmed(run), f"{kept}, {PARSED}" if kept else PARSED)


def media_digests(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the stored streams and of what is read back from them, out of a table in the shared folder."""
    media = keep(spark, media_column(docs, id_col, text_col), "media", compression="zstd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(2):
                stored = m.as_py()
                s = demux(stored)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(s)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(trimmed(run), f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
