"""LM scoring: an Elias-Fano n-gram trie in memory-mapped levels.

Level 1 is the vocabulary: sorted word hashes with counts; a word's id is its rank. Level k
holds, for each entry of level k-1 as context, the words that follow it. Within a level the
successors of all contexts form one strictly increasing sequence (each context's values start
where the last one's ended), stored in Elias-Fano form; pointers (entries before a context) and
bases (values before a context) are Elias-Fano sequences, too. From level 3 on a word is stored
relative to its context: as its rank among the successors of the shorter context, a smaller
number than its id. A search is a successor search: select the bucket of the high bits, then
look among the low bits. Probabilities and back-off weights are logarithms in 16-bit steps.

Smoothing is interpolated discounting; an n-gram seen once loses most of its count, one seen more
often DISCOUNT of it. All n-grams are stored. least, off by default, leaves out those seen less
often; their mass goes to the back-off weight, so each distribution sums to one up to quantisation
either way. Level 1 adds 0.1 to each count and to an unknown word's.

Each level is built by two steps: tasks count distinct (context, word) pairs and send packed
blocks by context range; a task per range adds them up as they arrive, so that it holds distinct
pairs only, and writes one file in the shared folder under a name of its own attempt. Blocks wait packed
until a task adds them up, entries are smoothed BLOCK and sought STEP at a time. The number of
ranges follows the number of tokens (PART_TOKENS), and ranges are dealt to tasks by number. Workers
map those files, their select directories included; what a worker holds is bounded by its block of
tokens, whatever the model's size. Files of a store that cannot be mapped are read into memory, a
part at a time, and the least recently used go beyond REMOTE_BYTES.

Defined results. Null or empty text: the end token alone. Null ids are held out (their text
is ""). Repeated rows count as often as they occur; ties do not arise, as nothing is ranked. Very long
texts are scored whole: a text is never cut, its tokens are one block if there are more than BLOCK.
With no training text all tokens are unknown. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoss.llm.shared import keep, new_path, trimmed, utf8
from veridoss.llm.words import U, hashed, mix

ORDER = 3
ONCE = 0.9  # what an n-gram seen once loses of its count
DISCOUNT = 1.2  # what one seen more often loses
PART_TOKENS = 6_000_000  # training tokens to a part of a level
PENDING = 2_000_000  # entries that a merging task holds before it adds them up
REMOTE_BYTES = 256 << 20
ADD = 0.1
BLOCK = 1 << 20  # tokens handled at once
STEP = 1 << 17  # pairs of a part sought at once
LOG_STEP = 16.0 / 65535  # log10 values from -16 to 0
END = mix(np.array([0x656E64], U))[0]
NONE = np.int64(-1)


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(-log10, 0, 16) / LOG_STEP).astype(np.uint16)


def unquantise(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * -LOG_STEP


def _select_in(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each 64-bit word."""
    at = np.zeros(len(words), np.int64)
    k = k.copy()
    for size in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count((words >> at.astype(U)) & U((1 << size) - 1)).astype(np.int64)
        up = k >= ones
        k -= np.where(up, ones, 0)
        at += np.where(up, size, 0)
    return at


class EliasFano:
    """A non-decreasing sequence below a bound: packed high bits and byte-aligned low bits."""

    PARTS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, shift: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.shift, self.low, self.high, self.ones, self.zeros = n, shift, low, high, ones, zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(U)
        n = len(values)
        top = int(values[-1]) if n else 0
        ideal = max(0, (top // max(1, n)).bit_length() - 1)
        shift = min(32, -(-ideal // 8) * 8 if ideal % 8 > 4 else ideal // 8 * 8)
        kind = {0: np.uint8, 8: np.uint8, 16: np.uint16}.get(shift, np.uint32)
        low = (values & U((1 << shift) - 1)).astype(kind) if shift else np.zeros(0, np.uint8)
        place = (values >> U(shift)).astype(np.int64) + np.arange(n)
        size = -(-((top >> shift) + n + 2) // 64)
        bits = np.zeros(size * 64, np.uint8)
        bits[place] = 1
        high = np.packbits(bits, bitorder="little").view(U)
        ones = np.zeros(size + 1, np.uint32)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, shift, low, high, ones, (np.arange(size + 1, dtype=np.int64) * 64 - ones).astype(np.uint32))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values: select among ones, then join the low bits."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        place = word * 64 + _select_in(self.high[word], i - self.ones[word].astype(np.int64))
        value = (place - i) << self.shift
        return value | self.low[i].astype(np.int64) if self.shift else value

    def _select0(self, k: np.ndarray) -> np.ndarray:
        word = np.minimum(np.searchsorted(self.zeros, k.astype(np.uint32), "right") - 1, len(self.high) - 1)
        return word * 64 + _select_in(~self.high[word], k - self.zeros[word].astype(np.int64))

    def _ones_from(self, place: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """How many ones stand from place up to the next zero, which is the zero-th one."""
        word, bit = np.minimum(place >> 6, len(self.high) - 1), place & 63
        rest = ~(self.high[word] >> bit.astype(U))
        run = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        over = np.flatnonzero(run + bit >= 64)  # the run goes on in the next word
        run[over] = self._select0(zero[over]) - place[over]
        return run

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value in a strictly increasing sequence, or -1: successor search."""
        if not self.n:
            return np.full(len(value), NONE)
        bucket = value >> self.shift
        inside = bucket < len(self.high) * 64 - self.n - 1
        bucket = np.where(inside, bucket, 0)
        before = np.where(bucket > 0, self._select0(np.maximum(bucket - 1, 0)), -1)
        lo = before + 1 - bucket
        hi = lo + self._ones_from(before + 1, bucket)
        if not self.shift:
            return np.where(inside & (lo < hi), lo, NONE)
        want, last = (value & ((1 << self.shift) - 1)).astype(self.low.dtype), hi
        while True:  # binary search over the low bits of a bucket
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            less = open_ & (self.low[np.minimum(mid, self.n - 1)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return np.where(inside & (lo < last) & (self.low[np.minimum(lo, self.n - 1)] == want), lo, NONE)

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.meta": np.array([self.n, self.shift], np.int64)} | {f"{name}.{p}": getattr(self, p) for p in self.PARTS}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, shift = (int(x) for x in arrays[f"{name}.meta"])
        return cls(n, shift, *(arrays[f"{name}.{p}"] for p in cls.PARTS))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a text line naming each array, then the arrays, aligned to 64 bytes."""
    fs, name = _file_system(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    at, head = 0, []
    for key, a in arrays.items():
        head.append(f"{key} {a.dtype.str} {len(a)} {at}")
        at += -(-a.nbytes // 64) * 64
    line = ";".join(head).encode()
    size = -(-(len(line) + 9) // 64) * 64
    with fs.open_output_stream(name, buffer_size=1 << 20) as f:
        f.write(size.to_bytes(8, "little") + line.ljust(size - 8))
        for a in arrays.values():
            f.write(a.tobytes().ljust(-(-a.nbytes // 64) * 64, b"\0"))


def map_arrays(path: str) -> tuple[dict[str, np.ndarray], int]:
    """The arrays of a file of ``write_arrays``, mapped where it is local and read where it is not, and the bytes read."""
    fs, name = _file_system(path)
    remote = fs.type_name != "local"
    if remote:
        with fs.open_input_stream(name) as src:
            data = np.frombuffer(src.read(), np.uint8)
    else:
        data = np.memmap(name, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for item in data[8:size].tobytes().decode().strip().split(";"):
        key, kind, n, at = item.split(" ")
        kind = np.dtype(kind)
        out[key] = data[size + int(at) : size + int(at) + int(n) * kind.itemsize].view(kind)
    return out, len(data) if remote else 0


def _order_of_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order by a, then b, both at least 0."""
    if len(a) and max(int(a.max()), int(b.max())) >= 1 << 31:
        return np.lexsort((b, a))
    key = a << 32
    key |= b
    return np.argsort(key)


class Level:
    """Files of one level in order of context (level 1: of word hash), with their offsets."""

    def __init__(self, files: list[tuple[str, int]], width: int) -> None:
        self.files = [f for f, _ in files]
        self.starts = np.concatenate(([0], np.cumsum([n for _, n in files]))).astype(np.int64)
        self.width = width
        self.held: dict[int, tuple[dict, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def part(self, i: int) -> dict:
        if i in self.held:
            self.held[i] = self.held.pop(i)  # the latest one stands last
            return self.held[i][0]
        a, size = map_arrays(self.files[i])
        if "values.meta" in a:
            a |= {k: EliasFano.from_arrays(a, k) for k in ("values", "pointers", "bases")}
        self.held[i] = a, size
        while size and sum(n for _, n in self.held.values()) > REMOTE_BYTES and len(self.held) > 1:
            self.held.pop(next(iter(self.held)))
        return a

    @property
    def entries(self) -> int:
        return int(self.starts[-1])

    def look(self, pairs: Pairs, scores: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct pair: global entry number or -1, number of its context's first entry, log10
        probability (0 if there is no entry) and log10 back-off weight of the context; without scores the last two are empty."""
        context, value = pairs.context, pairs.value
        entry, before = np.full(len(context), NONE), np.zeros(len(context), np.int64)
        prob, weight = (np.zeros(len(context) if scores else 0) for _ in range(2))
        cuts = np.searchsorted(context, np.arange(len(self.files) + 1, dtype=np.int64) * self.width)
        for p in np.flatnonzero(np.diff(cuts)):
            if not self.files[p]:
                continue
            a = self.part(int(p))
            for x in range(cuts[p], cuts[p + 1], STEP):
                y = min(x + STEP, cuts[p + 1])
                local, v = context[x:y] - p * self.width, value[x:y]
                change = np.concatenate(([True], local[1:] != local[:-1]))
                distinct, back = local[change], np.cumsum(change) - 1
                low, high = a["bases"].access(distinct)[back], a["bases"].access(distinct + 1)[back]
                want = low + v
                inside = (v >= 0) & (want < high)
                got = a["values"].find(np.where(inside, want, 0))
                found = inside & (got >= 0)
                entry[x:y] = np.where(found, got + self.starts[p], NONE)
                if scores:
                    prob[x:y] = np.where(found, unquantise(a["prob"][np.where(found, got, 0)]) if len(a["prob"]) else 0.0, 0.0)
                    weight[x:y] = unquantise(a["backoff"][distinct])[back]
                before[x:y] = a["pointers"].access(distinct)[back] + self.starts[p]
        return entry, before, prob, weight

    def log_prob(self, entry: np.ndarray) -> np.ndarray:
        """log10 probabilities of entries, in ascending order of their numbers or not."""
        out, order = np.zeros(len(entry)), np.argsort(entry)
        ranked = entry[order]
        cuts = np.searchsorted(ranked, self.starts)
        for p in np.flatnonzero(np.diff(cuts)):
            mine = slice(cuts[p], cuts[p + 1])
            out[order[mine]] = unquantise(self.part(int(p))["prob"][ranked[mine] - self.starts[p]])
        return out


class Pairs:
    """The distinct (context, value) pairs of a block in ascending order, and where each token's is."""

    def __init__(self, context: np.ndarray, value: np.ndarray) -> None:
        known = np.flatnonzero(context >= 0)
        c, v = context[known], value[known] + 1  # no value: 0
        order = _order_of_pairs(c, v)
        c, v = c[order], v[order]
        self.first = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (v[1:] != v[:-1])))) if len(c) else np.zeros(0, np.int64)
        self.context, self.value = c[self.first], v[self.first] - 1
        self.count = np.diff(np.concatenate((self.first, [len(c)])))
        self.at = known[order]

    def spread(self, x: np.ndarray, size: int, missing: float) -> np.ndarray:
        """x by distinct pair as an array by token."""
        out = np.full(size, missing, x.dtype)
        out[self.at] = np.repeat(x, self.count)
        return out


class Vocabulary(Level):
    """Level 1: parts by the top of the word hash."""

    def __init__(self, files: list[tuple[str, int]], tokens: int) -> None:
        super().__init__(files, 1)
        self.tokens = tokens

    def look_up(self, words: np.ndarray, with_log: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Ids (-1: unknown) and log10 probabilities of word hashes, each distinct one sought once."""
        distinct, back = np.unique(words, return_inverse=True)
        out, seen = np.full(len(distinct), NONE), np.zeros(len(distinct))
        parts = _vocabulary_part(distinct, len(self.files))
        cuts = np.searchsorted(parts, np.arange(len(self.files) + 1))
        for p in np.unique(parts):
            if self.files[p]:
                a = self.part(int(p))
                mine = distinct[cuts[p] : cuts[p + 1]]
                i = np.minimum(np.searchsorted(a["hash"], mine), len(a["hash"]) - 1)
                good = a["hash"][i] == mine
                out[cuts[p] : cuts[p + 1]] = np.where(good, i + self.starts[p], NONE)
                if with_log:
                    seen[cuts[p] : cuts[p + 1]] = np.where(good, a["count"][i], 0)
        return out[back], self._log(seen)[back] if with_log else None

    def _log(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.entries + 1)))

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        distinct, back = np.unique(ids, return_inverse=True)
        got = np.zeros(len(distinct), np.int64)
        which = np.searchsorted(self.starts, distinct, "right") - 1
        for p in np.unique(which[distinct >= 0]):
            mine = (which == p) & (distinct >= 0)
            got[mine] = self.part(int(p))["count"][distinct[mine] - self.starts[p]]
        out[:] = got[back]
        return out

    def log_unigram(self, ids: np.ndarray) -> np.ndarray:
        return self._log(self.counts(ids))


def _vocabulary_part(words: np.ndarray, parts: int) -> np.ndarray:
    return ((words >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _blocks(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, token hashes with an end after each text, offsets by text), about BLOCK tokens at a time."""
    ids, words, sizes, held = [], [], [], 0
    end = np.array([END], U)
    for batch in batches:
        names = batch.column(0).to_pylist()
        if training:
            keep_ = pa.array([not held_out(x) for x in names], pa.bool_())
            batch = batch.filter(keep_)
            names = batch.column(0).to_pylist()
        for lo, hi, w, at in hashed(*utf8(batch.column(1))):
            w = np.insert(w, at[1:], END) if hi - lo > 1 else np.concatenate((w, end))
            ids += names[lo:hi]
            words.append(w)
            sizes.append(np.diff(at) + 1)
            held += len(w)
            if held > BLOCK:
                block = [(ids, np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))]
                ids, words, sizes, held, w, at = [], [], [], 0, None, None
                yield block.pop()  # nothing of it stays here
    if ids:
        yield ids, np.concatenate(words), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as differences, their bytes by place value, compressed: sorted blocks take little."""
    import zstandard

    body = b"".join(np.diff(a.view(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return zstandard.compress(body, 1)


def _unpack(blob: bytes, n: int, kinds: list) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(len(kinds), 8, n)
    return [np.cumsum(np.ascontiguousarray(x.T).view(np.int64).reshape(-1)).view(k) for x, k in zip(raw, kinds, strict=True)]


def _send(part: np.ndarray, arrays: list[np.ndarray]) -> pa.RecordBatch:
    """Packed blocks of rows already sorted by part."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    rows = [(int(part[a]), b - a, _pack(*(x[a:b] for x in arrays))) for a, b in zip(cuts, cuts[1:]) if b > a]
    return pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "n": pa.array([int(r[1]) for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})


_SENT = "part int, n long, blob binary"
_BUILT = "part int, file string, n long, total long"


def _built(part: int, file: str, n: int, total: int) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "file": [file], "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})


def _files(spark: SparkSession, sent: DataFrame, kinds: list, fold, write, parts: int, name: str) -> tuple[list[tuple[str, int]], int]:
    """Send blocks to the task of their part, add them up by fold as they come, and write a file by write.

    Parts are dealt by number: hashed numbers would share tasks and leave others idle.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, pending, n = None, [], [], 0

        def add_up() -> list[np.ndarray]:
            """What is held and the waiting blocks as one; both are given up."""
            at = len(held[0]) if held else 0
            whole = [np.empty(at + n, k) for k in kinds]
            for to in whole:
                if held:
                    to[:at] = held.pop(0)
            for size, blob in pending:
                for to, x in zip(whole, _unpack(blob, size, kinds), strict=True):
                    to[at : at + size] = x
                at += size
            pending.clear()
            return fold(whole)

        for batch in batches:
            for p, size, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "blob")), strict=True):
                part = p
                pending.append((size, blob))
                n += size
                if n > max(PENDING, len(held[0]) // 4 if held else 0):
                    held, n = add_up(), 0
        if part is not None:
            yield from _built(*write(part, add_up())).to_batches()

    dealt = sent.repartitionById(parts, F.col("part")).mapInArrow(trimmed(merge), _BUILT)
    rows = {r.part: r for r in keep(spark, dealt, name).collect()}  # one row a file
    return [(rows[p].file, rows[p].n) if p in rows else ("", 0) for p in range(parts)], sum(r.total for r in rows.values())


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def build_vocabulary(spark: SparkSession, docs: DataFrame, path: str, parts: int) -> Vocabulary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = _sum_by(np.concatenate([k for k, _ in seen]), np.concatenate([c for _, c in seen]))
            return _send(_vocabulary_part(keys, parts), [keys, n])

        for _, words, _ in _blocks(batches, True):
            seen.append(np.unique(words, return_counts=True))
            held += len(seen[-1][0])
            if held > BLOCK:
                yield flush()
                seen, held = [], 0
        if seen:
            yield flush()

    def write(part: int, arrays: list[np.ndarray]) -> tuple:
        keys, n = arrays
        file = f"{path}/level1-{part:06d}-{uuid.uuid4().hex[:8]}"
        write_arrays(file, {"hash": keys, "count": n})
        return part, file, len(keys), int(n.sum())

    fold = lambda arrays: list(_sum_by(*arrays))
    files, tokens = _files(spark, docs.mapInArrow(trimmed(count), _SENT), [U, np.int64], fold, write, parts, "vocabulary")
    return Vocabulary(files, tokens)


class Trie:
    """The levels, and scoring of blocks of tokens."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.levels = vocabulary, []

    def walk(self, ids: np.ndarray, begins: np.ndarray, depth: int, scores: bool) -> Iterator[tuple]:
        """For levels 2..depth: (pairs, entry by token, what look gave; None for a level not built yet, lower entry by token).

        The context of level 2 is the word before, or the start symbol, whose id follows the last
        word's; that of level k is the entry which level k-1 found at the token before.
        """
        start = np.zeros(len(ids), bool)
        start[begins[begins < len(ids)]] = True
        context = np.concatenate(([NONE], ids[:-1]))
        context[start] = self.vocabulary.entries
        value, lower = ids, ids
        for k in range(2, depth + 1):
            pairs = Pairs(context, value)
            if k - 2 >= len(self.levels):
                yield pairs, lower, None
                return
            got = self.levels[k - 2].look(pairs, scores)
            yield pairs, lower, got
            entry = pairs.spread(got[0], len(ids), NONE)
            # relative to the shorter context: rank among its successors
            value = np.where(entry >= 0, entry - pairs.spread(got[1], len(ids), 0), NONE)
            lower, pairs, got = entry, None, None
            context = np.concatenate(([NONE], entry[:-1]))
            context[start] = NONE

    def log_probs(self, ids: np.ndarray, unigram: np.ndarray, begins: np.ndarray) -> np.ndarray:
        out = unigram
        for pairs, lower, got in self.walk(ids, begins, len(self.levels) + 1, True):
            found = pairs.spread(got[0] >= 0, len(ids), False)
            out = np.where(found, pairs.spread(got[2], len(ids), 0.0), out + pairs.spread(got[3], len(ids), 0.0))
            pairs = lower = got = found = None  # else they stay while the next level is walked
        return out


def _fold_pairs(arrays: list[np.ndarray]) -> list[np.ndarray]:
    """(context, value, base, n) with equal (context, value) added up; of equal pairs base is the same. The arrays are taken out of the list."""
    context, value, base, n = arrays
    arrays.clear()
    order = _order_of_pairs(context, value + 1)
    context, value, n = context[order], value[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (value[1:] != value[:-1]))))
    base, order = base[order[first]], None
    context, value = context[first], value[first]
    return [context, value, base, np.add.reduceat(n, first)]


def add_level(spark: SparkSession, docs: DataFrame, trie: Trie, path: str, parts: int, least: int = 1) -> None:
    """Count, smooth and store the next level of the trie."""
    k = len(trie.levels) + 2
    contexts = trie.vocabulary.entries + 1 if k == 2 else trie.levels[-1].entries
    width = max(1, -(-contexts // parts))
    held = spark.sparkContext.broadcast(trie)  # names and offsets of files only

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for _, words, at in _blocks(batches, True):
            ids, _ = trie.vocabulary.look_up(words, with_log=False)
            words = None
            for pairs, lower, got in trie.walk(ids, at[:-1], k, False):
                if got is None and len(pairs.context):
                    # within a context lower and value ascend alike: their difference is sent, which packs to nothing
                    yield _send(pairs.context // width, [pairs.context, pairs.value, lower[pairs.at[pairs.first]] - pairs.value, pairs.count])
                pairs = lower = got = None

    def write(part: int, arrays: list[np.ndarray]) -> tuple:
        trie = held.value
        local, value, lower, n = arrays
        arrays.clear()
        lower += value
        local -= part * width
        total = np.bincount(local, n, width)
        stay = (n >= least) & (value >= 0)
        if not stay.all():
            local, value, lower, n = local[stay], value[stay], lower[stay], n[stay]
        left = n - np.where(n == 1, ONCE, DISCOUNT)
        n = stay = None
        weight = np.where(total > 0, 1 - np.bincount(local, left, width) / np.maximum(total, 1), 1.0)
        prob = np.empty(len(local), np.uint16)
        for i in range(0, len(local), BLOCK):
            x = slice(i, i + BLOCK)
            # the probability after the shorter context
            shorter = trie.vocabulary.log_unigram(lower[x]) if k == 2 else trie.levels[-1].log_prob(lower[x])
            prob[x] = quantise(np.log10(np.maximum(left[x] / total[local[x]] + weight[local[x]] * 10**shorter, 1e-16)))
        left = lower = None
        pointers = np.concatenate(([0], np.cumsum(np.bincount(local, minlength=width))))
        most = np.zeros(width, np.int64)
        most[local] = value + 1  # values ascend within a context: the last one stays
        bases = np.concatenate(([0], np.cumsum(most)))
        value += bases[local]
        entries, local = len(local), None
        arrays = EliasFano.encode(value).arrays("values") | EliasFano.encode(pointers).arrays("pointers") | EliasFano.encode(bases).arrays("bases")
        file = f"{path}/level{k}-{part:06d}-{uuid.uuid4().hex[:8]}"
        write_arrays(file, arrays | {"prob": prob, "backoff": quantise(np.log10(np.maximum(weight, 1e-16)))})
        return part, file, entries, int(total.sum())

    files, _ = _files(spark, docs.mapInArrow(trimmed(count), _SENT), [np.int64] * 4, _fold_pairs, write, parts, f"level{k}")
    trie.levels.append(Level(files, width))


def train(spark: SparkSession, docs: DataFrame, order: int = ORDER, parts: int | None = None, least: int = 1) -> Trie:
    """A trie of the given order over all rows that are not held out; docs: (id, text).

    parts: of each level; by default as many as the tokens need, the shuffle partitions at least.
    least: n-grams seen less often are not stored.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    path = new_path(spark, "trie")
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    trie = Trie(build_vocabulary(spark, docs, path, parts or tasks))
    parts = parts or max(tasks, -(-trie.vocabulary.tokens // PART_TOKENS))
    for _ in range(order - 1):
        add_level(spark, docs, trie, path, parts, least)
    return trie


def score(spark: SparkSession, docs: DataFrame, trie: Trie) -> DataFrame:
    """Scores of whole texts; docs: (id, text)."""
    held = spark.sparkContext.broadcast(trie)  # names and offsets of files only
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for ids, words, at in _blocks(batches, False):
            known, base = trie.vocabulary.look_up(words)
            words = None
            model = trie.log_probs(known, base, at[:-1])
            each = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  no text is without its end token
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([held_out(x) for x in ids], pa.bool_()), pa.array(np.diff(at)), pa.array(each((known >= 0).astype(np.int64))), pa.array([trie.vocabulary.tokens] * len(ids), pa.int64()), pa.array(each(base)), pa.array(each(model))], names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.mapInArrow(trimmed(run), schema)


def score_corpus(spark: SparkSession, docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on rows whose crc32(id as text) mod 10 is not 0 and score every row."""
    light = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return score(spark, light, train(spark, light, order))
