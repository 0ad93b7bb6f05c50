"""Token ids by the tokenizers library, for whole Arrow batches at a time.

For the two kinds of vocabulary recognised here a pre-token never crosses from a
non-space to ASCII white space, so a text's ids are the joined ids of its units: each run of
non-spaces with the white space before it (where the vocabulary drops white space: without),
less a sign at its end after a letter or digit, which begins a pre-token and is a unit itself.
Units of up to 15 bytes are looked up in a table of fixed size, all units of a block in one
step; the key is the unit's bytes and length themselves, so a hit is exact. Units that are
not in the table are given to the library, each distinct one once a block, and many in one
call where the joined ids can be told apart. Any other tokenizer, and any text with white
space outside ASCII, is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from veridoss.llm.shared import utf8
from veridoss.llm.words import U, mix

_SEPARATORS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_WIDE_SPACES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_WIDE_SPACE = re.compile(rb"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]")
_ONE_SPACE = re.compile(rb"[ \n][^\s]+")
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

BLOCK = 1 << 21  # bytes of text handled at once
SLOT_BITS = 22
KEY = 15  # bytes of the longest unit that is kept in the table
WIDTH = 7  # ids of the longest entry
CALL = 1000  # units joined in one text for the library

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[list(b".,!?;:")] = True
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LATIN_TAIL = np.zeros(256, bool)  # second bytes of Latin-1 letters from U+00C0 on
_LATIN_TAIL[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _wide_space(raw: bytes) -> bool:
    """White space beyond ASCII's six, or a separator that is white space to some libraries."""
    if any(x in raw for x in _SEPARATORS):
        return True
    if raw.isascii():
        return False
    return any(x in raw for x in _WIDE_SPACES) or b"\xe2\x80" in raw and _WIDE_SPACE.search(raw) is not None


class Encoder:
    """Ids of texts; holds one table of 2**slot_bits entries, of 32 bytes each (48 with ids of 32 bits)."""

    def __init__(self, path: str, slot_bits: int = SLOT_BITS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocabulary.values(), default=0) < 1 << 16 else "<u4")
        parts = pre.get("pretokenizers", [])
        self.kind, self.folds = "other", False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            self.kind = "spaced"  # a space belongs to the word after it
        elif pre.get("type") == "Sequence" and parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and r"\p{L}" in str(parts[0].get("pattern")):
            self.kind = "dropped"  # white space is dropped
            self.folds = any(x.get("type") == "Lowercase" for x in norm.get("normalizers", []))
        # tokens that tell where units begin (a space or line feed) or pre-tokens end (the suffix)
        suffix = (spec.get("model") or {}).get("end_of_word_suffix")
        self.edge = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token[:1] in ("Ġ", "Ċ") if self.kind == "spaced" else bool(suffix) and token.endswith(suffix)
        self.shift = U(64 - slot_bits)
        # an entry lies in one row: two words of key, then WIDTH ids and their number
        self.table = np.zeros((1 << slot_bits, 2 + self.dtype.itemsize), U)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _joined(self, units: list[bytes]) -> list[bytes] | None:
        """Packed ids of units from one call, or None where they cannot be told apart."""
        glue = b"" if self.kind == "spaced" else b" "
        ids = np.array(self.tokenizer.encode_batch_fast([glue.join(units).decode()], add_special_tokens=False)[0].ids, self.dtype)
        edges = np.flatnonzero(self.edge[ids])
        bounds = np.append(edges, len(ids)) if self.kind == "spaced" else np.append(0, edges + 1)
        if len(edges) != len(units) or bounds[0] != 0 or bounds[-1] != len(ids):
            return None
        packed, at = ids.tobytes(), (bounds * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip(at, at[1:])]

    def _ask(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of distinct units from the library."""
        plain = (_ONE_SPACE if self.kind == "spaced" else _WORD).fullmatch
        out: list[bytes | None] = [None] * len(units)
        many = [i for i, u in enumerate(units) if plain(u)]
        for at in range(0, len(many), CALL):
            some = many[at : at + CALL]
            for i, ids in zip(some, self._joined([units[i] for i in some]) or (), strict=False):
                out[i] = ids
        return [self.whole(u.decode()).tobytes() if ids is None else ids for u, ids in zip(units, out, strict=True)]

    def _units(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the units of texts that begin at starts."""
        word, first_byte = ~_IS_SPACE[data], np.zeros(len(data), bool)
        first_byte[starts[starts < len(data)]] = True
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first_byte[1:]
        sign = np.flatnonzero(ends & _IS_SIGN[data])
        sign = sign[(sign > 0) & ~first_byte[sign]]
        before = data[sign - 1]
        sign = sign[_IS_ALNUM[before] | _LATIN_TAIL[before] & (data[sign - 2] == 0xC3) & (sign > 1)]
        ends[sign - 1] = True
        if self.kind == "dropped":
            begins = word.copy()
            begins[1:] &= ~word[:-1] | first_byte[1:]
            begins[sign] = True
            return np.flatnonzero(begins), np.flatnonzero(ends) + 1
        ends[-1] = True  # white space at a text's end is a unit, too
        ends[:-1] |= first_byte[1:]
        end = np.flatnonzero(ends) + 1
        return np.concatenate(([0], end[:-1])), end

    def _block(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie side by side in raw, and the offset of each text's first one."""
        if not raw:
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        raw += bytes(16)
        data = np.frombuffer(raw, np.uint8)
        if self.folds and b"<|" not in raw:  # no name of a special token may arise by folding
            data = _LOWER[data]
            raw = data.tobytes()
        begin, end = self._units(data[: at[-1]], at[:-1])
        n = end - begin
        eight = np.ndarray((len(data) - 7,), "<u8", raw, strides=(1,))
        lo = eight[begin] & _MASK[np.minimum(n, 8)]
        hi = eight[begin + np.minimum(n, 8)] & _MASK[np.clip(n - 8, 0, 8)] | np.minimum(n, 255).astype(U) << U(56)
        slot = (mix(lo ^ mix(hi)) >> self.shift).astype(np.int64)
        entries = self.table[slot]
        hit = (n <= KEY) & (entries[:, 0] == lo) & (entries[:, 1] == hi)
        kept = entries[hit, 2:].view(self.dtype)
        sizes, place = np.zeros(len(n), np.int64), np.arange(WIDTH)
        sizes[hit] = kept[:, WIDTH]
        known = kept[:, :WIDTH][place < kept[:, WIDTH:]]
        missed = np.flatnonzero(~hit)
        cut = [raw[b:e] for b, e in zip(begin[missed].tolist(), end[missed].tolist(), strict=True)]
        first = {unit: i for i, unit in zip(reversed(range(len(cut))), reversed(cut), strict=True)}
        number = missed[list(first.values())]  # where each distinct unit stands first
        new = dict(zip(first, self._ask(list(first)), strict=True))
        asked = [new[unit] for unit in cut]
        sizes[missed] = [len(x) // self.dtype.itemsize for x in asked]
        out = np.empty(int(sizes.sum()), self.dtype)
        old = np.repeat(hit, sizes)
        out[old] = known
        out[~old] = np.frombuffer(b"".join(asked), self.dtype)
        fit = number[(n[number] <= KEY) & (sizes[number] <= WIDTH)]
        to, pick = np.unique(slot[fit], return_index=True)
        fit = fit[pick]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        inside = place < sizes[fit][:, None]
        rows = np.zeros((len(fit), WIDTH + 1), self.dtype)
        rows[:, :WIDTH][inside] = out[(offsets[fit][:, None] + place)[inside]]
        rows[:, WIDTH] = sizes[fit]
        self.table[to] = np.column_stack((lo[fit], hi[fit], rows.view(U)))
        return out, offsets[np.searchsorted(begin, at)]

    def _long(self, raw: bytes) -> np.ndarray:
        """Ids of one text in pieces of about BLOCK bytes that begin with white space after a word."""
        parts, done = [], 0
        while done < len(raw):
            cut = raw.find(b" ", done + BLOCK)
            while cut > 0 and raw[cut - 1 : cut].isspace():
                cut = raw.find(b" ", cut + 1)
            cut = len(raw) if cut < 0 else cut
            parts.append(self._block(raw[done:cut], np.array([0, cut - done]))[0])
            done = cut
        return np.concatenate(parts)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text in order; none for a null or an empty one."""
        data, offsets = utf8(texts)
        lo, n = 0, len(offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
            at = offsets[lo : hi + 1] - offsets[lo]
            raw = data[offsets[lo] : offsets[hi]].tobytes()
            odd = self.kind == "other" or _wide_space(raw)
            if odd:
                for a, b in zip(at[:-1], at[1:]):
                    one = raw[a:b]
                    if not one:
                        yield np.zeros(0, self.dtype)
                    elif self.kind == "other" or _wide_space(one):
                        yield self.whole(one.decode())
                    else:
                        yield self._long(one)
            elif len(raw) > 2 * BLOCK:  # one long text
                yield self._long(raw)
            else:
                ids, first = self._block(raw, at)
                for a, b in zip(first[:-1], first[1:]):
                    yield ids[a:b]
            lo = hi


@lru_cache(maxsize=1)
def encoder(path: str, slot_bits: int = SLOT_BITS) -> Encoder:
    """One per worker process and vocabulary file."""
    return Encoder(path, slot_bits)


def release() -> None:
    """Drop this worker's table; operators that need the memory for other work call it first."""
    encoder.cache_clear()
