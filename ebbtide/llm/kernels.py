"""Array routines that run inside tasks: word borders, hashes of words and windows, Arrow columns."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Space and the control characters 9 to 13 part words; in UTF-8 no other character holds these bytes.
SEPARATES = np.zeros(256, dtype=bool)
SEPARATES[[9, 10, 11, 12, 13, 32]] = True

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_CHUNK = 1 << 18


@cache
def _powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and their inverses."""
    def run(b: int) -> np.ndarray:
        steps = np.full(count, b, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    return run(base), run(pow(base, -1, 1 << 64))


@cache
def _byte_codes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _rolling_values(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every run of ``width`` neighbouring values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    up, down = _powers(base, _CHUNK + width)
    for a in range(0, count, _CHUNK):
        b = min(count, a + _CHUNK)
        part = values[a:b + width - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[:len(part)], out=sums[1:])
        out[a:b] = (sums[width:] - sums[:-width]) * down[:b - a]
    return mix(out)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    return _rolling_values(values, width, _STEP)


def rolling_bytes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` bytes."""
    count = len(data) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    codes = _byte_codes()
    return np.concatenate([
        _rolling_values(codes[data[a:min(count, a + _CHUNK) + width - 1]], width, _BASE)
        for a in range(0, count, _CHUNK)
    ])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans are sorted and do not overlap."""
    out = np.zeros(len(starts), dtype=np.uint64)
    codes = _byte_codes()
    at = 0
    while at < len(starts):
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + _CHUNK, side="right")))
        low, high = starts[at:stop] - first, ends[at:stop] - first
        size = int(high[-1])
        up, down = _powers(_BASE, max(_CHUNK, 1 << (size - 1).bit_length() if size > 1 else 1) + 64)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(codes[data[first:first + size]] * up[:size], out=sums[1:])
        out[at:stop] = (sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64)
        at = stop
    return mix(out)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset of each value; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    cuts = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[cuts[0]:cuts[-1]], cuts - cuts[0]


def text_array(data: np.ndarray, cuts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The reverse of ``bytes_of``."""
    kind = kind or pa.string()
    if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) or cuts[-1] >= 1 << 31:
        wide = pa.large_binary() if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else pa.large_string()
        made = pa.Array.from_buffers(wide, len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
        return made.cast(kind)
    return pa.Array.from_buffers(kind, len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])


class Words:
    """The words of many texts: byte spans and the number of the first word of each text."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray) -> None:
        self.data, self.cuts = data, cuts
        letter = ~SEPARATES[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[cuts] = True
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0], before[1:] = True, ~letter[:-1]
            after[-1], after[:-1] = True, ~letter[1:]
        self.starts = np.flatnonzero(letter & (before | edge[:-1]))
        self.ends = np.flatnonzero(letter & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, cuts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def keep_bytes(data: np.ndarray, cuts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts reduced to the bytes marked in ``keep``."""
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return data[keep], total[cuts]


def cover_spans(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Marks the places inside any span of ``width`` that begins at one of the distinct ``starts``."""
    change = np.zeros(size + 1, dtype=np.int32)
    change[starts] = 1
    change[starts + width] -= 1
    return np.cumsum(change[:-1]) > 0


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each group of the given sizes."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


EMPTY = np.uint64(2**64 - 1)


class HashTable:
    """Distinct 64-bit keys in an open-addressed table; the greatest key is reserved."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        slots = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(slots - 1)
        self.keys, self.values = np.full(slots, EMPTY, dtype=np.uint64), np.zeros(slots, dtype=values.dtype)
        place, todo = mix(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[place[todo]] == EMPTY]
            put = free[np.unique(place[free], return_index=True)[1]]
            self.keys[place[put]], self.values[place[put]] = keys[put], values[put]
            todo = todo[self.keys[place[todo]] != keys[todo]]
            place[todo] = (place[todo] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray, default) -> np.ndarray:
        slot = mix(keys) & self.mask
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], self.values.dtype.type(default))
        open_ = np.flatnonzero((held != keys) & (held != EMPTY))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != EMPTY)]
        return out
