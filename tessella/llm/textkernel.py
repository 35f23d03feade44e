"""Vectorised word scanning and hashing over Arrow string batches.

Everything works on the UTF-8 bytes of a run of rows at once. Words are runs of bytes of a class; as every
class used here treats all bytes from 0x80 alike, runs of bytes are runs of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles, unless one row alone is longer.
CHUNK = 1 << 19
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SHIFT = np.uint64(33)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of each value over the whole word, in place."""
    h ^= h >> SHIFT
    h *= MIX1
    h ^= h >> SHIFT
    h *= MIX2
    h ^= h >> SHIFT
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTE_CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_cache: dict[str, np.ndarray] = {"up": _powers(BASE, 1), "down": _powers(BASE_INV, 1)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache["up"]) < n:
        size = max(n, 1 << 16)
        _cache.update(up=_powers(BASE, size), down=_powers(BASE_INV, size))
    return _cache["up"], _cache["down"]


def byte_class(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], bool)


#: Runs between blank characters, unchanged.
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, letters and everything beyond ASCII.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, ends


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``CHUNK`` bytes."""
    data, ends = raw(column)
    row, n = 0, len(ends) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, "right")) - 1)
        yield row, stop, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


class Words:
    """The words of a run of rows: byte starts and ends, hashes, and the first word of every row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = keep[data]
        n = len(data)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        i = 0
        while i < len(out):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + CHUNK, "right")))
            block = self.data[at : self.ends[j - 1]]
            up, down = powers(len(block) + 1)
            total = np.zeros(len(block) + 1, np.uint64)
            np.cumsum(_BYTE_CODE[block] * up[: len(block)], out=total[1:])
            s, e = self.starts[i:j] - at, self.ends[i:j] - at
            h = (total[e] - total[s]) * down[s]
            h ^= (e - s).astype(np.uint64) * MIX2
            out[i:j] = mixed(h)
            i = j
        return out

    def rows(self) -> np.ndarray:
        """The row of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words of one row, and where they start."""
        n = len(self.hashes)
        limit = np.repeat(self.first[1:], self.counts) - size
        at = np.flatnonzero(np.arange(n) <= limit)
        return sequence_hash(self.hashes, at, size, salt), at

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def sequence_hash(values: np.ndarray, at: np.ndarray, size: int | np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash of ``values[i : i + size]`` for each i of ``at``, the same wherever the run stands."""
    source = mixed(values ^ np.uint64(salt)) if salt else values
    up, down = powers(len(source) + 1)
    total = np.zeros(len(source) + 1, np.uint64)
    np.cumsum(source * up[: len(source)], out=total[1:])
    h = (total[at + size] - total[at]) * down[at]
    h ^= (np.asarray(size).astype(np.uint64).reshape(-1) + np.uint64(salt)) * MIX1
    return mixed(h)
