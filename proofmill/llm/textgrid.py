"""Byte-level numpy views of Arrow string batches: words, hashes and windows.

Every helper works on the UTF-8 bytes of a slice of rows.  White space of the
word rule ``[^\\x20\\x09-\\x0D]+`` is ASCII, so byte positions split words
exactly whatever the script.  Slices are bounded by bytes (one longer text is a
slice of its own), which bounds the memory of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Rows lo..hi of a batch: their bytes and the offset of each row's text (null: empty)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def text_slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Bounded slices of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end], equal for equal bytes.

    Each block of eight bytes is mixed with its number before blocks are added
    up, so no sum of two blocks can stand for that of two others by design.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = (ends - starts).astype(np.int64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    keep = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    total = mix((at[starts] & keep[np.minimum(size, 8)]) ^ _FIRST)
    long_ = np.flatnonzero(size > 8)
    if len(long_):
        blocks = (size[long_] - 1) // 8
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks) + 1
        rest = np.repeat(size[long_], blocks) - 8 * number
        block = at[np.repeat(starts[long_], blocks) + 8 * number] & keep[np.minimum(rest, 8)]
        total[long_] += np.add.reduceat(mix(block ^ mix(number.astype(np.uint64) * _BASE + _FIRST)), first)
    return mix(total + size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


@dataclass
class Words:
    """Words of a slice: byte starts and ends, the row of each, and each row's first word (rows + 1 bounds)."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    bounds: np.ndarray


def words(s: Slice, gap: np.ndarray = SPACE) -> Words:
    """Runs of bytes that aren't gaps; a row's end always ends a word."""
    n = len(s.data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = ~gap[s.data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = solid[:n]
    cut = np.zeros(n + 1, bool)
    cut[s.offsets] = True
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    bounds = np.searchsorted(starts, s.offsets, side="left")
    row = np.repeat(np.arange(s.rows), np.diff(bounds))
    return Words(starts, ends, row, bounds)


def window_hash(units: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of each k consecutive units (len - k + 1 of them; none if shorter)."""
    n = len(units) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= base
        total += units[j : j + n]
    return mix(total + np.uint64(k))


def window_valid(row: np.ndarray, k: int) -> np.ndarray:
    """True where k consecutive units stay in one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1 :] if n > 0 else np.zeros(0, bool)
