"""Vectorised word tokens over Arrow string columns: byte spans, 64-bit word hashes and shingle hashes.

Every function works on the UTF-8 bytes of many texts at once, in slices of a bounded number of bytes, so memory
does not depend on the batch Spark sends. ASCII letters are folded; other bytes are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93

#: Byte classes: words separated by white space only, and words of digits, ASCII letters and non-ASCII bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalizer of splitmix64, a bijection of 64-bit words."""
    x = x + _U(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BYTE = mix(_FOLD.astype(_U), 7)
_INVERSE = pow(_BASE, -1, 2**64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, _U), np.full(size, _INVERSE, _U)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U))
    return _powers


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) for runs of rows of at most `most` bytes, or of one row. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word; bounds[r]:bounds[r + 1] are the words of row r."""
    n = len(data)
    inside = table[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z folded."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingle hashes: runs of `width` words, or the whole row if it has fewer."""
    total = np.zeros(max(0, len(words) - width + 1), _U)
    for k in range(width):
        total = total * _U(_STEP) + words[k : k + len(total)]
    total = mix(total, width)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= width:
            own = np.sort(total[lo : hi - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            out.append(own)
        elif hi == lo:
            out.append(np.zeros(0, _U))
        else:
            one = 0
            for w in words[lo:hi].tolist():
                one = (one * _STEP + w) & (2**64 - 1)
            out.append(mix(np.array([one], _U), hi - lo))
    return out


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal `key` in batches that are sorted by it, also where a run goes over several batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = np.asarray(table.column(key))
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[lo] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.concat_tables(held)
