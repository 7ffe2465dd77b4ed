"""Vectorised words, word hashes and shingle hashes over Arrow string batches.

A word is a maximal run of bytes outside U+0020 and U+0009..U+000D after A-Z
are lower-cased; no other character is changed.  Texts are worked on in blocks
of about ``BLOCK_BYTES`` so that memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: inverse of _MULT modulo 2**64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets from 0) of runs of whole rows; at least one row each."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, row) of every word of a block, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    low = _LOWER[data]
    is_word = _IS_WORD[low]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | first[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | first[1:n]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power("mult", _MULT, n), out=total[1:])
    hashed = (total[end] - total[start]) * _power("inv", _INV, n)[start]
    hashed = mix64(hashed ^ (end - start).astype(np.uint64))
    row = np.searchsorted(offsets, start, side="right") - 1
    return hashed, start, end, row


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes (rows are not looked at)."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = out * _MULT + hashed[k : k + n]
    return mix64(out)


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Yield (first row, sorted distinct shingle hashes of each row).

    With fewer than ``size`` words the whole sequence is one shingle; with no
    word the set is empty.
    """
    for first_row, data, offsets in blocks(column):
        hashed, _, _, row = words(data, offsets)
        n = len(offsets) - 1
        bounds = np.searchsorted(row, np.arange(n + 1))
        runs = shingles(hashed, size)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(runs[a : b - size + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                s = shingles(np.concatenate((hashed[a:b], np.full(size - (b - a), b - a, np.uint64))), size)
            else:
                s = runs[:0]
            out.append(s)
        yield first_row, out
