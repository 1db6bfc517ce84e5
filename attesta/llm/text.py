"""Arrow text columns as flat byte arrays, and hashes over them. Used inside tasks; whole texts, null read as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

TILE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: The byte values of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse; tables grow by doubling."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, TILE_BYTES * 2)
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: close values end far apart."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2^64; the hash of any substring follows from two of them."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them, starting at 0."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def tiles(batches: Iterator[pa.RecordBatch], text: str, size: int = TILE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about ``size`` text bytes with their flat bytes and offsets; a longer text is a slice of its own."""
    for batch in batches:
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
            yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the word offsets of the rows. A word never crosses rows."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each unit."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0].. of length lengths[0], then those of the next run, and so on."""
    total = np.cumsum(lengths)
    out = np.arange(total[-1] if len(total) else 0)
    return out + np.repeat(starts - (total - lengths), lengths)
