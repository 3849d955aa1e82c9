"""Arrow text columns as flat byte arrays, and the words in them.

A chunk is some whole texts of a batch, laid end to end as UTF-8: ``data`` are
their bytes and ``bounds`` the n + 1 places where they begin and end. Null texts
are empty. Chunks hold a few hundred kilobytes (or one text, if that is longer),
so the work arrays of a task stay small whatever the batch size.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
#: The white space of the word definition: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
#: 0 space, 1 letter, 2 digit, 3 symbol or control.
KIND = np.full(256, 3, np.uint8)
KIND[LETTER] = 1
KIND[48:58] = 2
KIND[SPACE] = 0

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, data, bounds) until the column is through."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64 and their inverses, at least n of each."""
    if not len(_POWERS.get("up", ())) > n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            full = np.full(size, base, U64)
            full[0] = 1
            _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"], _POWERS["down"]


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 lower-cased."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 32
    return out


class Prefix:
    """Hashes of any stretch of a chunk's bytes in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def runs(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the longest runs of one kind other than 0; runs stop at bounds."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[bounds] = True
    edges = np.flatnonzero(new)
    keep = kind[edges[:-1]] != 0
    starts, ends = edges[:-1][keep], edges[1:][keep]
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased if fold)."""
    starts, ends, row = runs(~SPACE[data], bounds)
    if not len(starts):
        return np.zeros(0, U64), row
    return Prefix(LOWER[data] if fold else data).of(starts, ends), row


def row_starts(row: np.ndarray, n: int) -> np.ndarray:
    """n + 1 places where the sorted row numbers 0 to n - 1 begin."""
    return np.searchsorted(row, np.arange(n + 1))


def sum_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]] along axis 0; 0 for empty stretches."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, at[:-1][full], axis=0)
    return out


def packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Whole numbers as compressed bytes, all lowest bytes first."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T.tobytes()
    return np.array([len(values)], "<u8").tobytes() + (pa.Codec("zstd", 1).compress(planes, asbytes=True) if planes else b"")


def unpacked(blob: bytes, kind: str = "<u4") -> np.ndarray:
    n, width = int(np.frombuffer(blob, "<u8", 1)[0]), np.dtype(kind).itemsize
    planes = pa.decompress(blob[8:], n * width, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n)


_GIVEN = [0.0]


def release() -> None:
    """Give the memory that a worker holds but doesn't use back to the machine, at most once a second: workers live through many tasks and stages."""
    if time.monotonic() - _GIVEN[0] > 1:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass
        _GIVEN[0] = time.monotonic()


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, and the worker's memory given back after the last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        release()

    return run
