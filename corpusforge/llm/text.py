"""Vectorised text helpers that run inside Spark tasks on Arrow batches.

Nothing here holds more than one slice of a batch: `slices` cuts an Arrow batch
so that the NumPy temporaries of a slice stay small whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(0x5EED)
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
RADIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table_of(chars: bytes | set[int]) -> np.ndarray:
    """Boolean lookup over the 256 byte values."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: ASCII white space: what `[\x20\x09-\x0D]` matches.
SPACE = table_of({0x20, *range(0x09, 0x0E)})
NOT_SPACE = ~SPACE
#: Digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = table_of({*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i modulo 2**64 for i up to n, rounded up to a power of two and kept."""
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(RADIX), -1, 2**64))
        both = []
        for base in (RADIX, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Each batch in row slices whose texts hold about max_bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and the offset of each row; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the index of its first word (with one more at the end)."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, and each row's offset in them.

    A row with fewer words, but not none, has its whole sequence as its one run.
    """
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=at[1:])
    row = np.repeat(np.arange(len(counts)), made)
    start = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    out = np.full(at[-1], 0x1234567, np.uint64)
    left = counts[row]
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        out = out * RADIX + np.where(k < left, padded[start + k], np.uint64(0))
    return mix(out + np.minimum(left, size).astype(np.uint64)), at


def hash_one(word: bytes) -> int:
    """word_hashes for one word."""
    data = np.frombuffer(word, np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def as_long(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of equal bits."""
    return x.view(np.int64)
