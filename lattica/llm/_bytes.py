"""Byte-level numpy kernels shared by the text operators.

Texts are handled as one UTF-8 buffer with row offsets, as Arrow stores them, so that
cutting words and fingerprinting them costs a few vector passes and no Python loop a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of text handled at once; a longer text forms a piece of its own.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _MULT + np.uint64(seed))


_CODES = byte_codes(17)


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, mult: int):
        self.m, self.i = np.uint64(mult), np.uint64(pow(int(mult), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(2 * n, PIECE_BYTES) + 1
            for name, base in (("up", self.m), ("down", self.i)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = Powers(0xD6E8FEB86659FD93)


def prefix_hash(buf: np.ndarray, codes: np.ndarray = _CODES, powers: Powers = _POWERS) -> np.ndarray:
    """H with H[k] = sum of code(buf[i]) * m**i over i < k, modulo 2**64."""
    up, _ = powers.upto(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(codes[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = _POWERS) -> np.ndarray:
    """64-bit fingerprints of buf[start:end], the same wherever the bytes stand."""
    _, down = powers.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; always whole rows."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end
        row = end


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a piece of rows, lower-cased in A-Z."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = _LOWER[buf], offsets - offsets[0]
        n = len(buf)
        word = np.zeros(n + 2, np.int8)
        word[1:-1] = ~_SPACE[buf]
        edge = np.diff(word)
        begins, stops = edge[:-1] == 1, edge[1:] == -1
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        inside = (word[1:-1][cut] == 1) & (word[1:-1][cut - 1] == 1)
        begins[cut[inside]] = True  # a row's end also ends its last word
        stops[cut[inside] - 1] = True
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)  # words of row r: bounds[r]..bounds[r + 1]
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.buf), self.starts, self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def word_pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    buf, offsets = string_buffers(column)
    for a, b in pieces(offsets, limit):
        yield a, b, Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1])


_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _MULT) | np.uint64(1)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each row's word shingles, and the row of each. A row of fewer words has one: all its words."""
    h, counts = words.hashes(), words.counts
    n_of = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    rows = np.repeat(np.arange(len(counts)), n_of)
    first = np.concatenate(([0], np.cumsum(n_of)))[:-1]
    at = np.arange(int(n_of.sum())) - np.repeat(first, n_of) + np.repeat(words.bounds[:-1], n_of)
    length = np.minimum(counts, size)[rows]
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out += np.where(length > k, padded[at + k] * _STEPS[k], np.uint64(0))
    return mix(out + length.astype(np.uint64)), rows


def sorted_sets(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, one row after the other, with the rows' bounds."""
    if not len(values):
        return values, np.zeros(n_rows + 1, np.int64)
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(n_rows + 1))


def trim() -> None:
    """Gives memory that this worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary value a row from a flat array and row bounds."""
    offs = (bounds * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))])
