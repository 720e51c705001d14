"""Words of whole Arrow batches as numpy arrays, without a Python object per word.

Words are found by byte class and named by 64-bit hashes: a rolling polynomial over random byte values
(modulo 2**64, prefix sums, inverse powers), then a finisher. Equal words have equal names; that
two different words get one is less likely than 1e-6 for a billion distinct words' worth of pairs in one comparison.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20


def _libc():
    """Arrays of four megabytes and more go back to the system when they are freed: idle workers hold little (glibc; elsewhere nothing)."""
    try:
        lib = ctypes.CDLL(None)
        lib.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
        return lib.malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


_trim = _libc()


def released() -> None:
    """Give freed memory back: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    _trim(0)

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1024)
        have = np.empty(size, U)
        have[0] = 1
        have[1:] = U(base)
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finisher: every input bit moves every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def space_words() -> np.ndarray:
    """The byte table of words [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def letter_words() -> np.ndarray:
    """The byte table of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ (after A-Z became a-z)."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


class Words:
    """Words of consecutive texts: hash, start and end byte in data, and first (index of each text's first word, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool, hashed: bool = True):
        self.offsets = offsets
        self.data = lower_table()[data] if lower else data
        n = len(data)
        inside = is_word[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[cut] = inside[cut]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            sums = np.zeros(n + 1, U)
            np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * _power(_BASE_INV, n + 1)[self.start]
            self.hash = mixed(h)

    def __len__(self) -> int:
        return len(self.start)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, as if there were no texts' ends; len(h) - k + 1 values."""
    n = len(h)
    if n < k:
        return np.empty(0, U)
    if k <= 4:
        out = np.zeros(n - k + 1, U)
        for j in range(k):
            out = out * U(_BASE) + h[j : n - k + 1 + j]
        return mixed(out)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * _power(_BASE, n), out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _power(_BASE_INV, n - k + 1))


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of pieces of a batch with about `most` bytes of text; null texts are empty."""
    texts = batch.column(column)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        to = min(to, len(texts))
        yield row, to, raw[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to
    released()


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """list<kind> with counts[i] values for row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
