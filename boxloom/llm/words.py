"""Tokenising and hashing whole Arrow text columns with numpy.

Words are found on the UTF-8 bytes: a separator is always an ASCII byte, so bytes
from 0x80 up belong to words. A word's 64-bit hash is a polynomial over random byte
values, taken for all words of a chunk at once from one running sum. Chunks hold
whole texts, so memory follows the chunk (and the longest text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_U = np.uint64


def _table(separators: set[int]) -> np.ndarray:
    return np.array([b not in separators for b in range(256)])


#: Bytes that belong to words ``[^\x20\x09-\x0D]+``.
SPACED = _table({0x20, *range(0x09, 0x0E)})
#: Bytes that belong to words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower case.
ALNUM = _table({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _byte_values(fold_case: bool) -> np.ndarray:
    source = np.arange(256, dtype=np.uint64)
    if fold_case:
        source[65:91] += _U(32)
    return mix(source + _U(0x1234567)) | _U(1)


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}


def _power_table(factor: int, size: int) -> np.ndarray:
    steps = np.full(size, factor, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


@dataclass
class Chunk:
    """Words of consecutive rows. Row ``i`` owns words ``bounds[i]:bounds[i + 1]``."""

    first: int
    data: np.ndarray
    rows: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_of(self) -> np.ndarray:
        """The row of every word, counted from the chunk's first."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def left(self) -> np.ndarray:
        """How many words of its row follow each word, itself included."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))


def text_column(values: pa.Array) -> pa.Array:
    """The column as large strings without nulls (null counts as empty)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(pa.large_string()).fill_null("")


def chunks(values: pa.Array, word_bytes: np.ndarray, fold_case: bool) -> Iterator[Chunk]:
    """Words of every row of a text column, in chunks of whole rows.

    Null and empty texts have no words; rows keep their order and none is skipped.
    """
    values = text_column(values)
    n = len(values)
    if n == 0:
        return
    _, offsets_buffer, data_buffer = values.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.empty(0, np.uint8)
    longest = max(CHUNK_BYTES, int(np.diff(offsets).max())) + 1
    longest = min(longest, int(offsets[-1] - offsets[0]) + 1)
    powers, inverses = _power_table(_MULTIPLIER, longest), _power_table(_INVERSE, longest)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield _chunk(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first],
                     word_bytes, fold_case, powers, inverses)
        first = last


def _chunk(first: int, data: np.ndarray, rows: np.ndarray, word_bytes: np.ndarray, fold_case: bool,
           powers: np.ndarray, inverses: np.ndarray) -> Chunk:
    size = len(data)
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = rows[(rows > 0) & (rows < size)]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_VALUES[fold_case][data] * powers[:size], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts])
    return Chunk(first, data, rows, np.searchsorted(starts, rows), starts, ends, hashes)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive values from each place on; the last ones wrap
    into zeros and are to be masked by the caller."""
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(min(size, n)):
        factor = factor * _MULTIPLIER % (1 << 64)
        out[: n - k] += hashes[k:] * _U(factor)
    return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column whose row ``i`` takes the next ``counts[i]`` values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
