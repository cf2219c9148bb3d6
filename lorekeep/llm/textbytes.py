"""Vectorised work on the UTF-8 bytes of a column of texts.

Everything here takes whole Arrow columns a bounded slice at a time, so a
Python worker's memory depends on the slice size (plus the longest single
text), never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_U = np.uint64
#: Strings are hashed as polynomials of their bytes at a fixed random point, modulo a prime: two different ones of n bytes agree for n of about 2 ** 61 points.
_PRIME = (1 << 61) - 1
_POINT = 0x1D3F84A5B7C6E291 % _PRIME
#: Powers that are kept; longer tables are made when they are needed.
_KEPT = 1 << 21

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true inside the given inclusive spans."""
    table = np.zeros(256, dtype=bool)
    for first, last in spans:
        table[first : last + 1] = True
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row behind the last, bytes, offsets from 0) with about ``most`` bytes each."""
    raw, at = text_buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        last = min(last, rows)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _folded(x: np.ndarray) -> np.ndarray:
    """Any 64-bit number modulo the prime."""
    x = (x & _U(_PRIME)) + (x >> _U(61))
    return np.where(x >= _U(_PRIME), x - _U(_PRIME), x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by halves of 31 bits."""
    low = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & low, b >> _U(31), b & low
    middle = a1 * b0 + a0 * b1
    return _folded(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _U((1 << 30) - 1)) << _U(31)) + a0 * b0)


_tables: dict[int, np.ndarray] = {}


def _powers(of: int, n: int) -> np.ndarray:
    """of ** 0 .. of ** (n - 1) modulo the prime."""
    out = _tables.get(of, np.ones(1, dtype=np.uint64))
    while len(out) < n:
        out = np.concatenate([out, _times(out, _U(pow(of, len(out), _PRIME)))])
    if len(out) <= _KEPT:
        _tables[of] = out
    return out[:n]


_BACK = pow(_POINT, -1, _PRIME)


#: Bytes whose products of 39 bits can be summed in 64.
_MOST = 1 << 24


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """(2, bytes + 1): sums of byte values times the powers' upper and lower halves; ``between`` takes any stretch's hash from them."""
    value, power = data.astype(np.uint64) + _U(1), _powers(_POINT, len(data))
    out = np.zeros((2, len(data) + 1), dtype=np.uint64)
    np.cumsum(value * (power >> _U(31)), out=out[0, 1:])
    np.cumsum(value * (power & _U((1 << 31) - 1)), out=out[1, 1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash, below 2 ** 61, of data[start:end], wherever it stands."""
    total, at = np.zeros(len(starts), dtype=np.uint64), starts
    while True:
        upto = np.minimum(at + _MOST, ends)
        high, low = sums[:, upto] - sums[:, at]
        total = _folded(total + _folded((high >> _U(30)) + ((high & _U((1 << 30) - 1)) << _U(31)) + low))
        if (upto == ends).all():
            break
        at = upto
    return _times(total, _powers(_BACK, int(starts.max()) + 1 if len(starts) else 1)[starts])


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit content hashes of data[start:end]."""
    return mix(between(prefix_sums(data), starts, ends) + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """The words of some texts: byte spans, the row each belongs to, and where each row's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in ``inside``, A-Z lower-cased, none across two rows."""
    low = LOWER[data]
    mask = inside[low]
    n, rows = len(low), len(offsets) - 1
    before = np.zeros(n, dtype=bool)
    before[1:] = mask[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = mask[1:]
    some = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[some] = False
    after[some[some > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(first))
    return Words(low, starts, ends, row, first)
