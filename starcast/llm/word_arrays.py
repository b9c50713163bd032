"""Words of whole Arrow text columns as arrays of 64-bit hashes, and such arrays packed by bucket for a shuffle.

The hash of a word depends on its bytes only: a polynomial over random values of the bytes, taken from prefix sums, so
no word becomes a Python object. Texts are hashed in pieces of bounded size; what is kept is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Bytes of text whose words are handled together.
SLICE = 4 << 20
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return scramble(left * _C + (right ^ (right >> np.uint64(32))) * _B + np.uint64(1))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words from each place on, from hashes of half the length."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    reach = 1
    while 2 * reach <= length:
        words = pair(words[:-reach], words[reach:])
        reach *= 2
    return pair(words[: -(length - reach)], words[length - reach :]) if reach < length else words


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(
        np.cumprod(np.append(np.uint64(1), np.full(count, base, np.uint64)), dtype=np.uint64) for base in (_BASE, inverse)
    )


_VALUES = scramble(np.arange(1, 257, dtype=np.uint64) * _C)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks the bytes that stand between words; each range holds its ends."""
    marks = np.zeros(256, bool)
    for low, high in ranges:
        marks[low : high + 1] = True
    return marks


WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes, and the bounds of the rows in them, for runs of rows with about ``limit`` bytes.

    A longer text is a run of its own.
    """
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _hash_piece(data: np.ndarray, between: np.ndarray, bounds: np.ndarray, values: np.ndarray) -> tuple:
    inside = ~between[data]
    outside = ~inside
    first, last = inside.copy(), inside.copy()
    first[1:] &= outside[:-1]
    last[:-1] &= outside[1:]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[bounds] = inside[bounds]
    last[bounds - 1] = inside[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(max(PIECE, len(data)))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * power[: len(data)], out=sums[1:])
    return scramble((sums[end] - sums[start]) * inverse[start]), start


def hash_words(
    data: np.ndarray, bounds: np.ndarray, between: np.ndarray = WHITE_SPACE, lower: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and row of each word of adjoining texts. ``lower``: A-Z count as a-z."""
    values = _VALUES
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    hashes, starts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    begin = 0
    while begin < len(data):
        end = begin + PIECE
        while end < len(data):
            # Cut behind the last separator, or read on if a word fills the piece.
            cuts = np.flatnonzero(between[data[begin:end]])
            if len(cuts):
                end = begin + int(cuts[-1]) + 1
                break
            end += PIECE
        end = min(end, len(data))
        own = bounds[np.searchsorted(bounds, begin) : np.searchsorted(bounds, end)] - begin
        found, start = _hash_piece(data[begin:end], between, own, values)
        hashes.append(found)
        starts.append(start + begin)
        begin = end
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.searchsorted(bounds, starts, side="right") - 1


def buckets_of(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """A bucket for each key, from other bits than the low ones."""
    mixed = ((keys * _C) >> np.uint64(33)) % np.uint64(n_buckets)
    return mixed.astype(np.uint16 if n_buckets <= 1 << 16 else np.int32)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def binary_array(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Each run of values between two edges as one binary value."""
    offsets = (edges * values.itemsize).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), data])


def numbers(column: pa.Array | pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    """The numbers held by each binary value."""
    return [np.frombuffer(value.as_buffer(), kind) for value in column]
