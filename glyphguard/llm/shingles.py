"""Word and shingle hashes of many texts at once, in numpy.

A slice of an Arrow column is hashed as one byte array: a running sum of byte codes times powers of
an odd base (modulo 2^64) gives every word's polynomial hash as a difference of two entries, and a
shingle's hash is a mixed sum of its words' hashes. The cost is a few array passes over the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = b" \t\n\x0b\x0c\r"
#: Everything in ASCII but letters and digits.
NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())

_random = np.random.Generator(np.random.PCG64(20240229))
_codes = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_exact_codes = _codes.copy()
_codes[65:91] = _codes[97:123]  # A-Z as a-z
_base = _random.integers(1, 1 << 63, 1, np.uint64) * np.uint64(2) + np.uint64(1)
_inverse = np.array([pow(int(_base[0]), -1, 1 << 64)], np.uint64)
_by_place = _random.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
KEPT_POWERS = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; a worker keeps as many as a usual slice needs."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(n, KEPT_POWERS)
    found = []
    for b in (_base, _inverse):
        steps = np.repeat(b, size)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    if size <= 2 * KEPT_POWERS:
        _powers[:] = found
    return found[0], found[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end (null: empty), and where each begins, with the end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, separators: bytes = SEPARATORS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start byte and end byte of every word of all texts, and for each text the number of its
    first word (with the total at the end). A-Z count as a-z; bytes are relative to the column's."""
    data, offsets = column_bytes(column)
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    outside = np.zeros(256, bool)
    outside[list(separators)] = True
    inside = ~outside[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(data, start, end, _codes), start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray = _exact_codes) -> np.ndarray:
    """Hash of each span of a byte array, from running sums."""
    power, inverse = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] ^ (end - start).astype(np.uint64))


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places too near the end are missing."""
    count = max(0, len(word) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out += word[k : k + count] * _by_place[k]
    return mix(out + np.uint64(n))


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; fewer words: the whole sequence as one;
    none without words."""
    word, _, _, bounds = words(column)
    every, out = grams(word, n), []
    bounds = bounds.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= n:
            found = np.sort(every[a : b - n + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            out.append(grams(word[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out
