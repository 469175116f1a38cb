"""Words and word n-grams of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes that are no separators. Whole batches are
hashed at once, in pieces of about a megabyte: prefix sums of a polynomial over
the bytes give every word's hash by one subtraction. Nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of the texts handled together, and of a hashed piece of a longer text.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_MIX = [np.uint64(int(x) * 2 + 1) for x in _rng.integers(1 << 61, 1 << 62, 16)]

#: Separators: all ASCII but letters and digits; or white space and control bytes alone.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SPACE = np.array([b <= 32 or b == 127 for b in range(256)])

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: The same folding for SQL: translate(text, UPPER, LOWER).
UPPER = "".join(map(chr, [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]))
LOWER = "".join(chr(ord(c) + 32) for c in UPPER)
#: SQL for the list of folded words of the column `text`.
SQL_WORDS = f"list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '')"


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _P, dtype=np.uint64), np.full(n, _PINV, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets.astype(np.int64)


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `limit` bytes."""
    if not len(column):
        return
    data, offsets = column_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the letters that Latin-1 has, in UTF-8."""
    low = _FOLD[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    low[at] += 32
    return low


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = PUNCTUATION, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of the words, and each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(len(bounds), np.int64)
    if fold:
        data = folded(data)
    word = ~separators[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = word[:-1]
    after[:-1] = word[1:]
    before[bounds[:-1][bounds[:-1] < n]] = False
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _powers(max(20, (hi - lo).bit_length()))
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUES[data[lo:hi]] * up[: hi - lo], out=sums[1:])
        hashes[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * down[starts[a:b] - lo]
        a = b
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends, np.searchsorted(starts, bounds)


def owners(first: np.ndarray) -> np.ndarray:
    """The text each element belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `n` words within a text, and each text's first run."""
    total = max(0, len(hashes) - n + 1)
    grams = np.zeros(total, np.uint64)
    for k in range(n):
        grams += hashes[k : k + total] * _MIX[k % 16] + np.uint64(k)
        if n > 16:
            grams = grams * _MIX[0]
    counts = np.maximum(np.diff(first) - n + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], counts)
    return mix(grams[at]), starts
