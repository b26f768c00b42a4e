"""Numpy kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

from fieldlens.llm.support import keeps, mix64

#: An odd base, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


keeps("kernels", _powers.cache_clear)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    return _powers(base, max(1 << 20, 1 << max(0, n - 1).bit_length()))[:n]


def sums(values: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] = sum of values[k] * BASE ** k for i <= k < j."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=s[1:])
    return s


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first bytes, ends, first word of each text and the total) of the runs of other bytes than ASCII white space."""
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, stop = black.copy(), black.copy()
    begin[1:] &= ~black[:-1]
    stop[:-1] &= ~black[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    begin[borders] = black[borders]
    stop[borders - 1] = black[borders - 1]
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(stop) + 1, np.searchsorted(first, offsets)


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever the word stands."""
    s = sums(data.astype(np.uint64) + np.uint64(1))
    return mix64((s[end] - s[first]) * powers(INVERSE, len(data) + 1)[first])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k hashes, by its first one; the runs that cross a text's border are there too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * np.uint64(BASE)
        out ^= out >> np.uint64(29)
    return mix64(out)


def slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by doubling."""
    out, span = x, 1
    while span < w:
        step = min(span, w - span)
        out = np.minimum(out[:-step], out[step:])
        span += step
    return out


#: Bits of a key that hold a place; the rest order the hashes.
PLACE_BITS = 26


def minimizers(h: np.ndarray, w: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, count): each chosen place, and the windows first .. first + count - 1 whose choice it is.

    A window is w consecutive hashes; it chooses its least one, of equal ones
    the last. Equal windows hence choose the same place. valid: for each of the
    len(h) - w + 1 windows, whether it lies within a text.
    """
    mask = (1 << PLACE_BITS) - 1
    at = np.arange(len(h), dtype=np.int64)
    low = slide_min((h & ~np.uint64(mask)) | ((mask - at) & mask).astype(np.uint64), w)
    first = np.flatnonzero(valid)
    if not len(first):
        return first, first, first
    place = mask - (low[first] & np.uint64(mask)).astype(np.int64)
    place = first + ((place - first) & mask)
    start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[start], first[start], np.diff(np.append(start, len(first)))
