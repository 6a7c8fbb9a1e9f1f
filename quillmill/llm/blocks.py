"""Whole texts as one byte array per batch, with words and hashes by array operations.

White space is \\x20 and \\x09-\\x0D, all single bytes of UTF-8, so cutting the bytes into words
gives what the pattern [^\\x20\\x09-\\x0D]+ finds in the text. A word's hash is a polynomial in a
fixed odd base over a fixed random table of 64-bit letters, then mixed; equal words have equal
hashes in every batch and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_power = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every bit of the result depends on all bits of h."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        for k, b in ((0, _BASE), (1, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _power[k] = np.cumprod(p, dtype=np.uint64)
    return _power[0], _power[1]


def prefix_sums(data: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """n + 1 running sums of letter * base**position, modulo 2**64."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(letters[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each byte span, the same wherever the span stands."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, n + 1 offsets) of runs of whole texts; null: empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    wide = pa.types.is_large_string(text.type)
    n = len(text)
    at = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32, n + 1 + text.offset)[text.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    if text.null_count:  # a null may have bytes behind it
        size = np.where(np.asarray(text.is_valid()), np.diff(at), 0)
        if (size != np.diff(at)).any():
            text = text.fill_null("")
            yield from slices(text, limit)
            return
    buffer = text.buffers()[2] if n else None
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """The words of the texts of one slice: start and end bytes, document index, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False):
        self.data, self.offsets = data, offsets
        word = np.empty(len(data) + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(SPACE[data], out=word[1:-1])
        first = word[1:-1] & ~word[:-2]
        last = word[1:-1] & ~word[2:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]  # a text's edge parts words too
        first[edge] |= word[1 + edge]
        last[edge - 1] |= word[edge]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words of document k: first[k] to first[k + 1].
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.sums = prefix_sums(data, _FOLDED if fold else _LETTERS)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.sums, self.start, self.end)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The mixed hash of each k consecutive entries: len(h) - k + 1 of them, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += h[j : j + n]
    return mix(out)
