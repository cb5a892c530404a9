"""Words of whole texts as 64-bit numbers, computed on the UTF-8 bytes of an Arrow column.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, so of characters
``[^\\x20\\x09-\\x0D]``. Its number is a keyed polynomial hash of its bytes; equal words have equal numbers, and two
different words share one with probability of about 2**-64 per pair.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
SLICE_BYTES = 1 << 19  # of texts that are looked at together; finding words takes some 34 times as much


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 under which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _byte_keys(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += 32
    return mix(codes + np.uint64(0x1F83D9ABFB41BD6B)) | np.uint64(1)


KEYS = {False: _byte_keys(False), True: _byte_keys(True)}
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of STEP."""
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 2 * len(_powers), 1024), STEP, dtype=np.uint64)
        factors[0] = 1
        _powers = np.multiply.accumulate(factors)
    return _powers


def bytes_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the n + 1 places where texts begin; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = texts.buffers()[2]
    data = np.zeros(0, dtype=np.uint8) if raw is None else np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``limit`` bytes together (or of one longer text)."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in ``data``; a word never goes on from one text into the next."""
    inside = ~BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    begin[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def numbers(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """The number of every word given by its place."""
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    sizes = ends - begins
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(starts, sizes)
    places = at + np.repeat(begins, sizes)
    terms = KEYS[lower][data[places]] * powers(int(sizes.max()))[at]
    return mix(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))


def words(
    texts: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, numbers of all their words, where each text's words begin) for slices of texts."""
    data, bounds = bytes_of(texts)
    for a, b in slices(bounds, limit):
        part, cuts = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
        begins, ends = spans(part, cuts)
        yield a, b, numbers(part, begins, ends, lower), np.searchsorted(begins, cuts)


def shingles(w: np.ndarray, cuts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of ``n`` words within each text, and where each text's runs begin.

    A text of fewer words (but at least one) has one run: all its words.
    """
    sizes = np.diff(cuts)
    if not len(w):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    total = np.zeros(len(w), dtype=np.uint64)
    for k in range(min(n, len(w))):
        total[: len(w) - k] += w[k:] * powers(n + 1)[k]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(cuts[1:], sizes) - np.arange(len(w))  # words from here to the end of the text
    whole = left >= n
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    for d in short:
        run = w[cuts[d] : cuts[d + 1]]
        total[cuts[d]] = (run * powers(n + 1)[: len(run)]).sum(dtype=np.uint64) + np.uint64(len(run))
    whole[cuts[short]] = True
    return mix(total[whole]), np.searchsorted(doc[whole], np.arange(len(cuts)))
