"""Vectorised byte, word and shingle hashing over Arrow batches of texts.

All hashes are sums of byte codes times powers of an odd base in the ring of 64-bit integers. Prefix sums give the hash
of any span with two look-ups; powers have inverses there, so spans compare wherever they stand. A final mixing step
spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240611)
_CODES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Text bytes handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

WORD_SPACE = np.ones(256, bool)  # words are runs of anything but ASCII white space
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD_ALNUM = np.zeros(256, bool)  # ASCII letters, digits, and every byte of a non-ASCII character
WORD_ALNUM[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, _BASE_INV)):
                step = np.full(size, b, dtype=np.uint64)
                step[0] = 1
                _POWERS[k] = np.multiply.accumulate(step)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (n + 1) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    start, stop = int(offsets[0]), int(offsets[-1])
    bytes_ = np.frombuffer(data, dtype=np.uint8, count=stop)[start:] if data is not None and stop > start else np.zeros(0, np.uint8)
    return bytes_, offsets - start


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``limit`` bytes together, or one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(codes[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(prefix))
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inv[start])


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and the number of words of each text; ``kind`` says which bytes belong to words."""
    m = kind[data]
    first, last = np.zeros(len(m), bool), np.zeros(len(m), bool)
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    before, after = np.empty_like(m), np.empty_like(m)
    before[1:], after[:-1] = m[:-1], m[1:]
    start = np.flatnonzero(m & (first | ~before)) if len(m) else np.zeros(0, np.int64)
    end = np.flatnonzero(m & (last | ~after)) + 1 if len(m) else np.zeros(0, np.int64)
    bounds = np.searchsorted(start, offsets)
    return start, end, np.diff(bounds)


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words of each text."""
    start, end, counts = words(data, offsets, kind)
    h = prefix_hash(data, _CODES[LOWER] if lower else _CODES)
    return span_hash(h, start, end), counts


def shingles(word: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words within a text; a text of fewer words, but not none, has its whole sequence as one.
    Returns the hashes and the number of each text's."""
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.repeat(np.concatenate(([0], np.cumsum(counts)[:-1])), n)
    within = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    at = first + within
    length = np.repeat(np.minimum(counts, k), n)
    out = np.zeros(len(at), np.uint64)
    last = max(len(word) - 1, 0)
    with np.errstate(over="ignore"):
        for j in range(k):
            w = word[np.minimum(at + j, last)] if len(word) else np.zeros(0, np.uint64)
            out = np.where(j < length, out * np.uint64(_BASE) + w, out)
        out += length.astype(np.uint64)
    return mix(out), n
