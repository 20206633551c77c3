"""Hashed word shingles of Arrow text columns, a slice of a batch at a time.

Words are the runs of bytes other than ``[\\x20\\x09-\\x0D]``, with A-Z lowered. All
words of a slice are hashed at once: a word's hash is a difference of prefix sums of
``random(byte) * base ** position`` (mod 2**64), brought back to position 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice, unless one text alone has more.
SLICE_BYTES = 1 << 18

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept between slices."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_BACK, n)
        return self.up[:n], self.down[:n]


_KEPT = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text array without nulls, and where each text starts and the last ends."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or starts[-1] == starts[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(data: np.ndarray, starts: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` (SLICE_BYTES, if None) bytes together."""
    size = SLICE_BYTES if size is None else size
    first, n = 0, len(starts) - 1
    while first < n:
        last = int(np.searchsorted(starts, starts[first] + size, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and how many words each text has."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(starts) - 1, np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    begins = np.flatnonzero(word & (cut[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (cut[1:] | np.concatenate((~word[1:], [True])))) + 1
    counts = np.diff(np.searchsorted(begins, starts))
    return begins, ends, counts


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _KEPT.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[begins]) * down[begins]
    return mixed(h + (ends - begins).astype(np.uint64))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text with fewer words gives its whole sequence as one shingle; a text without
    words (or null) gives none.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    data, starts = buffers(texts)
    for first, last in slices(data, starts):
        part = data[starts[first] : starts[last]]
        local = starts[first : last + 1] - starts[first]
        begins, ends, counts = word_bounds(part, local)
        words = word_hashes(part, begins, ends)
        at = 0
        for n in counts.tolist():
            own = words[at : at + n]
            at += n
            if not n:
                yield own
                continue
            k = min(width, n)
            h = own[: n - k + 1].copy()
            for j in range(1, k):
                h = h * _STEP + own[j : n - k + 1 + j]
            h = mixed(h + np.uint64(k))
            h.sort()
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
