"""MD5 of consecutive numbers behind a prefix, in numpy.

Each of the 64 steps is a few operations over thousands of texts. Texts of a block differ in their
last digits only, so all but two of their sixteen words are plain numbers.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np

#: Texts hashed at once: a block's arrays stay in the cache of a core.
BLOCK_TEXTS = 20_000
#: Texts of a block share all but so many last digits; with three bytes before them they fill two words.
_TAIL_DIGITS = 5
#: Longest text that fills one block of MD5; longer ones are hashed one by one.
_MAX_BYTES = 55

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [(a * i + b) % 16 for i in range(64) for a, b in [((1, 0), (5, 1), (3, 5), (7, 0))[i // 16]]]


@lru_cache
def _tails(digits: int) -> np.ndarray:
    """All numbers of so many digits, with leading zeros, as text: the first character in the lowest byte."""
    numbers = np.arange(10**digits, dtype=np.uint64)
    texts = np.zeros_like(numbers)
    for i in range(digits):
        digit = numbers // np.uint64(10 ** (digits - 1 - i)) % np.uint64(10) + np.uint64(ord("0"))
        texts |= digit << np.uint64(8 * i)
    return texts


def _mixed(step: int, b: np.ndarray, c: np.ndarray, d: np.ndarray, out: np.ndarray) -> None:
    if step < 16:
        np.bitwise_xor(c, d, out)
        np.bitwise_and(out, b, out)
        np.bitwise_xor(out, d, out)
    elif step < 32:
        np.bitwise_xor(b, c, out)
        np.bitwise_and(out, d, out)
        np.bitwise_xor(out, c, out)
    elif step < 48:
        np.bitwise_xor(b, c, out)
        np.bitwise_xor(out, d, out)
    else:
        np.invert(d, out)
        np.bitwise_or(out, b, out)
        np.bitwise_xor(out, c, out)


def _first_digits(head: bytes, tails: np.ndarray, digits: int) -> np.ndarray:
    padded = (head + bytes(digits) + b"\x80").ljust(56, b"\0") + struct.pack("<Q", 8 * (len(head) + digits))
    words = struct.unpack("<16I", padded)
    at, skipped = divmod(len(head), 4)
    moved = tails << np.uint64(8 * skipped)
    varying = {
        at: moved.astype(np.uint32) + np.uint32(words[at]),  # the lower half
        at + 1: (moved >> np.uint64(32)).astype(np.uint32) + np.uint32(words[at + 1]),
    }
    a, b, c, d = (np.full(len(tails), word, np.uint32) for word in _START)
    mixed = np.empty_like(a)
    for step, (shift, sine, word) in enumerate(zip(_SHIFTS, _SINES, _WORDS)):
        _mixed(step, b, c, d, mixed)
        np.add(a, mixed, a)
        if word in varying:
            np.add(a, varying[word], a)
            np.add(a, np.uint32(sine), a)
        else:
            np.add(a, np.uint32((sine + words[word]) % 2**32), a)
        np.right_shift(a, np.uint32(32 - shift), mixed)
        np.left_shift(a, np.uint32(shift), a)
        np.bitwise_or(a, mixed, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    digest = np.empty((len(tails), 2), "<u4")
    np.add(a, np.uint32(_START[0]), digest[:, 0])
    np.add(b, np.uint32(_START[1]), digest[:, 1])
    return digest.view(">u8").ravel().astype(np.uint64) >> np.uint64(4)


def md5_numbers(prefix: bytes, start: int, stop: int) -> Iterator[np.ndarray]:
    """The first 15 digits of the MD5 text of ``prefix`` and each decimal number of a range, as numbers.

    Arrays follow one another, of ``BLOCK_TEXTS`` at most.
    """
    while start < stop:
        text = b"%d" % start
        digits = min(len(text), _TAIL_DIGITS)
        low = start % 10**digits
        high = min(low + stop - start, 10**digits, low + BLOCK_TEXTS)
        if len(prefix) + len(text) <= _MAX_BYTES:
            yield _first_digits(prefix + text[:-digits], _tails(digits)[low:high], digits)
        else:
            digests = [md5(prefix + b"%d" % (start + i), usedforsecurity=False).digest() for i in range(high - low)]
            yield np.frombuffer(b"".join(digests), ">u8")[::2].astype(np.uint64) >> np.uint64(4)
        start += high - low
