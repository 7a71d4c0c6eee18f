"""The first 32 bits of md5 of a head and a decimal number, for many numbers at once (hashlib takes one call each)."""
from __future__ import annotations

import math

import numpy as np

TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
LANES = 1 << 15  # numbers hashed at a time


def _word(step: int) -> int:
    return (step, 5 * step + 1, 3 * step + 5, 7 * step)[step // 16] % 16


def _messages(size: int, first: int, last: int) -> dict[int, np.ndarray]:
    """The varying words of the padded blocks: `size` bytes left open, then the decimal digits of first..last-1 (equally many)."""
    digits = len(str(first))
    tail = np.zeros((last - first, -(-(size + digits + 1) // 4) * 4), np.uint8)
    left = np.arange(first, last)
    for d in range(digits):
        left, digit = np.divmod(left, 10)
        tail[:, size + digits - 1 - d] = digit + 48
    tail[:, size + digits] = 0x80
    words = tail.view("<u4").astype(np.uint32)
    return {w: np.ascontiguousarray(words[:, w]) for w in range(size // 4, words.shape[1])}


def _digest_heads(head: bytes, digits: int, words: dict[int, np.ndarray]) -> np.ndarray:
    """First digest word, read big-endian, of md5 over the head and the digits in `words`."""
    m = len(next(iter(words.values())))
    block = head + bytes(64 - len(head))
    fixed = [int.from_bytes(block[4 * i:4 * i + 4], "little") for i in range(16)]
    fixed[14] = 8 * (len(head) + digits)
    a, b, c, d = (np.full(m, v, np.uint32) for v in START)
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(61):  # the last three steps leave the first word as it is
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        w = _word(i)
        a += np.uint32((SINES[i] + fixed[w]) & 0xFFFFFFFF)
        if w in words:
            a += words[w]
        f += a
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=t)
        f <<= np.uint32(TURNS[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(START[0])  # the value of step 61 ends as the first word
    return b.byteswap()


class Heads:
    """First 32 bits of md5 of head + decimal i for the numbers first..last-1, as hashlib gives them."""

    def __init__(self, kept: int = 1 << 20):
        self.cache: dict[tuple, dict[int, np.ndarray]] = {}
        self.kept, self.held = kept, 0  # numbers whose digits are kept for the next replicate

    def __call__(self, head: bytes, first: int, last: int) -> np.ndarray:
        out, lo = np.empty(max(last - first, 0), np.uint32), first
        while lo < last:
            digits = len(str(lo))
            hi = min(last, 10**digits, (lo // LANES + 1) * LANES)
            key = (len(head), lo, hi)
            words = self.cache.get(key)
            if words is None:
                words = _messages(len(head), lo, hi)
                if self.held + hi - lo <= self.kept:
                    self.cache[key], self.held = words, self.held + hi - lo
            out[lo - first:hi - first] = _digest_heads(head, digits, words)
            lo = hi
        return out
