"""Keyed permutations of 0..n-1, evaluated place by place.

A place x is split into (l, r) = (x // b, x % b) with a = ceil(sqrt(n)) and
b = ceil(n / a). In turn l is shifted modulo a by a function of r and r modulo
b by a function of l. Every such round is one-to-one on the a * b places; a
result of n or more goes through the rounds again until it is below n, which
makes the whole one-to-one on 0..n-1. The shifts are cubic polynomials modulo
2^31 - 1 whose coefficients are md5 digits of 'seed:replicate:round', so a
replicate needs its key only: no sort, no exchange, and an inverse as cheap.
Where a and b are odd and a * b = n, only the even permutations occur.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence
from math import isqrt

import numpy as np

PRIME = 2**31 - 1
ROUNDS = 6


def sides(n: int) -> tuple[int, int]:
    a = isqrt(max(n, 1) - 1) + 1
    return a, max(-(-n // a), 1)


class Permutations:
    """The permutations of the replicates `reps`; row i of a result is that of reps[i]."""

    def __init__(self, seed: int, reps: Sequence[int], n: int):
        self.n, self.reps = n, len(reps)
        self.a, self.b = sides(n)
        self.shifts = []
        for i in range(ROUNDS):
            digits = [hashlib.md5(f"{seed}:{rep}:{i}".encode()).hexdigest() for rep in reps]
            c = np.array([[int(h[j:j + 8], 16) % PRIME for j in range(0, 32, 8)] for h in digits], np.int64).reshape(-1, 4, 1)
            modulus, values = (self.a, self.b) if i % 2 == 0 else (self.b, self.a)
            v = np.arange(values, dtype=np.int64)
            f = c[:, 3] * v
            for j in (2, 1, 0):
                f = (f + c[:, j]) % PRIME
                f = f * v if j else f
            self.shifts.append((f % modulus).ravel())

    def _rounds(self, rep: np.ndarray, x: np.ndarray, back: bool) -> np.ndarray:
        l, r = np.divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2 == 0:
                l = _shift(l, self.shifts[i][rep * self.b + r], self.a, back)
            else:
                r = _shift(r, self.shifts[i][rep * self.a + l], self.b, back)
        return l * self.b + r

    def __call__(self, pos: np.ndarray, back: bool = False) -> np.ndarray:
        """Images (inverse images with `back`) of `pos`: one row per replicate."""
        rep = np.repeat(np.arange(self.reps), len(pos))
        x = self._rounds(rep, np.tile(np.asarray(pos, np.int64), self.reps), back)
        out = np.flatnonzero(x >= self.n)
        while len(out):
            x[out] = self._rounds(rep[out], x[out], back)
            out = out[x[out] >= self.n]
        return x.reshape(self.reps, len(pos))


def _shift(v: np.ndarray, by: np.ndarray, modulus: int, back: bool) -> np.ndarray:
    v = v - by if back else v + by
    return np.where(v < 0, v + modulus, v) if back else np.where(v >= modulus, v - modulus, v)
