"""Keyed draws with replacement from 0..n-1, found range by range.

A replicate draws n numbers; draw i is known by its number. The places 0..n-1
are cut into ranges of SPAN. How many of the draws first..last-1 fall into a
range is found by halving the ranges: of m draws over some ranges a Binomial
number falls into the left half, from a generator whose key is md5 of
'seed:replicate:first:ranges'. Inside its range, draw i takes the first 32 bits
of md5 of 'seed:replicate:i' modulo the range's length. A task that holds one
range thus finds its draws without those of any other, and ranges together
give independent uniform draws. Up to SPAN places there is one range, and
every draw is the plain hash modulo n.
"""
from __future__ import annotations

from hashlib import md5

import numpy as np

from .md5heads import Heads

SPAN = 1 << 18


class Draws:
    def __init__(self, seed: int, n: int, span: int | None = None):
        self.seed, self.n, self.span = seed, n, span or SPAN
        self.ranges = max(1, -(-n // self.span))
        self.heads = Heads()

    def blocks(self, k: int) -> list[tuple[int, int, int]]:
        """(block, first, last) draws of k consecutive folds, the first n mod k one longer; empty ones are left out."""
        edges = np.cumsum([0, *[self.n // k + (i < self.n % k) for i in range(k)]])
        return [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]

    def share(self, rep: int, first: int, last: int, at: int) -> tuple[int, int]:
        """The draws among first..last-1 that fall into range `at`, as (from, to)."""
        a, b, lo, hi = first, last, 0, self.ranges
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = (mid - lo) * self.span / (min(hi * self.span, self.n) - lo * self.span)
            key = md5(f"{self.seed}:{rep}:{first}:{lo}-{hi}".encode()).digest()
            cut = a + int(np.random.RandomState(np.frombuffer(key, "<u4")).binomial(b - a, left))
            if at < mid:
                b, hi = cut, mid
            else:
                a, lo = cut, mid
        return a, b

    def inside(self, rep: int, first: int, last: int, at: int) -> np.ndarray:
        """Places drawn in range `at`, counted from its start."""
        a, b = self.share(rep, first, last, at)
        bits = self.heads(b"%d:%d:" % (self.seed, rep), a, b)
        return bits.astype(np.int64) % (min(self.span, self.n - at * self.span))

    def places(self, rep: int, first: int, last: int) -> np.ndarray:
        """Places drawn, over all ranges."""
        return np.concatenate([at * self.span + self.inside(rep, first, last, at) for at in range(self.ranges)])
