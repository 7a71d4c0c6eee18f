"""Tail probabilities Spark SQL lacks, as pandas UDFs over aggregated rows.

They run on result tables (one row per feature or test), never on data rows.
"""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def signed_rank_exact(w: float, n: int) -> float:
    """P(min rank sum <= w) doubled: counts of subset sums of 1..n."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] = counts[k:] + counts[:-k].copy()
    return float(min(1.0, 2.0 * counts[: int(w) + 1].sum() / 2.0**n))


@lru_cache(maxsize=16)
def _part_counts(m: int) -> tuple[int, list[int]]:
    """L = lcm(1..m) and the coefficients of N with 1 / ((1 - x) (1 - x) (1 - x^2) ... (1 - x^m)) = N / (1 - x^L)^(m+1)."""
    period = math.lcm(*range(1, m + 1))
    coefs = [1]
    for part in (1, *range(1, m + 1)):  # times 1 + x^part + ... + x^(L - part)
        size = len(coefs) + period - part
        coefs = coefs + [0] * (size - len(coefs))
        sums = coefs[:]
        for i in range(part, size):
            sums[i] += sums[i - part]
        coefs = [v - (sums[i - period] if i >= period else 0) for i, v in enumerate(sums)]
    return period, coefs


def _partitions_upto(t: int, m: int) -> int:
    """How many partitions of 0, 1, ..., t have parts of at most m: a polynomial in t for each remainder of t by lcm(1..m)."""
    period, coefs = _part_counts(m)
    at = range(t % period, min(t + 1, len(coefs)), period)
    return sum(coefs[i] * math.comb((t - i) // period + m, m) for i in at)


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact Mann-Whitney p of either group's U.

    The counts of U are the coefficients of prod (1 - x^(n+i)) / (1 - x^i),
    i = 1..m, with m the smaller and n the larger group. Their sum up to the
    smaller U takes the numerator's at most 2^m terms by inclusion and
    exclusion, each a closed count in whole numbers: time and memory depend on
    m only (a table of (m + 1) lcm(1..m) numbers), never on n or U.
    """
    m, n = min(n1, n2), max(n1, n2)
    top = int(math.floor(min(u, n1 * n2 - u)))
    terms = {0: 1}
    for i in range(1, m + 1):
        for shift, sign in list(terms.items()):
            if shift + n + i <= top:
                terms[shift + n + i] = terms.get(shift + n + i, 0) - sign
    ways = sum(sign * _partitions_upto(top - shift, m) for shift, sign in terms.items())
    return min(1.0, 2 * ways / math.comb(n1 + n2, m))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation from its t statistic."""
    def one(rv, nv):
        if pd.isna(rv) or pd.isna(nv) or nv < 3:
            return None
        if nv == 2 or abs(rv) >= 1.0:
            return 0.0
        return t_two_sided(rv * math.sqrt((nv - 2) / (1.0 - rv * rv)), nv - 2)
    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact when the smaller group has at most 8 values and nothing ties,
    else normal with tie and continuity correction."""
    def one(uv, a, b, t):
        if pd.isna(uv) or a < 1 or b < 1:
            return None
        a, b, n = int(a), int(b), int(a + b)
        if min(a, b) <= 8 and t == 0:
            return rank_sum_exact(uv, a, b)
        var = a * b / 12.0 * ((n + 1) - t / (n * (n - 1.0)))
        if var <= 0:
            return None
        z = (max(uv, a * b - uv) - a * b / 2.0 - 0.5) / math.sqrt(var)
        return min(1.0, math.erfc(z / math.sqrt(2.0)))
    return pd.Series([one(*x) for x in zip(u, n1, n2, ties)], dtype="float64")


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    """Exact for n <= 50 without ties or zeros, else tie-corrected normal."""
    def one(wv, nv, t, z):
        if pd.isna(wv) or nv < 1:
            return None
        nv = int(nv)
        if nv <= 50 and t == 0 and z == 0:
            return signed_rank_exact(wv, nv)
        var = nv * (nv + 1) * (2 * nv + 1) / 24.0 - t / 48.0
        if var <= 0:
            return None
        return _normal_two_sided((wv - nv * (nv + 1) / 4.0) / math.sqrt(var))
    return pd.Series([one(*x) for x in zip(w, n, ties, zeros)], dtype="float64")
