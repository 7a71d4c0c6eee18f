"""Tail probabilities as DuckDB SQL expressions, for the SQL twins of rank tests."""
from __future__ import annotations

STEPS = 4000


def _simpson(density, upper: str) -> str:
    """The integral of `density(x)` from 0 to `upper`."""
    weight = f"CASE WHEN k = 0 OR k = {STEPS} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    at = f"(k * ({upper}) / {STEPS}.0)"
    return f"(({upper}) / {3 * STEPS}.0 * list_sum(list_transform(range({STEPS + 1}), lambda k: ({weight}) * {density(at)})))"


def normal_two_sided(z: str) -> str:
    """2 * (1 - Phi(z)); above 1 for negative z."""
    return f"(1 - 2 * {_simpson(lambda x: f'exp(-{x} * {x} / 2) / sqrt(2 * pi())', z)})"


def correlation_p(r: str, n: str) -> str:
    """Two-sided p of a correlation of n pairs from its t statistic."""
    df = f"(({n}) - 2)"
    # With sin(a) = r the t density is proportional to cos(a)^(df - 1): no tail to cut off.
    density = lambda a: f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * pow(cos({a}), {df} - 1)"
    return (f"CASE WHEN ({r}) IS NULL OR ({n}) < 3 THEN NULL WHEN abs({r}) >= 1 THEN 0.0 "
            f"ELSE greatest(0.0, 1 - 2 * {_simpson(density, f'asin(least(1.0, abs({r})))')}) END")


def signed_rank_p(w: str, n: str, ties: str) -> str:
    """Normal approximation of the signed-rank test with tie correction (more than 50 pairs, or ties or zeros)."""
    z = f"abs(({w}) - ({n}) * (({n}) + 1) / 4.0) / sqrt(({n}) * (({n}) + 1) * (2 * ({n}) + 1) / 24.0 - ({ties}) / 48.0)"
    return normal_two_sided(z)


def mann_whitney(groups: str) -> str:
    """`groups` (feature, n1, n2, u, ties) with p_value.

    Exact for at most 8 values in the smaller group without ties: the counts of U come from
    prod (1 - x^(n + i)) / (1 - x^i), one factor a step.
    """
    z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1.0))))"
    part = lambda x: f"list_sum(list_transform(range(({x}) // (i + 1) + 1), lambda j: a[({x}) - j * (i + 1) + 1]))"
    return f"""WITH RECURSIVE gr AS MATERIALIZED ({groups}),
  c AS (SELECT feature, least(n1, n2) AS m, greatest(n1, n2) AS n, 0::BIGINT AS i,
      list_transform(range(n1 * n2 + 1), lambda x: CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS a
    FROM gr WHERE least(n1, n2) BETWEEN 1 AND 8 AND ties = 0
    UNION ALL SELECT feature, m, n, i + 1, list_transform(range(len(a)), lambda x:
      {part('x')} - CASE WHEN x >= n + i + 1 THEN {part('x - n - i - 1')} ELSE 0 END)
    FROM c WHERE i < m),
  ex AS (SELECT feature, a FROM c WHERE i = m)
  SELECT gr.*, CASE WHEN n1 = 0 OR n2 = 0 THEN NULL
    WHEN a IS NOT NULL THEN least(1.0, 2 * list_sum(a[:floor(least(u, n1 * n2 - u))::BIGINT + 1]) / list_sum(a))
    ELSE least(1.0, {normal_two_sided(z)}) END AS p_value FROM gr LEFT JOIN ex USING (feature)"""
