"""Choice of the ridge penalty by inner folds, as SQL over training problems."""
from __future__ import annotations

import numpy as np

# The grid of the engine, 25 values from 1e-3 to 1e3, evenly spaced in the exponent.
GRID = ", ".join(repr(float(a)) for a in np.logspace(-3, 3, 25))


def block(q: str, n: str, k: int) -> str:
    """Consecutive folds of positions q below n; the first n mod k are one longer."""
    edge = f"(({n}) % {k}) * (({n}) // {k} + 1)"
    return f"CASE WHEN ({q}) < {edge} THEN ({q}) // (({n}) // {k} + 1) ELSE ({n}) % {k} + (({q}) - {edge}) // greatest(({n}) // {k}, 1) END"


def choice(p: int, k: int) -> str:
    """CTEs from `z` (tf, is_tr, pos, y, z) up to `choice` (tf, alpha): the penalty with the best mean R2
    over k consecutive inner folds of the training rows in the order of pos."""
    d = p + 2  # 1, predictors, outcome
    m = lambda i, j: f"m[(({i}) - 1) * {d} + ({j})]"
    t = lambda i, j: f"t[(({i}) - 1) * {d} + ({j})]"
    dot = lambda i: f"list_dot_product(b, list_transform(range(1, {p + 1}), lambda j: {t('j + 1', i)}))"
    quad = f"list_sum(list_transform(range({p * p}), lambda q: b[q // {p} + 1] * b[q % {p} + 1] * {t(f'q // {p} + 2', f'q % {p} + 2')}))"
    return f"""zi AS (SELECT tf, {block('q', 'n', k)} AS g, list_concat(list_concat([1.0::DOUBLE], z), [y::DOUBLE]) AS u FROM (
    SELECT *, row_number() OVER (PARTITION BY tf ORDER BY pos) - 1 AS q, count(*) OVER (PARTITION BY tf) AS n FROM z WHERE is_tr)),
cell AS (SELECT tf, g, i.range AS i, j.range AS j, sum(u[i.range] * u[j.range]) AS v FROM zi, range(1, {d + 1}) i, range(1, {d + 1}) j GROUP BY 1, 2, 3, 4),
whole AS (SELECT tf, i, j, sum(v) AS v FROM cell GROUP BY 1, 2, 3),
mat AS (SELECT tf, g, list(w.v - cell.v ORDER BY i, j) AS m, list(cell.v ORDER BY i, j) AS t FROM cell JOIN whole w USING (tf, i, j) GROUP BY 1, 2),
el(s, tf, g, alpha, i, j, v) AS (
  SELECT 0, tf, g, alpha, i.range, j.range, {m('i.range + 1', 'j.range + 1')} - {m('1', 'i.range + 1')} * {m('1', 'j.range + 1')} / m[1]
    + CASE WHEN i.range = j.range THEN alpha ELSE 0 END
  FROM mat, (SELECT unnest([{GRID}]) AS alpha) al, range(1, {p + 1}) i, range(1, {p + 2}) j
  UNION ALL
  SELECT s + 1, tf, g, alpha, i, j, CASE WHEN i = s + 1 THEN v / piv ELSE v - colv * rowv / piv END FROM (
    SELECT *, max(CASE WHEN i = s + 1 AND j = s + 1 THEN v END) OVER (PARTITION BY tf, g, alpha) AS piv,
      max(CASE WHEN j = s + 1 THEN v END) OVER (PARTITION BY tf, g, alpha, i) AS colv,
      max(CASE WHEN i = s + 1 THEN v END) OVER (PARTITION BY tf, g, alpha, j) AS rowv
    FROM el WHERE s < {p})),
fit AS (SELECT tf, g, alpha, list(v ORDER BY i) AS b FROM el WHERE s = {p} AND j = {p + 1} GROUP BY 1, 2, 3),
sc2 AS (SELECT tf, g, alpha, b, t, ({m('1', str(d))} - list_dot_product(b, list_transform(range(1, {p + 1}), lambda j: {m('1', 'j + 1')}))) / m[1] AS c FROM fit JOIN mat USING (tf, g)),
r2 AS (SELECT tf, alpha, {t(str(d), str(d))} AS yy, {t(str(d), str(d))} - {t('1', str(d))} * {t('1', str(d))} / t[1] AS sst,
    {t(str(d), str(d))} - 2 * (c * {t('1', str(d))} + {dot(str(d))}) + t[1] * c * c + 2 * c * {dot('1')} + {quad} AS sse FROM sc2),
scored AS (SELECT tf, alpha, CASE WHEN bool_and(sst > 1e-12 * yy) THEN sum(1 - sse / sst) END AS score FROM r2 GROUP BY 1, 2),
choice AS (SELECT tf, alpha FROM (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY score DESC NULLS LAST, alpha) AS rn FROM scored) WHERE rn = 1)"""
