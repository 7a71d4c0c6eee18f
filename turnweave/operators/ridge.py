"""Ridge regression from second moments.

One pass turns the record table into a small matrix of sums per fold. Missing
values enter as indicator columns, so any fold's median imputation, scaling,
feature subset, outcome and penalty is linear algebra on those matrices: k
folds, 25 penalties and several feature sets still read the data once.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import skew
from .columns import all_of

ALPHA = 100.0
ALPHA_GRID = tuple(float(a) for a in np.logspace(-3, 3, 25))


@dataclass
class Basis:
    """Column layout z = [1, x..., missing indicators..., y...], shifted and
    scaled by global means and deviations for numerical stability."""

    features: list[str]
    outcomes: list[str]
    n: int
    shift: dict[str, float]
    scale: dict[str, float]
    nullable: list[str]

    @property
    def width(self) -> int:
        return 1 + len(self.features) + len(self.nullable) + len(self.outcomes)

    def x(self, names: list[str]) -> np.ndarray:
        return np.array([1 + self.features.index(f) for f in names], dtype=int)

    def m(self, name: str) -> int:
        return 1 + len(self.features) + self.nullable.index(name)

    def y(self, name: str) -> int:
        return 1 + len(self.features) + len(self.nullable) + self.outcomes.index(name)

    def scaled(self, c: str) -> Column:
        return (F.col(f"`{c}`").cast("double") - self.shift[c]) / self.scale[c]

    def filled(self, c: str) -> Column:
        return F.coalesce(self.scaled(c), F.lit(0.0)) if c in self.nullable else self.scaled(c)

    def missing(self, c: str) -> Column:
        return F.when(F.col(f"`{c}`").isNull(), 1.0).otherwise(0.0)

    def vector(self) -> list[Column]:
        cols = [F.lit(1.0), *[self.filled(f) for f in self.features], *[self.missing(f) for f in self.nullable],
                *[self.scaled(y) for y in self.outcomes]]
        return [c.alias(f"z{i}") for i, c in enumerate(cols)]

    def impute(self, medians: dict[str, float]) -> np.ndarray:
        """T with T z = [1, x imputed..., 0..., y...] (medians in scaled units)."""
        t = np.eye(self.width)
        for f in self.nullable:
            med = medians.get(f)
            t[1 + self.features.index(f), self.m(f)] = 0.0 if med is None else med
            t[self.m(f), self.m(f)] = 0.0
        return t


def basis(df: DataFrame, features: list[str], outcomes: list[str]) -> Basis:
    """One aggregate over the (finite or NULL) columns."""
    names = list(dict.fromkeys([*features, *outcomes]))
    v = {c: F.col(f"`{c}`").cast("double") for c in names}
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[a.alias(f"{k}{i}") for i, c in enumerate(names)
          for k, a in (("c", F.count(v[c])), ("m", F.avg(v[c])), ("s", F.stddev_pop(v[c])))],
    ).first()
    return Basis(
        list(features), list(outcomes), row["n"],
        {c: row[f"m{i}"] or 0.0 for i, c in enumerate(names)},
        {c: row[f"s{i}"] or 1.0 for i, c in enumerate(names)},
        [c for i, c in enumerate(names) if c in features and row[f"c{i}"] < row["n"]],
    )


def moments(df: DataFrame, b: Basis, blocks: dict[str, Column]) -> dict[tuple, np.ndarray]:
    """Sum of z z' per combination of block columns.

    Each task folds its rows into one matrix per block, the shuffle sums them;
    the driver receives blocks * width^2 numbers.
    """
    d, names = b.width, list(blocks)

    def fold(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            z = pdf[[f"z{i}" for i in range(d)]].to_numpy(dtype=float)
            keys = pdf[names].to_numpy()
            for key in {tuple(k) for k in keys}:
                rows = z[(keys == np.array(key)).all(axis=1)]
                acc[key] = acc.get(key, 0.0) + rows.T @ rows
        out = pd.DataFrame([(*map(int, k), a.ravel()) for k, a in acc.items()], columns=[*names, "a"])
        yield out

    schema = ", ".join(f"{n} int" for n in names) + ", a array<double>"
    parts = df.select(*b.vector(), *[c.cast("int").alias(n) for n, c in blocks.items()]).mapInPandas(fold, schema)
    cells = parts.select(*names, F.posexplode("a").alias("i", "v")).groupBy(*names, "i").agg(F.sum("v").alias("v"))
    out: dict[tuple, np.ndarray] = {}
    for row in cells.collect():  # blocks * width^2 numbers
        key = tuple(row[n] for n in names)
        out.setdefault(key, np.zeros(d * d))[row["i"]] = row["v"]
    return {k: a.reshape(d, d) for k, a in out.items()}


def train_medians(df: DataFrame, b: Basis, k: int | None, fold: str = "fold") -> dict[int, dict[str, float]]:
    """Median of each nullable feature on the rows outside each fold, and on
    all rows (key -1), in scaled units."""
    result: dict[int, dict[str, float]] = {f: {} for f in [-1, *range(k or 0)]}
    if not b.nullable:
        return result
    held = F.array(*[F.lit(f) for f in result])
    long = df.select(
        F.explode(held).alias("held"), (F.col(fold) if k else F.lit(-2)).alias("_fold"),
        *[b.scaled(f).alias(f"v{i}") for i, f in enumerate(b.nullable)],
    ).filter(F.col("held") != F.col("_fold"))
    if b.n <= skew.ROWS_PER_TASK:
        q = long.groupBy("held").agg(
            *[F.percentile(f"v{i}", F.lit(0.5)).alias(f"m{i}") for i in range(len(b.nullable))]
        )
        for row in q.collect():  # k + 1 rows
            result[row["held"]] = {f: row[f"m{i}"] for i, f in enumerate(b.nullable)}
        return result
    vals = long.unpivot(["held"], [f"v{i}" for i in range(len(b.nullable))], "which", "value")
    for row in skew.exact_quantiles(vals, ["held", "which"], "value", [0.5], ["med"]).collect():
        result[row["held"]][b.nullable[int(row["which"][1:])]] = row["med"]
    return result


@dataclass
class Factor:
    """What one training set contributes: means, deviations, inverse."""

    n: float
    mu: np.ndarray
    sd: np.ndarray
    inverse: np.ndarray
    ix: np.ndarray
    t: np.ndarray = field(repr=False, default=None)

    def solve(self, xy: np.ndarray, y_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Standardised coefficients, raw slopes and intercepts for right-hand
        sides X'y (..., p) and sums of y (...)."""
        rhs = (xy - self.mu * y_sum[..., None]) / self.sd
        beta = rhs @ self.inverse
        slope = beta / self.sd
        return beta, slope, y_sum / self.n - slope @ self.mu


def factor(a: np.ndarray, ix: np.ndarray, alpha: float, t: np.ndarray | None = None) -> Factor:
    """Factor an imputed moment matrix [1, x, ., y]: scaling uses the
    population deviation, a constant column keeps scale 1."""
    n = a[0, 0]
    mu = a[0, ix] / n
    xx = a[np.ix_(ix, ix)]
    var = np.diag(xx) / n - mu**2
    tiny = var <= 1e-14 * np.maximum(np.diag(xx) / n, 1e-300)
    sd = np.where(tiny, 1.0, np.sqrt(np.maximum(var, 0.0)))
    c = (xx - n * np.outer(mu, mu)) / np.outer(sd, sd)
    return Factor(n, mu, sd, np.linalg.inv(c + alpha * np.eye(len(ix))), ix, t)


def correlation(n, sa, sb, saa, sbb, sab):
    """Pearson r from sums; NaN when a side has no variance."""
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    with np.errstate(invalid="ignore", divide="ignore"):
        ok = (va > 1e-12 * np.abs(saa)) & (vb > 1e-12 * np.abs(sbb))
        return np.where(ok, (sab - sa * sb / n) / np.sqrt(va * vb), np.nan)


@dataclass(frozen=True)
class Spec:
    """One model: a name, predictors, an outcome and a penalty."""

    name: str
    features: tuple[str, ...]
    outcome: str
    alpha: float = ALPHA


class CrossValidation:
    """Fold moments of a record table and everything derived from them."""

    def __init__(self, df: DataFrame, features: list[str], outcomes: list[str], k: int, fold: str = "fold"):
        self.k, self.df, self.fold = k, df, fold
        self.b = basis(df, features, outcomes)
        got = moments(df, self.b, {"fold": F.col(fold)})
        self.blocks = [got.get((f,), np.zeros((self.b.width, self.b.width))) for f in range(k)]
        self.medians = train_medians(df, self.b, k, fold)
        self.total = sum(self.blocks)
        self.t = [self.b.impute(self.medians[f]) for f in range(k)]

    def factors(self, spec: Spec) -> list[Factor]:
        ix = self.b.x(list(spec.features))
        out = []
        for f in range(self.k):
            train = self.t[f] @ sum(self.blocks[g] for g in range(self.k) if g != f) @ self.t[f].T
            out.append(factor(train, ix, spec.alpha, self.t[f]))
        return out

    def coefficients(self, spec: Spec) -> list[tuple[np.ndarray, float]]:
        """Per fold: slopes and intercept in scaled units."""
        iy = self.b.y(spec.outcome)
        out = []
        for f, fac in enumerate(self.factors(spec)):
            train = self.t[f] @ sum(self.blocks[g] for g in range(self.k) if g != f) @ self.t[f].T
            _, slope, icpt = fac.solve(train[fac.ix, iy], np.asarray(train[0, iy]))
            out.append((slope, float(icpt)))
        return out

    def scores(self, spec: Spec) -> dict[str, float]:
        """Fold-mean r, pooled r, R2 and RMSE of the out-of-fold predictions."""
        iy, ix = self.b.y(spec.outcome), self.b.x(list(spec.features))
        sums, rs = np.zeros(6), []
        for f, (slope, icpt) in enumerate(self.coefficients(spec)):
            te = self.t[f] @ self.blocks[f] @ self.t[f].T
            n, sx, xx, xy = te[0, 0], te[0, ix], te[np.ix_(ix, ix)], te[ix, iy]
            s = np.array([
                n, te[0, iy], n * icpt + slope @ sx, te[iy, iy],
                n * icpt**2 + 2 * icpt * (slope @ sx) + slope @ xx @ slope, icpt * te[0, iy] + slope @ xy,
            ])
            rs.append(float(correlation(*s)))
            sums += s
        n, sy, _, syy, spp, syp = sums
        unit = self.b.scale[spec.outcome]
        sse = max(spp - 2 * syp + syy, 0.0)
        sst = syy - sy * sy / n
        return {
            "n": int(n), "r_foldmean": float(np.mean(rs)), "r_oof": float(correlation(*sums)),
            "R2_oof": 1.0 - sse / sst if sst > 0 else float("nan"), "RMSE": unit * float(np.sqrt(sse / n)),
        }

    def prediction(self, spec: Spec) -> Column:
        """Out-of-fold prediction as a dot product chosen by fold."""
        yhat = None
        for f, (slope, icpt) in enumerate(self.coefficients(spec)):
            e = F.lit(float(icpt))
            for c, s in zip(spec.features, slope):
                med = self.medians[f].get(c)
                x = self.b.scaled(c)
                x = F.coalesce(x, F.lit(0.0 if med is None else float(med))) if c in self.b.nullable else x
                e = e + x * float(s)
            e = e * self.b.scale[spec.outcome] + self.b.shift[spec.outcome]
            at = F.col(self.fold) == f
            yhat = F.when(at, e) if yhat is None else yhat.when(at, e)
        return yhat


def prepare(df: DataFrame, features: list[str], outcomes: list[str], keep: list[str]) -> DataFrame:
    """Numeric predictors and outcomes, +-inf and unparsable -> NULL, rows with
    a missing outcome dropped."""
    from .columns import to_number

    d = df.select(*keep, *[to_number(c) for c in dict.fromkeys([*features, *outcomes])])
    return d.filter(all_of([F.col(y).isNotNull() for y in outcomes]))


def full_fit(df: DataFrame, features: list[str], outcome: str, alpha: float = ALPHA):
    """Imputed, standardised fit on all rows: (basis, factor, beta)."""
    b = basis(df, features, [outcome])
    a = moments(df, b, {"one": F.lit(0)})[(0,)]
    t = b.impute(train_medians(df, b, None)[-1])
    a = t @ a @ t.T
    fac = factor(a, b.x(features), alpha, t)
    beta, _, _ = fac.solve(a[fac.ix, b.y(outcome)], np.asarray(a[0, b.y(outcome)]))
    return b, fac, beta * b.scale[outcome]


def choose_alpha(blocks: list[np.ndarray], ix: np.ndarray, iy: int, grid=ALPHA_GRID) -> float:
    """Penalty with the best mean R2 over inner folds of already imputed and
    standardised data (the scaler is not refitted inside)."""
    total = sum(blocks)
    base = factor(total, ix, 0.0 if len(ix) == 0 else 1.0)
    mu, sd = base.mu, base.sd
    s = np.eye(total.shape[0])
    s[ix, ix] = 1.0 / sd
    s[ix, 0] = -mu / sd
    z = [s @ a @ s.T for a in blocks]
    best, best_score = None, -np.inf
    pieces = []
    for f, te in enumerate(z):
        tr = sum(z[g] for g in range(len(z)) if g != f)
        n, sx, sy = tr[0, 0], tr[0, ix], tr[0, iy]
        c = tr[np.ix_(ix, ix)] - np.outer(sx, sx) / n
        w, v = np.linalg.eigh(c)
        pieces.append((te, n, sx, sy, w, v, v.T @ (tr[ix, iy] - sx * sy / n)))
    for alpha in grid:
        score = 0.0
        for te, n, sx, sy, w, v, rhs in pieces:
            beta = v @ (rhs / (w + alpha))
            icpt = (sy - beta @ sx) / n
            m, ty, tx = te[0, 0], te[0, iy], te[0, ix]
            sse = (te[iy, iy] - 2 * (icpt * ty + beta @ te[ix, iy]) + m * icpt**2 + 2 * icpt * (beta @ tx)
                   + beta @ te[np.ix_(ix, ix)] @ beta)
            sst = te[iy, iy] - ty * ty / m
            # A fold without variance has no R2 (sums leave a rounding error of it).
            score += 1.0 - sse / sst if sst > 1e-12 * te[iy, iy] else np.nan
        if score > best_score:
            best, best_score = alpha, score
    return best if best is not None else float(grid[0])
