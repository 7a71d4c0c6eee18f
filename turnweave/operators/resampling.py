"""Permutation and bootstrap replicates as rows: `rep` is a grouping column."""
from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import Draws
from ..functions.permutation import Permutations
from ..runtime import materialize
from . import ridge, skew
from .ridge import CrossValidation, Factor, Spec, correlation


# Values of permuted outcomes that a task holds at once (a dozen work arrays of that length), and permuted values that are
# worth a task of their own.
CELLS, TASK_VALUES = 250_000, 50_000_000


def _moved(n: int, n_rep: int, seed: int):
    """Every record once per replicate, with the position it moves to."""

    def run(batches):
        for pdf in batches:
            step = max(1, CELLS // max(len(pdf), isqrt(n)))
            for lo in range(1, n_rep + 1, step):
                reps = range(lo, min(lo + step, n_rep + 1))
                target = Permutations(seed, reps, n)(pdf["pos"].to_numpy(), back=True)
                out = pdf.drop(columns="pos").loc[np.tile(pdf.index, len(reps))].reset_index(drop=True)
                yield out.assign(rep=np.repeat(reps, len(pdf)), target=target.ravel())[["rep", "target", *out.columns]]

    return run


def _fold_sums(shared, names: list[str], n: int, n_rep: int, seed: int):
    """Sums of the task's positions for every replicate; outcome values come from the shared table."""

    def run(batches):
        batches = [pdf for pdf in batches if len(pdf)]
        if not batches:
            return
        pdf = pd.concat(batches).sort_values("fold", kind="stable")
        pos, fold, z = pdf["pos"].to_numpy(), pdf["fold"].to_numpy(), pdf[names].to_numpy(dtype=float)
        cuts = np.flatnonzero(np.diff(fold)) + 1
        pieces = list(zip([0, *cuts], [*cuts, len(fold)]))
        step = max(1, CELLS // max(len(pos), isqrt(n)))
        for lo in range(1, n_rep + 1, step):
            reps = np.arange(lo, min(lo + step, n_rep + 1))
            source = Permutations(seed, reps.tolist(), n)(pos)
            for o, y in enumerate(shared.value):
                star = y[source]
                parts = [star[:, a:b] for a, b in pieces]
                sums = pd.DataFrame(
                    np.vstack([np.column_stack([p.sum(axis=1), np.einsum("ij,ij->i", p, p), p @ z[a:b]]) for p, (a, b) in zip(parts, pieces)]),
                    columns=["sy", "syy", *names])
                for name, value in (("fold", np.repeat(fold[[a for a, _ in pieces]], len(reps))), ("o", o), ("rep", np.tile(reps, len(pieces)))):
                    sums.insert(0, name, value)
                yield sums

    return run


def permuted_sums(base: DataFrame, b: ridge.Basis, n_rep: int, seed: int) -> DataFrame:
    """Per (rep, outcome, fold): sums of y*, y*^2 and z y* where y* is the
    permuted outcome; X and the folds stay. All outcomes share the permutation:
    position t takes the outcome of position `Permutations(t)`.

    Outcomes under skew.BROADCAST_BYTES are sent to the tasks, which look their
    positions' outcomes up and exchange sums only. Beyond, each record is sent
    to its position in every replicate and joined there.
    """
    z = [b.filled(f).alias(f"x{i}") for i, f in enumerate(b.features)]
    z += [b.missing(f).alias(f"m{i}") for i, f in enumerate(b.nullable)]
    names = [f"x{i}" for i in range(len(b.features))] + [f"m{i}" for i in range(len(b.nullable))]
    ys = [b.scaled(y).alias(f"y{i}") for i, y in enumerate(b.outcomes)]
    x = base.select("pos", F.col("fold").cast("int").alias("fold"), *z)
    if b.n * (1 + len(ys)) * 8 <= skew.BROADCAST_BYTES:
        context = base.sparkSession.sparkContext
        table = base.select("pos", *ys).toPandas().sort_values("pos")
        shared = context.broadcast([table[f"y{i}"].to_numpy(dtype=float) for i in range(len(ys))])
        tasks = max(1, min(isqrt(b.n) // 4, max(context.defaultParallelism, b.n * n_rep // TASK_VALUES)))
        columns = ", ".join(f"{c} double" for c in ["sy", "syy", *names])
        g = x.repartition(tasks).mapInPandas(
            _fold_sums(shared, names, b.n, n_rep, seed), f"rep int, o int, fold int, {columns}")
        g = g.groupBy("rep", "o", "fold").agg(*[F.sum(c).alias(c) for c in ["sy", "syy", *names]])
    else:
        columns = ", ".join(f"y{i} double" for i in range(len(ys)))
        moved = skew.spread_rows(base.select("pos", *ys), b.n, n_rep).mapInPandas(
            _moved(b.n, n_rep, seed), f"rep int, target bigint, {columns}")
        outcomes = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(f"y{i}").alias("y")) for i in range(len(ys))]))
        x = skew.join_side(x.withColumnRenamed("pos", "target"), b.n, 2 + len(names))
        rows = moved.join(x, "target").select("rep", "fold", *names, outcomes.alias("y")).select("rep", "fold", *names, "y.o", "y.y")
        g = rows.groupBy("rep", "o", "fold").agg(
            F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"),
            *[F.sum(F.col(c) * F.col("y")).alias(c) for c in names],
        )
    part = F.struct("fold", "sy", "syy", F.array(*[F.col(c) for c in names]).cast("array<double>").alias("zy"))
    return g.groupBy("rep", "o").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # k entries


class _PermutedCv:
    """Scores permuted outcomes; everything that does not depend on y was
    factored once on the driver (k matrices of p x p)."""

    def __init__(self, cv: CrossValidation, specs: list[Spec]):
        self.k, self.nx, self.nm = cv.k, len(cv.b.features), len(cv.b.nullable)
        self.models = []
        for i, s in enumerate(specs):
            folds = []
            for f, fac in enumerate(cv.factors(s)):
                te = cv.t[f] @ cv.blocks[f] @ cv.t[f].T
                folds.append((fac, cv.t[f][np.ix_(fac.ix, np.arange(1, 1 + self.nx + self.nm))],
                              te[0, 0], te[0, fac.ix], te[np.ix_(fac.ix, fac.ix)]))
            self.models.append((i, cv.b.outcomes.index(s.outcome), folds))

    def __call__(self, batches):
        for pdf in batches:
            reps, outs = pdf["rep"].to_numpy(), pdf["o"].to_numpy()
            sy = np.zeros((len(pdf), self.k))
            syy = np.zeros((len(pdf), self.k))
            zy = np.zeros((len(pdf), self.k, self.nx + self.nm))
            for row, parts in enumerate(pdf["parts"]):
                for part in parts:
                    f = part["fold"]
                    sy[row, f], syy[row, f], zy[row, f] = part["sy"], part["syy"], part["zy"]
            frames = []
            for i, o, folds in self.models:
                at = np.flatnonzero(outs == o)
                if not len(at):
                    continue
                s, q, v = sy[at], syy[at], zy[at]
                pooled, rs = np.zeros((6, len(at))), np.zeros((len(at), self.k))
                for f, (fac, t, n, sx, xx) in enumerate(folds):
                    train = np.arange(self.k) != f
                    _, slope, icpt = fac.solve(v[:, train].sum(axis=1) @ t.T, s[:, train].sum(axis=1))
                    xy = v[:, f] @ t.T
                    lin = slope @ sx
                    sums = np.array([
                        np.full(len(at), n), s[:, f], n * icpt + lin, q[:, f],
                        n * icpt**2 + 2 * icpt * lin + np.einsum("bi,ij,bj->b", slope, xx, slope),
                        icpt * s[:, f] + np.einsum("bi,bi->b", slope, xy),
                    ])
                    rs[:, f] = correlation(*sums)
                    pooled += sums
                frames.append(pd.DataFrame({
                    "rep": reps[at], "spec": i, "r_foldmean": rs.mean(axis=1), "r_oof": correlation(*pooled)}))
            if frames:
                yield pd.concat(frames)


def permutation_test(
    cv: CrossValidation, specs: list[Spec], id_col: str, n_perm: int, seed: int, aggregate: str = "r_foldmean"
) -> DataFrame:
    """Observed r and p = (#|r*| >= |r| + 1) / (n_perm + 1) for every spec.

    Folds and X stay fixed, y is permuted, so one set of replicate sums serves
    all feature sets and penalties.
    """
    spark = cv.df.sparkSession
    observed = [(i, s.name, s.outcome, len(s.features), float(s.alpha), cv.b.n, *_observed(cv, s))
                for i, s in enumerate(specs)]
    obs = spark.createDataFrame(
        observed, "spec int, name string, outcome string, n_features int, alpha double, n bigint, "
        "r_foldmean double, r_oof double")
    if not n_perm:
        return _null_nan(obs, ["r_foldmean", "r_oof"]).withColumn("p_value", F.lit(1.0)).drop("spec")
    reps = permuted_sums(cv.df, cv.b, n_perm, seed).mapInPandas(
        _PermutedCv(cv, specs), "rep int, spec int, r_foldmean double, r_oof double"
    )
    stars = reps.select("spec", F.abs(aggregate).alias("star")).filter(~F.isnan("star"))
    j = stars.join(F.broadcast(obs.select("spec", F.abs(aggregate).alias("seen"))), "spec")
    hits = j.groupBy("spec").agg(F.count_if(F.col("star") >= F.col("seen")).alias("hits"))
    p = (F.coalesce("hits", F.lit(0)) + 1.0) / (n_perm + 1.0)
    out = obs.join(F.broadcast(hits), "spec", "left").withColumn("p_value", p).drop("hits", "spec")
    return _null_nan(out, ["r_foldmean", "r_oof"])


def _observed(cv: CrossValidation, s: Spec) -> tuple[float, float]:
    got = cv.scores(s)
    return got["r_foldmean"], got["r_oof"]


def _null_nan(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def coefficient_test(
    base: DataFrame, features: list[str], outcome: str, id_col: str, alpha: float = ridge.ALPHA,
    n_perm: int = 5000, seed: int = 42,
) -> DataFrame:
    """Per-coefficient permutation p on the full-data fit. `base` carries pos."""
    b, fac, beta = ridge.full_fit(base, features, outcome, alpha)
    t = fac.t[np.ix_(fac.ix, np.arange(1, 1 + len(b.features) + len(b.nullable)))]
    unit = b.scale[outcome]

    def solve(batches):
        for pdf in batches:
            zy = np.array([sum(np.asarray(p["zy"]) for p in parts) for parts in pdf["parts"]])
            sy = np.array([sum(p["sy"] for p in parts) for parts in pdf["parts"]])
            coef, _, _ = fac.solve(zy @ t.T, sy)
            yield pd.DataFrame({"coefs": list(np.abs(coef * unit))})

    spark = base.sparkSession
    obs = spark.createDataFrame(
        [(i, f, float(c)) for i, (f, c) in enumerate(zip(features, beta))], "i int, feature string, coef_obs double")
    if not n_perm:
        p = F.lit(1.0)
        return obs.select("feature", "coef_obs", p.alias("p_value"), (p < 0.05).alias("significant"))
    sums = permuted_sums(base.withColumn("fold", F.lit(0)), b, n_perm, seed)
    stars = sums.mapInPandas(solve, "coefs array<double>").select(F.posexplode("coefs").alias("i", "star"))
    hits = stars.join(F.broadcast(obs), "i").groupBy("i").agg(
        F.count_if(F.col("star") >= F.abs("coef_obs")).alias("hits"))
    p = (F.coalesce("hits", F.lit(0)) + 1.0) / (n_perm + 1.0)
    return obs.join(F.broadcast(hits), "i", "left").select(
        "feature", "coef_obs", p.alias("p_value"), (p < 0.05).alias("significant"))


# --- bootstrap -----------------------------------------------------------------
# Draws that are worth a task of their own.
TASK_DRAWS = 20_000_000


def _shared(table: DataFrame, names: list[str], n: int):
    """The numeric table as a matrix in the order of `pos`, sent to the tasks; None beyond skew.BROADCAST_BYTES."""
    if n * (1 + len(names)) * 8 > skew.BROADCAST_BYTES:
        return None
    rows = table.select("pos", *names).toPandas().sort_values("pos")
    return table.sparkSession.sparkContext.broadcast(rows[names].to_numpy(dtype=float))


def resample(table: DataFrame, names: list[str], d: Draws, n_rep: int, inner: int, shared, work, schema: str) -> DataFrame:
    """`work(rep, z, picks)` for every replicate, where the rows are.

    z is a matrix of `names`, picks the drawn rows of z per block. With a shared
    table each task takes whole replicates and z is the whole table. Beyond, a
    task holds one range of positions (Draws.span rows) for a part of the
    replicates and draws for its own range only, so that what `work` folds a
    range into is all that is exchanged; rows move once, in as many copies as
    it takes to keep a task under TASK_DRAWS draws or the cores busy.
    """
    cuts = d.blocks(inner)
    if not cuts:
        return table.sparkSession.createDataFrame([], schema)
    cores = table.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, d.n * n_rep // TASK_DRAWS)
    if shared is not None:

        def whole(batches):
            for pdf in batches:
                for rep in pdf["id"].tolist():
                    yield work(rep, shared.value, [(i, d.places(rep, a, b)) for i, a, b in cuts])

        return table.sparkSession.range(1, n_rep + 1, 1, min(n_rep, wanted)).mapInPandas(whole, schema)
    copies = max(1, min(n_rep, -(-wanted // d.ranges)))
    unit = F.floor(F.col("pos") / d.span) * copies + F.col("_copy")
    rows = table.select("pos", *names).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = rows.repartitionById(d.ranges * copies, unit.cast("int"))

    def ranged(batches):
        batches = [pdf for pdf in batches if len(pdf)]
        if not batches:
            return
        pdf = pd.concat(batches).sort_values("pos")
        at, copy, z = int(pdf["pos"].iloc[0]) // d.span, int(pdf["_copy"].iloc[0]), pdf[names].to_numpy(dtype=float)
        for rep in range(1 + copy, n_rep + 1, copies):
            yield work(rep, z, [(i, d.inside(rep, a, b, at)) for i, a, b in cuts])

    return rows.mapInPandas(ranged, schema)


def contiguous_block(i: Column, n: int | Column, k: int) -> Column:
    """Fold of position i when n rows are cut into k consecutive folds, the
    first n mod k one row longer."""
    if k == 1:
        return F.lit(0)
    n = n if isinstance(n, Column) else F.lit(n)
    small, extra = F.floor(n / k), n % k
    edge = extra * (small + 1)
    return F.when(i < edge, F.floor(i / (small + 1))).otherwise(
        extra + F.floor((i - edge) / F.greatest(small, F.lit(1)))).cast("int")


def _gram(rep: int, z: np.ndarray, picks) -> pd.DataFrame:
    """Weighted moments of the drawn rows per block."""
    grams = []
    for _, pick in picks:
        w = np.bincount(pick, minlength=len(z)).astype(float)
        grams.append((z.T @ (z * w[:, None])).ravel())
    return pd.DataFrame({"rep": rep, "block": [i for i, _ in picks], "a": grams})


def weighted_median(value: np.ndarray, order: np.ndarray, w: np.ndarray) -> float | None:
    """Median of value[i] taken w[i] times; `order` sorts the values. None where nothing is taken."""
    upto = np.cumsum(w[order])
    n = int(upto[-1]) if len(upto) else 0
    if not n:
        return None
    lo, hi = np.searchsorted(upto, [(n - 1) // 2, n // 2], side="right")
    return float(value[order[lo]] + value[order[hi]]) / 2


def bootstrap_coefficients(
    base: DataFrame, features: list[str], outcome: str, alpha: float | None = ridge.ALPHA,
    n_boot: int = 500, seed: int = 42, inner: int = 5, grid=ridge.ALPHA_GRID,
) -> DataFrame:
    """(rep, alpha, feature, coef): imputer, scaler and ridge refitted on every
    resample. alpha=None chooses the penalty per resample by inner folds.

    Draws are made where the rows are (`resample`). Under skew.BROADCAST_BYTES a
    task solves its replicates whole and nothing is exchanged. Beyond, moment
    matrices per (replicate, block, range) are, and for features with missing
    values the drawn counts per (replicate, value), whose medians are selected
    from the counts.
    """
    b = ridge.basis(base, features, [outcome])
    d, ix, iy = b.width, b.x(features), b.y(outcome)
    draws, blocks = Draws(seed, b.n), 1 if alpha is not None else inner
    table, names = base.select("pos", *b.vector()), [f"z{i}" for i in range(d)]
    shared = _shared(table, names, b.n)
    nulls = [(1 + b.features.index(f), b.m(f)) for f in b.nullable]  # value column and its missing indicator
    unit, fixed = b.scale[outcome], alpha

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        med = {f: (None if pd.isna(m) else m) for f, m in zip(b.nullable, pdf["med"].iloc[0])}
        t = b.impute(med)
        by = {}
        for blk, a in zip(pdf["block"], pdf["a"]):
            by[blk] = by.get(blk, 0.0) + np.asarray(a).reshape(d, d)
        blocks = [t @ by[i] @ t.T for i in sorted(by)]
        total = sum(blocks)
        al = fixed if fixed is not None else ridge.choose_alpha(blocks, ix, iy, grid)
        fac = ridge.factor(total, ix, al)
        beta, _, _ = fac.solve(total[ix, iy], np.asarray(total[0, iy]))
        return pd.DataFrame({"rep": pdf["rep"].iloc[0], "alpha": al, "feature": features, "coef": beta * unit})

    result = "rep int, alpha double, feature string, coef double"
    if shared is not None:
        orders: list[np.ndarray] = []  # per worker, found with its first replicate

        def whole(rep, z, picks):
            if not orders:
                orders.extend(np.flatnonzero(z[:, m] == 0)[np.argsort(z[z[:, m] == 0, x], kind="stable")] for x, m in nulls)
            w = np.bincount(np.concatenate([pick for _, pick in picks]), minlength=len(z))
            med = [weighted_median(z[:, x], order, w) for (x, _), order in zip(nulls, orders)]
            return solve(_gram(rep, z, picks).assign(med=[med] * len(picks)))

        return resample(table, names, draws, n_boot, blocks, shared, whole, result)

    parts = resample(table, names, draws, n_boot, blocks, None, _gram, "rep int, block int, a array<double>")
    if nulls:

        def counts(rep, z, picks):
            w = np.bincount(np.concatenate([pick for _, pick in picks]), minlength=len(z))
            out = []
            for i, (x, m) in enumerate(nulls):
                drawn = (w > 0) & (z[:, m] == 0)
                value, at = np.unique(z[drawn, x], return_inverse=True)
                out.append(pd.DataFrame({"rep": rep, "which": f"m{i}", "value": value, "w": np.bincount(at, w[drawn], len(value)).astype(int)}))
            return pd.concat(out)

        drawn = resample(table, names, draws, n_boot, blocks, None, counts, "rep int, which string, value double, w bigint")
        drawn = materialize(drawn)  # read by the cut points and by the counts
        q = skew.exact_quantiles(drawn, ["rep", "which"], "value", [0.5], ["v"], weight="w")
        which = [f"m{i}" for i in range(len(nulls))]
        med = q.groupBy("rep").pivot("which", which).agg(F.first("v")).select("rep", F.array(*which).alias("med"))
        parts = parts.join(med, "rep", "left")
        parts = parts.withColumn("med", F.coalesce("med", F.array(*[F.lit(None).cast("double")] * len(nulls))))
    else:
        parts = parts.withColumn("med", F.array().cast("array<double>"))
    return parts.groupBy("rep").applyInPandas(solve, result)


def bootstrap_variance(coefs: DataFrame) -> DataFrame:
    """Mean, sd and 95% percentile interval of each coefficient."""
    g = coefs.groupBy("feature").agg(
        F.avg("coef").alias("coef_mean"),
        F.coalesce(F.stddev_samp("coef"), F.lit(0.0)).alias("coef_sd"),
        F.percentile("coef", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),  # n_boot values
        F.count(F.lit(1)).alias("n_valid"),
    )
    lo, hi = F.col("q")[0], F.col("q")[1]
    return g.select(
        "feature", "coef_mean", "coef_sd", lo.alias("ci_lower"), hi.alias("ci_upper"),
        ((lo > 0) | (hi < 0)).alias("ci_excludes_zero"), "n_valid",
        (F.col("n_valid") < 100).alias("few_resamples"),
    )


def top_k_per_replicate(coefs: DataFrame, k: int = 10) -> DataFrame:
    """Mark the k largest |coef| of each replicate."""
    w = Window.partitionBy("rep").orderBy(F.desc(F.abs("coef")), "feature")  # p rows
    return coefs.withColumn("in_top", F.row_number().over(w) <= k)


def bootstrap_stability(coefs: DataFrame, k: int = 10) -> DataFrame:
    """Coefficient stability: moments, quantiles, sign agreement, top-k rate."""
    d = top_k_per_replicate(coefs, k)
    mean = F.avg("coef").over(Window.partitionBy("feature"))  # n_boot rows
    d = d.withColumn("_mean", mean)
    g = d.groupBy("feature").agg(
        F.avg("coef").alias("coef_mean"), F.stddev_pop("coef").alias("coef_std"),
        F.percentile("coef", F.array(F.lit(0.05), F.lit(0.95))).alias("q"),
        F.avg(F.signum("coef")).alias("sign_mean"),
        F.avg((F.signum("coef") == F.signum("_mean")).cast("double")).alias("sign_agree_rate"),
        F.avg(F.col("in_top").cast("double")).alias("topk_rate"),
    )
    return g.select(
        "feature", "coef_mean", "coef_std", F.col("q")[0].alias("coef_q05"), F.col("q")[1].alias("coef_q95"),
        "sign_mean", "sign_agree_rate", "topk_rate",
    )


def alpha_distribution(coefs: DataFrame) -> DataFrame:
    """Count, mean, sd, min, quartiles and max of the chosen penalties."""
    a = coefs.groupBy("rep").agg(F.first("alpha").alias("alpha"))
    q = F.percentile("alpha", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return a.agg(
        F.count(F.lit(1)).alias("n"), F.avg("alpha").alias("mean"), F.stddev_samp("alpha").alias("sd"),
        F.min("alpha").alias("min"), q.alias("q"), F.max("alpha").alias("max"),
    ).select("n", "mean", "sd", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
             F.col("q")[2].alias("p75"), "max")


def paired_bootstrap(rows: DataFrame, n: int, n_boot: int, seed: int, value: str = "d") -> DataFrame:
    """Mean of paired differences with a percentile interval and
    p = min(1, 2 min(pL, pR)), both tails smoothed by one. `rows` has pos."""
    table = rows.select("pos", F.col(value).cast("double").alias("_d"))

    def sums(rep, z, picks):
        drawn = z[picks[0][1], 0]
        return pd.DataFrame({"rep": [rep], "s": [drawn.sum()], "c": [len(drawn)]})

    parts = resample(table, ["_d"], Draws(seed, n), n_boot, 1, _shared(table, ["_d"], n), sums, "rep int, s double, c bigint")
    means = parts.groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    tail = lambda c: (F.count_if(c) + 1.0) / (n_boot + 1.0)
    g = means.agg(
        F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),  # n_boot values
        tail(F.col("m") <= 0).alias("pl"), tail(F.col("m") >= 0).alias("pr"),
    )
    mean = rows.agg(F.avg(value).alias("mean_diff")).withColumn("_one", F.lit(1))
    return mean.join(F.broadcast(g.withColumn("_one", F.lit(1))), "_one").select(  # one row each
        "mean_diff", F.col("q")[0].alias("ci_lo"), F.col("q")[1].alias("ci_hi"),
        F.least(F.lit(1.0), 2 * F.least("pl", "pr")).alias("p_boot"),
    )
