"""Studies over a record table: models x feature sets x folds x penalties.

Every study builds its specs and runs them over one set of fold moments and
one set of replicate sums.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import columns as cl
from ..operators import folds as fo
from ..operators import ranks as rk
from ..operators import resampling as rs
from ..operators import ridge
from ..operators.columns import require_columns
from ..operators.features import CLASSICAL, DEMOGRAPHICS, NOVEL
from ..operators.ridge import ALPHA, CrossValidation, Spec
from ..runtime import materialize

# --- fixed values: penalty grid of the sensitivity study ------------------------
ALPHA_CONDITIONS = [10.0, 50.0, 100.0, 200.0, 500.0]
# ----------------------------------------------------------------------------


def record_table(df: DataFrame, id_col: str, features: list[str], outcomes: list[str], k: int = 5,
                 seed: int = 42, group: str | None = None, keep: list[str] = ()) -> DataFrame:
    """The analysis table: id, pos, fold, predictors and outcomes, written once.

    It is read by several jobs (moments, medians, replicates), and its lineage
    may be the whole feature extraction.
    """
    require_columns(df, [id_col, *features, *outcomes])
    keep = [id_col, *([group] if group else []), *keep]
    d = ridge.prepare(df, features, outcomes, list(dict.fromkeys(keep)))
    d = fo.shuffled_folds(d, id_col, k, seed)
    if group:
        d = fo.group_folds(d.drop("fold"), group, k)
    return materialize(d)


def cross_validate(table: DataFrame, features, outcomes, k: int = 5) -> CrossValidation:
    return CrossValidation(table, list(dict.fromkeys(features)), list(outcomes), k)


def fit_scores(df, id_col, specs: list[Spec], k=5, seed=42, group=None) -> DataFrame:
    """Cross-validated r (both aggregations), R2 and RMSE per spec."""
    feats, outs = _union(specs)
    cv = cross_validate(record_table(df, id_col, feats, outs, k, seed, group), feats, outs, k)
    rows = []
    for s in specs:
        m = cv.scores(s)
        rows.append((s.name, s.outcome, len(s.features), float(s.alpha), m["n"],
                     *[_null(m[c]) for c in ("r_foldmean", "r_oof", "R2_oof", "RMSE")]))
    return df.sparkSession.createDataFrame(
        rows, "name string, outcome string, n_features int, alpha double, n bigint, r_foldmean double, "
        "r_oof double, R2_oof double, RMSE double")


def _null(v: float):
    return None if v != v else float(v)


def _union(specs: list[Spec]) -> tuple[list[str], list[str]]:
    feats = list(dict.fromkeys(f for s in specs for f in s.features))
    return feats, list(dict.fromkeys(s.outcome for s in specs))


def permutation_study(df: DataFrame, id_col: str, specs: list[Spec], n_perm: int = 5000, k: int = 5,
                      seed: int = 42, group: str | None = None, aggregate: str = "r_foldmean") -> DataFrame:
    """Observed r and permutation p per spec. Outcomes without missing values
    run together; an outcome with missing values drops its own rows only."""
    feats, outs = _union(specs)
    # Read by the count and by every batch; bad and infinite values are missing.
    df = materialize(df.select(*dict.fromkeys([id_col, *([group] if group else [])]), *[cl.to_number(c) for c in [*feats, *outs]]))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{o}`").alias(f"c{i}") for i, o in enumerate(outs)]).first()
    whole = [o for i, o in enumerate(outs) if counts[f"c{i}"] == counts["n"]]
    batches = ([whole] if whole else []) + [[o] for o in outs if o not in whole]
    results = []
    for batch in batches:
        mine = [s for s in specs if s.outcome in batch]
        feats, ys = _union(mine)
        cv = cross_validate(record_table(df, id_col, feats, ys, k, seed, group), feats, ys, k)
        results.append(rs.permutation_test(cv, mine, id_col, n_perm, seed, aggregate))
    return reduce(DataFrame.unionByName, results)


def trait_family(df: DataFrame, id_col: str, features: list[str], outcomes: dict[tuple[str, str], str],
                 alpha: float = ALPHA, n_perm: int = 5000, k: int = 5, seed: int = 42) -> DataFrame:
    """All (trait, teacher) outcomes, corrected within each teacher's family."""
    specs = [Spec(f"{t}|{w}", tuple(features), y, alpha) for (t, w), y in outcomes.items()]
    r = permutation_study(df, id_col, specs, n_perm, k, seed)
    parts = F.split("name", "\\|")
    d = r.select(parts[0].alias("trait"), parts[1].alias("teacher"), F.col("r_foldmean").alias("r_obs"),
                 F.round("p_value", 4).alias("p_value"))
    return rk.holm(d, "p_value", ["teacher"])


def _pairs(r: DataFrame, first: str, second: str, names: tuple[str, str]) -> DataFrame:
    """Two specs side by side per outcome with the difference in r."""
    a = r.filter(F.col("name") == first).select("outcome", F.col("r_foldmean").alias(f"r_{names[0]}"),
                                                F.col("p_value").alias(f"p_{names[0]}"))
    b = r.filter(F.col("name") == second).select("outcome", F.col("r_foldmean").alias(f"r_{names[1]}"),
                                                 F.col("p_value").alias(f"p_{names[1]}"))
    return a.join(b, "outcome").withColumn("delta_r", F.col(f"r_{names[1]}") - F.col(f"r_{names[0]}"))


def compare_feature_sets(df, id_col, outcomes, base: list[str], more: list[str],
                         names=("baseline", "extended"), n_perm=5000, k=5, seed=42, group=None, alpha=ALPHA):
    """r and p of a feature set and of a larger one: classical against all,
    or features against features plus confounds."""
    specs = [Spec(n, tuple(f), y, alpha) for y in outcomes for n, f in (("first", base), ("second", [*base, *more]))]
    r = materialize(permutation_study(df, id_col, specs, n_perm, k, seed, group))
    return _pairs(r, "first", "second", names)


def compare_folds(df, id_col, outcomes, features, group, n_perm=1000, k=5, seed=42, alpha=ALPHA):
    """Shuffled folds against folds that keep a person together."""
    specs = [Spec("m", tuple(features), y, alpha) for y in outcomes]
    shuffled = permutation_study(df, id_col, specs, n_perm, k, seed).withColumn("name", F.lit("first"))
    grouped = permutation_study(df, id_col, specs, n_perm, k, seed, group).withColumn("name", F.lit("second"))
    out = _pairs(materialize(shuffled.unionByName(grouped)), "first", "second", ("kfold", "groupkfold"))
    sig = lambda c: F.when(F.col(c) < 0.05, "**").otherwise("n.s.")
    return out.withColumns({"sig_kfold": sig("p_kfold"), "sig_groupkfold": sig("p_groupkfold")})


def stage_sets(available: list[str], demographics=DEMOGRAPHICS, classical=CLASSICAL, novel=NOVEL) -> dict[int, tuple]:
    """Nested predictor sets; stages without predictors are skipped."""
    demo = [c for c in demographics if c in available]
    missing = [c for c in classical if c not in available]
    if missing:
        raise KeyError(f"missing classical features {missing}")
    stages = {1: ("demographics", demo), 2: ("demographics+classical", [*demo, *classical])}
    if all(c in available for c in novel):
        stages[3] = ("demographics+classical+novel", [*demo, *classical, *novel])
    return {s: (n, tuple(f)) for s, (n, f) in stages.items() if f}


def nested_stages(df, id_col, outcomes, stages: dict[int, tuple], n_perm=5000, k=5, seed=42, group=None, alpha=ALPHA):
    """r and p per stage and the change of r from the previous stage."""
    specs = [Spec(str(s), f, y, alpha) for y in outcomes for s, (_, f) in stages.items()]
    r = permutation_study(df, id_col, specs, n_perm, k, seed, group)
    label = F.create_map(*[F.lit(x) for s, (n, _) in stages.items() for x in (str(s), n)])
    w = Window.partitionBy("outcome").orderBy("stage")  # one row per stage
    return r.select(
        "outcome", F.col("name").cast("int").alias("stage"), "n_features",
        F.element_at(label, F.col("name")).alias("feature_set"), F.col("r_foldmean").alias("r_obs"), "p_value",
    ).withColumn("delta_r_from_prev", F.col("r_obs") - F.lag("r_obs").over(w))


def stage_predictions(df, id_col, outcome, stages, k=5, seed=42, group=None, alpha=ALPHA):
    """Out-of-fold prediction of every stage per record, and the scores."""
    specs = {s: Spec(str(s), f, outcome, alpha) for s, (_, f) in stages.items()}
    feats, outs = _union(list(specs.values()))
    cv = cross_validate(record_table(df, id_col, feats, outs, k, seed, group), feats, outs, k)
    pred = cv.df.select(id_col, "pos", "fold", F.col(outcome).alias("y"),
                        *[cv.prediction(spec).alias(f"yhat{s}") for s, spec in specs.items()])
    return pred, {s: cv.scores(spec) for s, spec in specs.items()}


def oof_metrics(pred: DataFrame, yhat: str = "yhat", by: list[str] = ()) -> DataFrame:
    """r, R2, RMSE and MAE of prediction rows in one aggregate."""
    from ..operators.raters import pearson

    err = F.col(yhat) - F.col("y")
    sst = F.var_pop("y") * F.count("y")
    return pred.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson(F.col("y"), F.col(yhat)).alias("r_oof"),
        F.when(sst > 0, 1 - F.try_divide(F.sum(err * err), sst)).alias("R2_oof"),
        F.sqrt(F.avg(err * err)).alias("RMSE"), F.avg(F.abs(err)).alias("MAE"),
    )


def stage_metrics(df, id_col, outcome, stages, k=5, seed=42, group=None, alpha=ALPHA) -> DataFrame:
    """Out-of-fold metrics per stage with changes from the previous stage."""
    pred, scores = stage_predictions(df, id_col, outcome, stages, k, seed, group, alpha)
    long = pred.unpivot(["pos", "fold", "y"], [f"yhat{s}" for s in stages], "model", "yhat")
    m = oof_metrics(long, by=["model"])
    info = df.sparkSession.createDataFrame(
        [(f"yhat{s}", s, len(f), _null(scores[s]["r_foldmean"])) for s, (_, f) in stages.items()],
        "model string, stage int, n_features int, r_foldmean double")
    w = Window.partitionBy(F.lit(1)).orderBy("stage")  # one row per stage
    d = info.join(m, "model").drop("model")
    for c in ("R2_oof", "RMSE", "MAE", "r_oof"):
        d = d.withColumn(f"d{c.replace('_oof', '') if c == 'R2_oof' else c}_from_prev", F.col(c) - F.lag(c).over(w))
    return d


def stage_paired_test(df, id_col, outcome, stages, first=2, second=3, n_boot=5000, k=5, seed=42, group=None,
                      alpha=ALPHA) -> DataFrame:
    """Squared-error difference of two stages on the same records: paired
    bootstrap and signed-rank test."""
    pred, scores = stage_predictions(df, id_col, outcome, {s: stages[s] for s in (first, second)}, k, seed, group, alpha)
    se = lambda s: F.pow(F.col(f"yhat{s}") - F.col("y"), 2)
    rows = materialize(pred.select("pos", se(first).alias("se1"), se(second).alias("se2")).withColumn(
        "d", F.col("se1") - F.col("se2")))
    boot = rs.paired_bootstrap(rows, scores[first]["n"], n_boot, seed)
    test = rk.wilcoxon(rows, [], "d").select(F.col("p_value").alias("p_wilcoxon"))
    err = rows.agg(F.count(F.lit(1)).alias("N"), F.sqrt(F.avg("se1")).alias(f"RMSE_stage{first}"),
                   F.sqrt(F.avg("se2")).alias(f"RMSE_stage{second}"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # three one-row tables
    joined = one(err).join(F.broadcast(one(boot)), "_one").join(F.broadcast(one(test)), "_one").drop("_one")
    return joined.withColumn(
        f"dRMSE_{first}to{second}", F.col(f"RMSE_stage{second}") - F.col(f"RMSE_stage{first}"))


def alpha_sensitivity(df, id_col, outcome, features, alphas=ALPHA_CONDITIONS, n_perm=5000, k=5, seed=42) -> DataFrame:
    """The same features and replicates under several penalties."""
    specs = [Spec(str(a), tuple(features), outcome, float(a)) for a in alphas]
    r = permutation_study(df, id_col, specs, n_perm, k, seed)
    return r.select(F.lit("alpha").alias("analysis_type"), F.col("name").alias("condition"), "outcome",
                    F.col("r_foldmean").alias("r_obs"), "p_value")


def variant_sensitivity(variants: DataFrame, scores: DataFrame, variant_col: str, conditions: list, keys: list[str],
                        features: list[str], outcome: str, analysis_type: str, n_perm=5000, k=5, seed=42,
                        alpha=ALPHA, varying: list[str] | None = None) -> DataFrame:
    """Permutation test per feature variant (gap tolerance, word list, rule).

    All variants were extracted in one pass and stand side by side in one
    record table, so folds, moments and replicate sums are computed once.
    `varying` names the features a variant changes; the others are shared.
    """
    varying = [f for f in features if varying is None or f in varying]
    at = lambda c: F.col(variant_col) == F.lit(c)
    named = {(c, f): f"v{i}_{f}" for i, c in enumerate(conditions) for f in varying}
    wide = variants.groupBy(*keys).agg(
        *[F.max(F.when(at(c), F.col(f))).alias(n) for (c, f), n in named.items()],
        *[F.max(F.when(at(conditions[0]), F.col(f))).alias(f) for f in features if f not in varying],
    )
    d = wide.join(scores, keys).withColumn("_id", F.concat_ws("/", *keys))
    specs = [Spec(str(c), tuple(named.get((c, f), f) for f in features), outcome, alpha) for c in conditions]
    r = permutation_study(materialize(d), "_id", specs, n_perm, k, seed)
    return r.select(F.lit(analysis_type).alias("analysis_type"), F.col("name").alias("condition"), "outcome",
                    F.col("r_foldmean").alias("r_obs"), "p_value")


def sets_by_aggregation(df, id_col, outcome, sets: dict[str, list[str]], k=5, seed=42, alpha=ALPHA) -> DataFrame:
    """Feature sets x (fold-mean, pooled) r, to explain why two reports differ."""
    m = fit_scores(df, id_col, [Spec(n, tuple(f), outcome, alpha) for n, f in sets.items()], k, seed)
    both = F.array(F.struct(F.lit("fold_mean").alias("aggregation"), F.col("r_foldmean").alias("r_obs")),
                   F.struct(F.lit("oof_concat").alias("aggregation"), F.col("r_oof").alias("r_obs")))
    return m.select(F.col("name").alias("feature_set"), "n_features", "n", F.explode(both).alias("x")).select(
        "feature_set", "n_features", "n", "x.*")


def alpha_selection(df, id_col, outcomes, features, k=5, seed=42, grid=ridge.ALPHA_GRID, top=15):
    """Penalty by inner folds on every outer training set.

    Returns (summary, top coefficients): out-of-fold r and R2 per outcome, the
    penalty of the full fit, and its largest coefficients. Inner folds are
    consecutive blocks of the training order; the block of a row in each outer
    training set follows from its position, so one pass yields all of them.
    """
    table = record_table(df, id_col, features, outcomes, k, seed)
    b = ridge.basis(table, features, outcomes)
    n, pos = b.n, F.col("pos")
    if n < 3:
        raise ValueError(f"{n} records are too few to choose a penalty")
    if n < k:  # fewer records than folds
        return alpha_selection(df, id_col, outcomes, features, n, seed, grid, top)
    blocks = {"all_": rs.contiguous_block(pos, n, k)}
    for f in range(k):
        before = F.when(pos > f, F.floor((pos - f + k - 1) / k)).otherwise(F.lit(0))
        n_tr = n - ((n - 1 - f) // k + 1)
        blocks[f"in{f}"] = F.when(F.col("fold") == f, -1).otherwise(rs.contiguous_block(pos - before, n_tr, k))
    cells = ridge.moments(table, b, blocks)
    names, ix = list(blocks), b.x(features)
    zero = np.zeros((b.width, b.width))

    def block_sums(name):
        at, out = names.index(name), {}
        for key, a in cells.items():
            out[key[at]] = out.get(key[at], zero) + a
        return out

    med = ridge.train_medians(table, b, k)
    summary, coefs = [], []
    for y in outcomes:
        iy, unit, sums = b.y(y), b.scale[y], np.zeros(6)
        for f in range(k):
            t, parts = b.impute(med[f]), block_sums(f"in{f}")
            test = t @ parts.pop(-1, zero) @ t.T
            train = [t @ parts[i] @ t.T for i in sorted(parts)]
            a = sum(train)
            fac = ridge.factor(a, ix, ridge.choose_alpha(train, ix, iy, grid))
            _, slope, icpt = fac.solve(a[ix, iy], np.asarray(a[0, iy]))
            sx, xx, xy, m = test[0, ix], test[np.ix_(ix, ix)], test[ix, iy], test[0, 0]
            sums += [m, test[0, iy], m * icpt + slope @ sx, test[iy, iy],
                     m * icpt**2 + 2 * icpt * (slope @ sx) + slope @ xx @ slope, icpt * test[0, iy] + slope @ xy]
        m, sy, _, syy, spp, syp = sums
        sst = syy - sy * sy / m
        t, parts = b.impute(med[-1]), block_sums("all_")
        whole = [t @ parts[i] @ t.T for i in sorted(parts)]
        alpha = ridge.choose_alpha(whole, ix, iy, grid)
        a = sum(whole)
        beta, _, _ = ridge.factor(a, ix, alpha).solve(a[ix, iy], np.asarray(a[0, iy]))
        summary.append((y, int(n), _null(1 - (spp - 2 * syp + syy) / sst if sst > 0 else float("nan")),
                        _null(float(ridge.correlation(*sums))), float(alpha)))
        coefs += [(y, f, float(c * unit), float(alpha)) for f, c in zip(features, beta)]
    spark = df.sparkSession
    s = spark.createDataFrame(summary, "outcome string, n bigint, r2_cv double, pearson_cv double, alpha double")
    c = spark.createDataFrame(coefs, "outcome string, feature string, coef double, alpha double")
    w = Window.partitionBy("outcome").orderBy(F.desc(F.abs("coef")), "feature")  # p rows
    return s, c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
