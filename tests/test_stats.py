"""Statistics against brute force in numpy."""
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnweave.functions import tails
from turnweave.functions.permutation import Permutations
from turnweave.operators import folds as fo
from turnweave.operators import ranks as rk
from turnweave.operators import resampling as rs
from turnweave.operators import ridge, skew
from turnweave.operators.features import CLASSICAL, DEMOGRAPHICS, NOVEL
from turnweave.operators.ridge import Spec
from turnweave.plans import studies as st


# --- Holm ------------------------------------------------------------------------
@pytest.mark.parametrize("p,want", [
    ([.01, .04, .03, .5, .8], [.05, .12, .12, 1, 1]),
    ([.01, None, .05], [.02, None, .05]),
    ([.0048, .0004, .0902, .0004, .0152], [.0144, .0020, .0902, .0020, .0304]),
    ([None], [None]), ([0.5], [0.5]), ([0.02, 0.02], [0.04, 0.04]),
])
def test_holm(spark, p, want):
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = [r.p_corrected for r in rk.holm(df, "p").orderBy("i").collect()]
    assert all(a is None and b is None or abs(a - b) < 1e-12 for a, b in zip(got, want))


@pytest.mark.parametrize("bad", [-0.1, 1.5])
def test_holm_rejects_out_of_range(spark, bad):
    with pytest.raises(Exception, match="outside"):
        rk.holm(spark.createDataFrame([(bad,)], "p double"), "p").collect()


# --- tails --------------------------------------------------------------------------
def test_t_tail_matches_integration():
    for t, df in [(0.5, 3), (2.1, 8), (1.6329931618554523, 8), (-3.3, 118)]:
        x = np.linspace(0, abs(t), 200_001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        want = 1 - 2 * np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)
        assert abs(tails.t_two_sided(t, df) - want) < 1e-9


def test_signed_rank_exact_matches_enumeration():
    for n in (3, 5, 8):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 4 + 1):
            want = min(1.0, 2 * sum(s <= w for s in sums) / 2**n)
            assert abs(tails.signed_rank_exact(w, n) - want) < 1e-12


def test_rank_sum_exact_matches_enumeration():
    n1, n2 = 3, 4
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(n1 * n2 + 1):
        big = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x >= big for x in us) / len(us))
        assert abs(tails.rank_sum_exact(u, n1, n2) - want) < 1e-12


def test_rank_sum_exact_in_a_large_group():
    """The lower tail of U = 0..3 counts partitions, whatever the size of the other group."""
    for n in (10, 2_595, 10**6):
        ways = math.comb(n + 5, 5)
        for u, partitions in ((0, 1), (1, 2), (2, 4), (3, 7)):
            assert math.isclose(tails.rank_sum_exact(u, 5, n), 2 * partitions / ways, rel_tol=1e-12)
            assert math.isclose(tails.rank_sum_exact(5 * n - u, n, 5), 2 * partitions / ways, rel_tol=1e-12)
    assert abs(tails.rank_sum_exact(910, 5, 2_595) - 9.2e-5) < 1e-6


def test_undefined_tests_keep_their_rows(spark):
    d = spark.createDataFrame([("zero", 0.0), ("zero", 0.0), ("some", 1.0), ("some", -2.0), ("none", None)], "k string, d double")
    got = {r.k: r for r in rk.wilcoxon(d, ["k"], "d").collect()}
    assert (got["zero"].n, got["zero"].zeros, got["zero"].p_value) == (0, 2, None) and got["some"].n == 2
    assert rk.wilcoxon(d.filter("k = 'zero'"), [], "d").first().p_value is None
    m = spark.createDataFrame([("one", 1.0, "M"), ("one", 2.0, "M"), ("two", 1.0, "M"), ("two", 2.0, "F")], "k string, v double, g string")
    got = {r.k: r for r in rk.mann_whitney(m, ["k"], "v", "g", "M", "F").collect()}
    assert (got["one"].n1, got["one"].n2, got["one"].u, got["one"].p_value) == (2, 0, None, None) and got["two"].p_value == 1.0
    c = spark.createDataFrame([("few", 1.0, 2.0), ("few", 2.0, 3.0), ("ok", 1.0, 1.0), ("ok", 2.0, 3.0), ("ok", 3.0, 2.0)], "k string, x double, y double")
    got = {r.k: r for r in rk.correlations(c, ["k"], "x", "y").collect()}
    assert (got["few"].n, got["few"].r, got["few"].rho_p) == (2, None, None) and abs(got["ok"].r - 0.5) < 1e-12


def test_bad_outcomes_are_missing(spark):
    pdf = make(n=40, missing=False)
    rows = [(r.id, *[float(r[f"x{i}"]) for i in range(4)], str(r.y)) for _, r in pdf.iterrows()]
    rows += [("bad", 1.0, 1.0, 1.0, 1.0, "n/a"), ("inf", 1.0, 1.0, 1.0, 1.0, "Infinity")]
    df = spark.createDataFrame(rows, "id string, x0 double, x1 double, x2 double, x3 double, y string").withColumn("z", F.length("id").cast("double") + F.col("x0"))
    xs = tuple(f"x{i}" for i in range(4))
    got = {r.outcome: r for r in st.permutation_study(df, "id", [Spec("m", xs, "y"), Spec("m", xs, "z")], n_perm=3).collect()}
    assert got["y"].n == 40 and got["z"].n == 42


def test_group_folds_are_balanced(spark):
    sizes = [1000] + [10] * 200
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)], "g long")
    load = sorted(r[1] for r in fo.group_folds(df, "g", 5).groupBy("fold").count().collect())
    assert load == [500, 500, 500, 500, 1000]
    # Only the hot group is placed by the driver; the small ones fill the rest.
    df = spark.createDataFrame([(0,)] * 2000 + [(g,) for g in range(1, 30001)], "g long").repartition(4)
    got = fo.group_folds(df, "g", 5)
    load = sorted(r[1] for r in got.groupBy("fold").count().collect())
    assert sum(load) == 32000 and load[-1] - load[0] <= 5 and got.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").isEmpty()


def test_rank_tests_end_to_end(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=60), 1)
    g = np.where(np.arange(60) % 3 == 0, "M", "F")
    age = np.round(x * 5 + rng.normal(size=60) * 9)
    df = spark.createDataFrame(pd.DataFrame({"k": "f", "x": x, "g": g, "age": age}))
    ranks = pd.Series(x).rank().to_numpy()
    n1, n2 = int((g == "M").sum()), int((g == "F").sum())
    u = ranks[g == "M"].sum() - n1 * (n1 + 1) / 2
    ties = sum(c**3 - c for c in pd.Series(x).value_counts())
    sd = math.sqrt(n1 * n2 / 12 * (61 - ties / (60 * 59)))
    p = math.erfc((max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2))
    got = rk.mann_whitney(df, ["k"], "x", "g", "M", "F").first()
    assert abs(got.u - u) < 1e-9 and abs(got.p_value - p) < 1e-12
    c = rk.correlations(df, ["k"], "age", "x").first()
    rho = np.corrcoef(pd.Series(age).rank(), ranks)[0, 1]
    assert abs(c.rho - rho) < 1e-9 and abs(c.r - np.corrcoef(age, x)[0, 1]) < 1e-9
    t = rho * math.sqrt(58 / (1 - rho**2))
    assert abs(c.rho_p - tails.t_two_sided(t, 58)) < 1e-12


def test_ranks_and_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch):
    """A sketch that comes out otherwise whenever it is taken, as one merged in another order does."""
    import random

    def cuts(lo, hi):
        draw = random.SystemRandom()
        points = sorted(draw.uniform(lo, hi) for _ in range(skew.CUTS - 1))
        return points, [points[i - 1] for i in range(skew.STEP, skew.CUTS, skew.STEP)]

    shaky = F.udf(cuts, "struct<cuts:array<double>,marks:array<double>>").asNondeterministic()
    monkeypatch.setattr(skew, "cut_points", lambda v: shaky(F.min(v), F.max(v)))
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 4000), "v": np.round(rng.normal(size=8000), 2)})
    df = spark.createDataFrame(pdf)
    got = rk.average_ranks(df, ["k"], "v").toPandas().sort_values(["k", "v"])
    want = pdf.assign(w=pdf.groupby("k").v.rank()).sort_values(["k", "v"])
    assert np.array_equal(got.avg_rank.to_numpy(), want.w.to_numpy())
    for r in skew.exact_quantiles(df, ["k"], "v", [0.25, 0.9], ["lo", "hi"]).collect():
        assert [r.lo, r.hi] == pytest.approx(np.quantile(pdf[pdf.k == r.k].v, [0.25, 0.9]))


def test_wilcoxon_small_sample(spark):
    d = [0.3, -0.1, 0.5, 0.7, -0.2, 0.0]
    got = rk.wilcoxon(spark.createDataFrame([(v,) for v in d], "d double"), [], "d").first()
    assert (got.w_plus, got.w_minus, got.n, got.zeros) == (12.0, 3.0, 5, 1)
    se = math.sqrt(5 * 6 * 11 / 24)
    assert abs(got.p_value - math.erfc(abs(3 - 7.5) / se / math.sqrt(2))) < 1e-12


# --- folds -----------------------------------------------------------------------------
def test_fold_sizes_and_groups(spark):
    df = spark.range(103).select(F.col("id").cast("string").alias("id"), (F.col("id") % 17).alias("g"))
    sizes = [r[1] for r in fo.shuffled_folds(df, "id", 5, 1).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    g = fo.group_folds(df, "g", 5)
    assert g.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    assert g.count() == 103 and g.select("fold").distinct().count() == 5


# --- ridge -----------------------------------------------------------------------------
def make(seed=0, n=80, p=4, missing=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 10, 100, 1][:p] + 50
    if missing:
        x[rng.random((n, p)) < 0.1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 0.5 + np.nan_to_num(x[:, 1]) * 0.02 + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(p)])
    pdf.insert(0, "id", [f"r{i:03d}" for i in range(n)])
    pdf["y"] = y
    return pdf


def table(spark, pdf, k=5):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id string, " + ", ".join(f"{c} double" for c in pdf.columns[1:]))
    return st.record_table(df, "id", [c for c in pdf.columns if c[0] == "x"], ["y"], k, 42)


def fit(xtr, ytr, alpha):
    med = np.nanmedian(xtr, axis=0)
    f = np.where(np.isnan(xtr), med, xtr)
    mu, sd = f.mean(0), f.std(0)
    sd[sd == 0] = 1
    z = (f - mu) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (ytr - ytr.mean()))
    return (lambda x: ytr.mean() + ((np.where(np.isnan(x), med, x) - mu) / sd) @ beta), beta, z


def test_cross_validation_matches_numpy(spark):
    pdf = make()
    t = table(spark, pdf)
    got = t.toPandas().sort_values("pos")
    xs = ["x0", "x1", "x2", "x3"]
    x, y, fold = got[xs].to_numpy(float), got["y"].to_numpy(), got["fold"].to_numpy()
    yhat, rs_ = np.empty(len(y)), []
    for f in range(5):
        predict, _, _ = fit(x[fold != f], y[fold != f], 100.0)
        yhat[fold == f] = predict(x[fold == f])
        rs_.append(np.corrcoef(y[fold == f], yhat[fold == f])[0, 1])
    cv = st.cross_validate(t, xs, ["y"])
    s = cv.scores(Spec("m", tuple(xs), "y"))
    assert abs(s["r_foldmean"] - np.mean(rs_)) < 1e-9
    assert abs(s["r_oof"] - np.corrcoef(y, yhat)[0, 1]) < 1e-9
    assert abs(s["RMSE"] - np.sqrt(np.mean((y - yhat) ** 2))) < 1e-9
    assert abs(s["R2_oof"] - (1 - ((y - yhat) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9
    pred = cv.df.select("pos", cv.prediction(Spec("m", tuple(xs), "y")).alias("p")).toPandas().sort_values("pos")["p"]
    assert np.allclose(pred, yhat, atol=1e-9)


def _choose(z, y, k):
    """Mean R2 over consecutive inner folds."""
    n = len(y)
    edges = np.cumsum([0] + [n // k + (i < n % k) for i in range(k)])
    best, score = None, -np.inf
    for a in ridge.ALPHA_GRID:
        s = 0.0
        for lo, hi in zip(edges[:-1], edges[1:]):
            te = np.zeros(n, bool)
            te[lo:hi] = True
            mu = z[~te].mean(0)
            zc, yc = z[~te] - mu, y[~te] - y[~te].mean()
            b = np.linalg.solve(zc.T @ zc + a * np.eye(z.shape[1]), zc.T @ yc)
            e = y[te] - y[~te].mean() - (z[te] - mu) @ b
            s += 1 - (e**2).sum() / ((y[te] - y[te].mean()) ** 2).sum()
        if s > score:
            best, score = a, s
    return best


def test_alpha_selection_matches_numpy(spark):
    pdf = make(2, 63)
    xs = ["x0", "x1", "x2", "x3"]
    summary, top = st.alpha_selection(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id string, x0 double, x1 double, x2 double, x3 double, y double"), "id", ["y"], xs, 5, 42, top=2)
    d = table(spark, pdf).toPandas().sort_values("pos")
    x, y, fold = d[xs].to_numpy(float), d["y"].to_numpy(), d["fold"].to_numpy()
    yhat = np.empty(len(y))
    for f in range(5):
        tr = fold != f
        _, _, z = fit(x[tr], y[tr], 1.0)
        predict, _, _ = fit(x[tr], y[tr], _choose(z, y[tr], 5))
        yhat[~tr] = predict(x[~tr])
    _, _, z = fit(x, y, 1.0)
    alpha = _choose(z, y, 5)
    _, beta, _ = fit(x, y, alpha)
    s = summary.first()
    assert abs(s.alpha - alpha) < 1e-9 and abs(s.pearson_cv - np.corrcoef(y, yhat)[0, 1]) < 1e-8
    assert abs(s.r2_cv - (1 - ((y - yhat) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-8
    got = {r.feature: r.coef for r in top.collect()}
    order = np.argsort(-np.abs(beta))[:2]
    assert set(got) == {xs[i] for i in order} and all(abs(got[xs[i]] - beta[i]) < 1e-8 for i in order)


def test_bootstrap_with_chosen_alpha_matches_numpy(spark):
    import hashlib

    pdf = make(4, 41, 3)
    xs = ["x0", "x1", "x2"]
    t = table(spark, pdf)
    got = rs.bootstrap_coefficients(t, xs, "y", None, 3, 42).toPandas()
    d = t.toPandas().sort_values("pos")
    x, y, n = d[xs].to_numpy(float), d["y"].to_numpy(), len(d)
    for rep in (1, 2, 3):
        idx = [int(hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
        _, _, z = fit(x[idx], y[idx], 1.0)
        alpha = _choose(z, y[idx], 5)
        _, beta, _ = fit(x[idx], y[idx], alpha)
        g = got[got["rep"] == rep].set_index("feature")
        assert np.allclose(g.loc[xs, "coef"], beta, atol=1e-8) and abs(g["alpha"].iloc[0] - alpha) < 1e-9
    a = rs.alpha_distribution(spark.createDataFrame(got)).first()
    assert a.n == 3 and a.min <= a.p50 <= a.max


def test_constant_feature_and_outcome(spark):
    pdf = make(6, 40, 2, missing=False)
    pdf["x1"] = 3.0
    t = table(spark, pdf)
    s = st.cross_validate(t, ["x0", "x1"], ["y"]).scores(Spec("m", ("x0", "x1"), "y"))
    assert np.isfinite(s["r_oof"])
    pdf["y"] = 1.0
    t = table(spark, pdf)
    out = rs.permutation_test(st.cross_validate(t, ["x0"], ["y"]), [Spec("m", ("x0",), "y")], "id", 3, 42).first()
    assert out.r_foldmean is None and 0 < out.p_value <= 1


def test_permutation_null_and_signal(spark):
    pdf = make(7, 60, 3, missing=False)
    noise = pdf.assign(y=np.random.default_rng(99).normal(size=60))
    make_df = lambda p: spark.createDataFrame(p)
    spec = [Spec("m", ("x0", "x1", "x2"), "y", 1.0)]
    strong = st.permutation_study(make_df(pdf), "id", spec, 60).first()
    weak = st.permutation_study(make_df(noise), "id", spec, 60).first()
    assert strong.p_value < 0.05 and weak.p_value > 0.05 and strong.r_foldmean > weak.r_foldmean


def test_missing_outcomes_drop_only_their_rows(spark):
    pdf = make(8, 50, 2, missing=False)
    pdf["y2"] = pdf["y"]
    pdf.loc[:4, "y2"] = np.nan
    df = spark.createDataFrame(pdf)
    r = st.permutation_study(df, "id", [Spec("a", ("x0",), "y"), Spec("b", ("x0",), "y2")], 0)
    assert {x.name: x.n for x in r.collect()} == {"a": 50, "b": 45}


def test_stage_sets():
    cols = DEMOGRAPHICS + CLASSICAL + NOVEL
    assert [len(f) for _, f in st.stage_sets(cols).values()] == [2, 12, 21]
    assert list(st.stage_sets(CLASSICAL + NOVEL)) == [2, 3]
    assert list(st.stage_sets(DEMOGRAPHICS + CLASSICAL)) == [1, 2]
    with pytest.raises(KeyError):
        st.stage_sets(NOVEL)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 30, 81, 1000])
def test_permutations_are_one_to_one_and_invert(n):
    pos = np.arange(n)
    p = Permutations(42, range(1, 41), n)
    image = p(pos)
    assert (np.sort(image, axis=1) == pos).all()
    assert all((Permutations(42, [rep], n)(image[rep - 1], back=True)[0] == pos).all() for rep in range(1, 41))
    assert n < 7 or len({tuple(row) for row in image}) == 40


def test_permutations_are_even_over_places():
    """Every place goes everywhere alike often, alone and in pairs (chi-square far from both tails)."""
    n, reps = 12, 20000
    image = Permutations(7, range(reps), n)(np.arange(n))
    for cells, k in ((np.arange(n) * n + image, n * n), (image[:, 3] * n + image[:, 8], None)):
        seen = np.bincount(cells.ravel(), minlength=n * n)
        seen = seen if k else seen[~np.eye(n, dtype=bool).ravel()]
        expected = seen.sum() / len(seen)
        chi, df = ((seen - expected) ** 2 / expected).sum(), len(seen) - 1
        assert abs(chi - df) < 6 * np.sqrt(2 * df)


def test_permuted_sums_match_a_plain_loop_on_both_paths(spark, monkeypatch):
    from turnweave.operators import skew

    pdf = make(11, 90, 2)
    pdf["y2"] = pdf["y"] ** 2
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id string, " + ", ".join(f"{c} double" for c in pdf.columns[1:]))
    t = st.record_table(df, "id", ["x0", "x1"], ["y", "y2"], 5, 42)
    b = ridge.basis(t, ["x0", "x1"], ["y", "y2"])
    rows = t.select("pos", "fold", *b.vector()).toPandas().sort_values("pos")
    z, y = rows[[f"z{i}" for i in range(1, b.width - 2)]].to_numpy(), rows[[f"z{b.width - 2}", f"z{b.width - 1}"]].to_numpy()
    image = Permutations(42, [1, 2, 3], b.n)(np.arange(b.n))
    for limit in (skew.BROADCAST_BYTES, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        got = rs.permuted_sums(t, b, 3, 42).collect()
        assert len(got) == 6
        for row in got:
            star = y[image[row.rep - 1], row.o]
            for part in row.parts:
                at = (rows["fold"] == part.fold).to_numpy()
                assert np.allclose([part.sy, part.syy, *part.zy], [star[at].sum(), (star[at] ** 2).sum(), *(star[at] @ z[at])])


def test_permuted_sums_hold_little_at_once():
    import tracemalloc
    from types import SimpleNamespace

    n, rng = 90_000, np.random.default_rng(2)
    pdf = pd.DataFrame({"pos": np.arange(7500), "fold": np.arange(7500) % 5, "x0": rng.normal(size=7500)})
    y = rng.normal(size=n)
    tracemalloc.start()
    got = pd.concat(rs._fold_sums(SimpleNamespace(value=[y]), ["x0"], n, 300, 42)([pdf]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    star = y[Permutations(42, [7], n)(pdf["pos"].to_numpy())[0]]
    row = got[(got.rep == 7) & (got.fold == 3)].iloc[0]
    at = pdf["fold"].to_numpy() == 3
    assert len(got) == 1500 and np.allclose([row.sy, row.syy, row.x0], [star[at].sum(), (star[at] ** 2).sum(), (star[at] * pdf.x0[at]).sum()])


def test_large_paths_match_small_paths(spark, monkeypatch):
    from turnweave.operators import skew

    t = table(spark, make(9, 90, 3))
    xs = ["x0", "x1", "x2"]
    key = ["rep", "feature"]
    a = rs.bootstrap_coefficients(t, xs, "y", 100.0, 4, 42).toPandas().sort_values(key)
    m = ridge.train_medians(t, ridge.basis(t, xs, ["y"]), 5)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 20)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)
    b = rs.bootstrap_coefficients(t, xs, "y", 100.0, 4, 42).toPandas().sort_values(key)
    assert np.allclose(a["coef"], b["coef"])
    n = ridge.train_medians(t, ridge.basis(t, xs, ["y"]), 5)
    assert all(abs(m[f][c] - n[f][c]) < 1e-12 for f in m for c in m[f])


def test_rank_sum_tail_in_constant_memory():
    import tracemalloc

    for m in range(1, 9):  # against running sums over all U
        for n in (m, 11, 30):
            n = max(m, n)
            ways = np.zeros(m * n + 1, dtype=object)
            ways[0] = 1
            for i in range(1, m + 1):
                for j in range(m * n, n + i - 1, -1):
                    ways[j] -= ways[j - n - i]
                for j in range(i, m * n + 1):
                    ways[j] += ways[j - i]
            for u in range(0, m * n + 1, 7):
                want = min(1.0, 2 * sum(ways[:min(u, m * n - u) + 1]) / math.comb(m + n, m))
                assert math.isclose(tails.rank_sum_exact(u, n, m), want, rel_tol=1e-14)
    tracemalloc.start()
    p = [tails.rank_sum_exact(float(u), 8, 10**9) for u in (0, 10**9, 3 * 10**9, 4 * 10**9)]
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()
    assert p == sorted(p) and 0 < p[0] < 1e-60 and p[3] == 1.0
    z = (3e9 - 4e9) / math.sqrt(8e9 * (10**9 + 9) / 12)
    assert abs(p[2] - math.erfc(-z / math.sqrt(2))) < 0.02


# --- draws -------------------------------------------------------------------------
def test_draws_of_ranges_are_the_draws_of_the_whole():
    from turnweave.functions.draws import Draws

    for n, span in ((1, 4), (4, 4), (5, 4), (103, 10), (64, 8)):
        d = Draws(7, n, span)
        for rep in (1, 2):
            for _, first, last in d.blocks(3):
                shares = [d.share(rep, first, last, at) for at in range(d.ranges)]
                assert shares[0][0] == first and shares[-1][1] == last
                assert all(a[1] == b[0] for a, b in zip(shares, shares[1:]))
                got = d.places(rep, first, last)
                assert len(got) == last - first and got.min() >= 0 and got.max() < n
                assert got.tolist() == d.places(rep, first, last).tolist()
    assert Draws(1, 3).blocks(5) == [(0, 0, 1), (1, 1, 2), (2, 2, 3)] and Draws(1, 0).blocks(2) == []


def test_draws_of_one_range_are_plain_hashes():
    import hashlib

    from turnweave.functions.draws import Draws

    want = [int(hashlib.md5(f"42:3:{i}".encode()).hexdigest()[:8], 16) % 50 for i in range(10, 40)]
    assert Draws(42, 50).places(3, 10, 40).tolist() == want


def test_hash_heads_equal_hashlib_in_a_fraction_of_the_time():
    import time
    from hashlib import md5

    from turnweave.functions.draws import Draws
    from turnweave.functions.md5heads import Heads

    plain = lambda head, a, b: np.frombuffer(b"".join(md5(head + b"%d" % i).digest() for i in range(a, b)), ">u4")[::4]
    heads = Heads()
    for head in (b"", b"42:1:", b"42:17:", b"42:5000:", b"-7:123456:"):
        for a, b in ((0, 25), (3, 3), (95, 1203), (9990, 14000), (32700, 32800), (99990, 100020), (9999999990, 10000000003)):
            assert np.array_equal(heads(head, a, b), plain(head, a, b)), (head, a, b)
    draws, n = Draws(42, 200_000), 200_000
    draws.inside(1, 0, n, 0)
    start = time.process_time()
    got = draws.inside(2, 0, n, 0)
    middle = time.process_time()
    want = plain(b"42:2:", 0, n)
    assert np.array_equal(got, want.astype(np.int64) % n)
    assert middle - start < (time.process_time() - middle) / 2


def test_draws_over_ranges_are_uniform_and_independent():
    from turnweave.functions.draws import Draws

    n, reps = 45, 4000  # ranges of 8, the last of 5
    d = Draws(11, n, 8)
    counts = np.array([np.bincount(d.places(r, 0, n), minlength=n) for r in range(reps)])
    chi = ((counts.sum(0) - reps) ** 2 / reps).sum()
    assert chi < n - 1 + 5 * math.sqrt(2 * (n - 1))
    # multinomial: variance n p (1 - p), covariance -n p^2, within a range and between ranges
    cov = np.cov(counts.T)
    assert abs(np.diag(cov).mean() - (1 - 1 / n)) < 0.02
    off = ~np.eye(n, dtype=bool)
    same = np.equal.outer(np.arange(n) // 8, np.arange(n) // 8) & off
    assert abs(cov[same].mean() + 1 / n) < 0.01 and abs(cov[off & ~same].mean() + 1 / n) < 0.01


def test_weighted_median():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        v, w = rng.integers(0, 9, n).astype(float), rng.integers(0, 4, n)
        w[0] += 1
        assert rs.weighted_median(v, np.argsort(v), w) == np.median(np.repeat(v, w))
    assert rs.weighted_median(np.array([1.0]), np.array([0]), np.array([0])) is None
    assert rs.weighted_median(np.array([1.0]), np.array([], int), np.array([3])) is None


def test_weighted_quantiles_equal_repeated_rows(spark):
    from turnweave.operators import skew

    rng = np.random.default_rng(4)
    rows = [(int(k), float(v), int(w)) for k, v, w in zip(rng.integers(0, 3, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300))]
    rows += [(9, None, 4), (9, 2.5, 3), (10, 1.0, 0)]
    t = spark.createDataFrame(rows, "k int, v double, w int")
    got = {r.k: (r.a, r.b) for r in skew.exact_quantiles(t, ["k"], "v", [0.5, 0.9], ["a", "b"], weight="w").collect()}
    want = {}
    for k in (0, 1, 2, 9):
        v = np.repeat([r[1] for r in rows if r[0] == k and r[1] is not None], [r[2] for r in rows if r[0] == k and r[1] is not None])
        want[k] = tuple(np.quantile(v, [0.5, 0.9]))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("span", [None, 16])
@pytest.mark.parametrize("alpha", [100.0, None])
def test_bootstrap_paths_match_a_plain_loop(spark, monkeypatch, span, alpha):
    """Shared and dealt rows, one range and six, features with missing values, against numpy."""
    from turnweave.functions import draws
    from turnweave.operators import skew

    if span:
        monkeypatch.setattr(draws, "SPAN", span)
    xs = ["x0", "x1", "x2"]
    t = table(spark, make(9, 90, 3))
    d = t.toPandas().sort_values("pos")
    x, y, n = d[xs].to_numpy(float), d["y"].to_numpy(), len(d)
    x[::7, 1] = np.nan
    d["x1"] = x[:, 1]
    t = spark.createDataFrame([(int(p), *[None if np.isnan(v) else float(v) for v in row], float(o))
                               for p, row, o in zip(d["pos"], x, y)], "pos long, x0 double, x1 double, x2 double, y double")
    by = draws.Draws(42, n)
    key, found = ["rep", "feature"], []
    for limit in (skew.BROADCAST_BYTES, 0):
        monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
        found.append(rs.bootstrap_coefficients(t, xs, "y", alpha, 5, 42).toPandas().sort_values(key, ignore_index=True))
    assert len(found[0]) == 15 and np.allclose(found[0]["coef"], found[1]["coef"]) and np.allclose(found[0]["alpha"], found[1]["alpha"])
    for rep in range(1, 6):
        idx = np.concatenate([by.places(rep, a, b) for _, a, b in by.blocks(1 if alpha else 5)])
        z = x[idx]
        z = np.where(np.isnan(z), np.nanmedian(z, axis=0), z)
        g = found[0][found[0]["rep"] == rep].set_index("feature")
        _, beta, _ = fit(z, y[idx], g["alpha"].iloc[0])
        assert np.allclose(g.loc[xs, "coef"], beta, atol=1e-8)


def test_paired_bootstrap_paths_agree(spark, monkeypatch):
    from turnweave.functions import draws
    from turnweave.operators import skew

    rng = np.random.default_rng(8)
    v = rng.normal(0.1, 1, 83)
    t = spark.createDataFrame([(i, float(a)) for i, a in enumerate(v)], "pos long, d double")
    for span in (1 << 18, 10):
        monkeypatch.setattr(draws, "SPAN", span)
        by, got = draws.Draws(5, 83), []
        for limit in (64 << 20, 0):
            monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
            got.append(rs.paired_bootstrap(t, 83, 200, 5).first())
        m = np.array([v[by.places(r, 0, 83)].mean() for r in range(1, 201)])
        p = min(1.0, 2 * min((m <= 0).sum() + 1, (m >= 0).sum() + 1) / 201)
        want = [v.mean(), *np.quantile(m, [0.025, 0.975]), p]
        assert all(np.allclose([r.mean_diff, r.ci_lo, r.ci_hi, r.p_boot], want) for r in got)


def test_resampling_exchanges_no_drawn_rows(spark):
    """The shared path has no exchange at all; the dealt one moves each row once per copy, not once per replicate."""
    from turnweave.functions.draws import Draws

    t = spark.createDataFrame([(i, float(i)) for i in range(40)], "pos long, d double")
    keep = lambda rep, z, picks: pd.DataFrame({"rep": [rep], "rows": [len(z)]})
    shared = rs._shared(t, ["d"], 40)
    a = rs.resample(t, ["d"], Draws(1, 40, 10), 30, 1, shared, keep, "rep int, rows int")
    assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.rep for r in a.collect()) == list(range(1, 31)) and {r.rows for r in a.collect()} == {40}
    b = rs.resample(t, ["d"], Draws(1, 40, 10), 30, 1, None, keep, "rep int, rows int").collect()
    assert sorted(r.rep for r in b) == sorted(list(range(1, 31)) * 4) and {r.rows for r in b} == {10}
