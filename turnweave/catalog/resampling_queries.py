"""Folds, ridge, permutation and bootstrap over the document record table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import WORDS
from ..functions.permutation import PRIME, ROUNDS
from ..operators import folds as fo
from ..operators import ranks as rk
from ..operators import resampling as rs
from ..operators import ridge
from ..operators.ridge import Spec
from ..plans import studies as st
from . import query, sql_penalty, sql_tails
from .views import r, rounded, table

SEED, K = 42, 5
X = ["x_words", "x_lines", "x_commas", "x_comma_gap", "x_upper"]


# --- record table -----------------------------------------------------------------
def records(spark, sf):
    t = F.col("text")
    count = lambda s: (F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))).cast("double")
    commas = count(",")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "source",
        count(" ").alias("x_words"), count("\n").alias("x_lines"), commas.alias("x_commas"),
        F.when(commas > 0, F.try_divide(F.length(t).cast("double"), commas)).alias("x_comma_gap"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("double").alias("x_upper"),
        (F.col("quality") + F.col("toxic") * 0.5).alias("y_label"),
        (F.length(t) / F.lit(1000.0)).alias("y_size"),
    )


RECORDS = """SELECT doc_id::VARCHAR AS id, source,
  (length(text) - length(replace(text, ' ', '')))::DOUBLE AS x_words, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS x_lines,
  (length(text) - length(replace(text, ',', '')))::DOUBLE AS x_commas,
  CASE WHEN contains(text, ',') THEN length(text) / (length(text) - length(replace(text, ',', ''))) END AS x_comma_gap,
  len(regexp_extract_all(text, '[A-Z]'))::DOUBLE AS x_upper,
  quality + toxic * 0.5::DOUBLE AS y_label, length(text) / 1000.0::DOUBLE AS y_size
  FROM documents JOIN labels USING (doc_id)"""

POS = f"row_number() OVER (ORDER BY md5('{SEED}:fold:' || id), id) - 1"
FOLDED = f"SELECT *, {POS} AS pos, ({POS}) % {K} AS fold FROM ({RECORDS})"
# Groups by falling size, each to the emptiest fold.
GROUP_FOLD = f"""WITH RECURSIVE sz AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, md5(source), source) AS rn
    FROM (SELECT source, count(*) AS n FROM ({RECORDS}) GROUP BY 1)),
  g AS (SELECT 0::BIGINT AS rn, NULL::VARCHAR AS source, NULL::BIGINT AS fold, list_transform(range({K}), lambda x: 0::BIGINT) AS load
    UNION ALL SELECT sz.rn, sz.source, list_position(load, list_min(load))::BIGINT - 1,
      list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN sz.n ELSE 0 END)
    FROM g JOIN sz ON sz.rn = g.rn + 1)
  SELECT source, fold FROM g WHERE rn > 0"""
GROUP_FOLDED = f"SELECT d.* EXCLUDE (fold), g.fold FROM ({FOLDED}) d JOIN ({GROUP_FOLD}) g USING (source)"


@query("g2_shuffled_folds", f"SELECT id, pos, fold::INTEGER AS fold FROM ({FOLDED})")
def shuffled_folds(spark, sf):
    return fo.shuffled_folds(records(spark, sf), "id", K, SEED).select("id", "pos", "fold")


@query("g3_group_folds", f"SELECT id, source, fold::INTEGER AS fold FROM ({GROUP_FOLDED})")
def group_folds(spark, sf):
    return fo.group_folds(records(spark, sf), "source", K).select("id", "source", "fold")


# --- ridge as SQL -------------------------------------------------------------------
def sql_design(rows: str, xs: list[str]) -> str:
    """CTE `z`: imputed and standardised rows of `rows`(tf, is_tr, id, pos,
    fold, y, x...), where each tf is one training problem."""
    meds = ", ".join(f"quantile_cont({x}, 0.5) FILTER (is_tr) AS m_{x}" for x in xs)
    imp = ", ".join(f"coalesce({x}, m_{x}) AS {x}" for x in xs)
    mus = ", ".join(f"avg({x}) FILTER (is_tr) AS mu_{x}, stddev_pop({x}) FILTER (is_tr) AS sd_{x}" for x in xs)
    zs = ", ".join(f"({x} - mu_{x}) / CASE WHEN sd_{x} > 0 THEN sd_{x} ELSE 1 END" for x in xs)
    return f"""src AS ({rows}),
med AS (SELECT tf, {meds} FROM src GROUP BY 1),
imp AS (SELECT id, pos, fold, tf, is_tr, y, {imp} FROM src JOIN med USING (tf)),
sc AS (SELECT tf, avg(y) FILTER (is_tr) AS ybar, {mus} FROM imp GROUP BY 1),
z AS (SELECT id, pos, fold, tf, is_tr, y, ybar, [{zs}] AS z FROM imp JOIN sc USING (tf))"""


def sql_train(src: str, xs: list[str], k: int = K) -> str:
    """One training problem per held-out fold."""
    rows = "SELECT base.*, range AS tf, fold <> range AS is_tr FROM base CROSS JOIN range(" + str(k) + ")"
    return f"base AS ({src}), {sql_design(rows, xs)}"


def sql_solve(p: int, alpha: str, rhs: str, source: str = "z") -> str:
    """`coef`(tf, j, i, v): solution i for right-hand side j, by elimination."""
    return f"""lhs AS (SELECT tf, i.range AS i, j.range AS j, sum(z[i.range] * z[j.range]) + CASE WHEN i.range = j.range THEN {alpha} ELSE 0 END AS v
  FROM {source}, range(1, {p + 1}) i, range(1, {p + 1}) j WHERE is_tr GROUP BY tf, i.range, j.range),
rhs AS ({rhs}),
gj(s, tf, i, j, v) AS (
  SELECT 0, tf, i, j, v FROM (SELECT tf, i, j, v FROM lhs UNION ALL SELECT tf, i, j, v FROM rhs)
  UNION ALL
  SELECT s + 1, tf, i, j, CASE WHEN i = s + 1 THEN v / piv ELSE v - colv * rowv / piv END FROM (
    SELECT *, max(CASE WHEN i = s + 1 AND j = s + 1 THEN v END) OVER (PARTITION BY tf) AS piv,
      max(CASE WHEN j = s + 1 THEN v END) OVER (PARTITION BY tf, i) AS colv,
      max(CASE WHEN i = s + 1 THEN v END) OVER (PARTITION BY tf, j) AS rowv
    FROM gj WHERE s < {p})),
coef AS (SELECT tf, j, i, v FROM gj WHERE s = {p} AND j > {p})"""


def sql_predictions(src: str, xs: list[str], alpha: float = 100.0) -> str:
    """Out-of-fold prediction rows: id, pos, fold, y, yhat."""
    p = len(xs)
    rhs = f"SELECT tf, i.range AS i, {p + 1} AS j, sum(z[i.range] * (y - ybar)) AS v FROM z, range(1, {p + 1}) i WHERE is_tr GROUP BY tf, i.range"
    return f"""WITH RECURSIVE {sql_train(src, xs)}, {sql_solve(p, str(alpha), rhs)},
beta AS (SELECT tf, list(v ORDER BY i) AS b FROM coef GROUP BY 1)
SELECT id, pos, fold, y, ybar + list_dot_product(z, b) AS yhat FROM z JOIN beta USING (tf) WHERE NOT is_tr"""


def _src(y: str, folded: str = FOLDED) -> str:
    return f"SELECT id, pos, fold, {y} AS y, {', '.join(X)} FROM ({folded})"


def sql_scores(pred: str, name: str, outcome: str, p: int, alpha: float = 100.0) -> str:
    return f"""SELECT '{name}' AS name, '{outcome}' AS outcome, {p}::INTEGER AS n_features, {alpha}::DOUBLE AS alpha, count(*) AS n,
  (SELECT round(avg(rf), 6) + 0.0 FROM (SELECT corr(y, yhat) AS rf FROM ({pred}) GROUP BY fold)) AS r_foldmean,
  {r('corr(y, yhat)', 'r_oof')}, {r('1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*))', '"R2_oof"')},
  {r('sqrt(avg((yhat - y) ** 2))', '"RMSE"')} FROM ({pred})"""


@query("g7_g8_cv_scores", " UNION ALL ".join(
    sql_scores(sql_predictions(_src(y), X), "all", y, 5) for y in ("y_label", "y_size")))
def cv_scores(spark, sf):
    specs = [Spec("all", tuple(X), y) for y in ("y_label", "y_size")]
    return rounded(st.fit_scores(records(spark, sf), "id", specs, K, SEED))


@query("g7_group_cv_scores", sql_scores(sql_predictions(_src("y_label", GROUP_FOLDED), X), "all", "y_label", 5))
def group_cv_scores(spark, sf):
    return rounded(st.fit_scores(records(spark, sf), "id", [Spec("all", tuple(X), "y_label")], K, SEED, "source"))


@query("g8_oof_predictions", f"SELECT id, fold::INTEGER AS fold, {r('y', 'y')}, {r('yhat', 'yhat')} FROM ({sql_predictions(_src('y_size'), X)})")
def oof_predictions(spark, sf):
    pred, _ = st.stage_predictions(records(spark, sf), "id", "y_size", {1: ("all", tuple(X))}, K, SEED)
    return rounded(pred.select("id", "fold", "y", F.col("yhat1").alias("yhat")))


@query("g9_oof_metrics", f"""SELECT count(*) AS n, {r('corr(y, yhat)', 'r_oof')}, {r('1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*))', '"R2_oof"')},
  {r('sqrt(avg((yhat - y) ** 2))', '"RMSE"')}, {r('avg(abs(yhat - y))', '"MAE"')} FROM ({sql_predictions(_src('y_size'), X)})""")
def oof_metrics(spark, sf):
    pred, _ = st.stage_predictions(records(spark, sf), "id", "y_size", {1: ("all", tuple(X))}, K, SEED)
    return rounded(st.oof_metrics(pred, "yhat1"))


# --- permutation -----------------------------------------------------------------
N_PERM = 5000
N_PERM_GROUPED = 1000


def sql_rounds(places: str) -> str:
    """rep, pos, x after the rounds of `functions/permutation.py`, from places (rep, pos, x)."""
    out = f"SELECT rep, pos, x // b AS l, x % b AS r, a, b, c FROM {places} JOIN kc USING (rep), sides"
    for i in range(ROUNDS):
        to, by, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        c = [f"c[{4 * i + j + 1}]" for j in range(4)]
        f = f"((({c[3]} * {by} + {c[2]}) % {PRIME} * {by} + {c[1]}) % {PRIME} * {by} + {c[0]}) % {PRIME}"
        out = f"SELECT * REPLACE (({to} + {f} % {size}) % {size} AS {to}) FROM ({out})"
    return f"SELECT rep, pos, l * b + r AS x FROM ({out})"


def sql_ystar(n_perm: int) -> str:
    """`ystar`(rep, pos, ys): the permuted outcome of each position; replicate 0 is the observed order."""
    return f"""kc AS (SELECT rep.range AS rep, list(('0x' || substr(md5('{SEED}:' || rep.range || ':' || i.range // 4), 1 + 8 * (i.range % 4), 8))::BIGINT % {PRIME}
    ORDER BY i.range) AS c FROM range(1, {n_perm + 1}) rep, range({4 * ROUNDS}) i GROUP BY 1),
sides AS (SELECT a, (n + a - 1) // a AS b, n FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM base)),
walk(rep, pos, x) AS (
  {sql_rounds("(SELECT rep, pos, pos AS x FROM base, kc)")}
  UNION ALL {sql_rounds("(SELECT rep, pos, x FROM walk WHERE x >= (SELECT n FROM sides))")}),
ystar AS (SELECT 0 AS rep, pos, y AS ys FROM base UNION ALL SELECT w.rep, w.pos, base.y FROM walk w JOIN base ON base.pos = w.x)"""


def sql_permuted(src: str, xs: list[str], alpha: float = 100.0, n_perm: int = N_PERM) -> str:
    """rep, r_foldmean, r_oof; replicate 0 is the observed order."""
    p = len(xs)
    rhs = f"""SELECT tf, i.range AS i, {p + 1} + rep AS j, sum(z[i.range] * ys) AS v FROM z JOIN ystar USING (pos), range(1, {p + 1}) i
      WHERE is_tr GROUP BY tf, i.range, rep"""
    return f"""WITH RECURSIVE {sql_train(src, xs)},
{sql_ystar(n_perm)},
{sql_solve(p, str(alpha), rhs)},
beta AS (SELECT tf, j - {p + 1} AS rep, list(v ORDER BY i) AS b FROM coef GROUP BY 1, 2),
yb AS (SELECT tf, rep, avg(ys) AS yb FROM z JOIN ystar USING (pos) WHERE is_tr GROUP BY 1, 2),
pr AS (SELECT rep, fold, ys, yb + list_dot_product(z, b) AS yhat FROM z JOIN beta USING (tf) JOIN yb USING (tf, rep) JOIN ystar USING (pos, rep)
  WHERE NOT is_tr),
rf AS (SELECT rep, CASE WHEN NOT isnan(avg(rf)) THEN avg(rf) END AS r_foldmean FROM (SELECT rep, fold, corr(ys, yhat) AS rf FROM pr GROUP BY 1, 2) GROUP BY 1),
ro AS (SELECT rep, CASE WHEN NOT isnan(corr(ys, yhat)) THEN corr(ys, yhat) END AS r_oof, count(*) AS n FROM pr GROUP BY 1)
SELECT rep, r_foldmean, r_oof, n FROM rf JOIN ro USING (rep)"""


def sql_test(perm: str, name: str, outcome: str, p: int, alpha: float = 100.0, n_perm: int = N_PERM, by: str = "r_foldmean") -> str:
    return f"""SELECT '{name}' AS name, '{outcome}' AS outcome, {p}::INTEGER AS n_features, {alpha}::DOUBLE AS alpha, max(n) AS n,
  {r('max(r_foldmean) FILTER (rep = 0)', 'r_foldmean')}, {r('max(r_oof) FILTER (rep = 0)', 'r_oof')},
  {r(f'(count(*) FILTER (rep > 0 AND abs({by}) >= seen) + 1.0) / {n_perm + 1}', 'p_value')}
  FROM (SELECT *, max(abs({by})) FILTER (rep = 0) OVER () AS seen FROM ({perm}))"""


def _union_all(parts) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


_TESTS = [("all", "y_label", X), ("all", "y_size", X), ("two", "y_label", X[:2])]


@query("g11_permutation_test", _union_all(sql_test(sql_permuted(_src(y), xs), n, y, len(xs)) for n, y, xs in _TESTS))
def permutation_test(spark, sf):
    specs = [Spec(n, tuple(xs), y) for n, y, xs in _TESTS]
    return rounded(st.permutation_study(records(spark, sf), "id", specs, N_PERM, K, SEED))


@query("g11_permutation_test_pooled", sql_test(sql_permuted(_src("y_label"), X), "all", "y_label", 5, by="r_oof"))
def permutation_test_pooled(spark, sf):
    return rounded(st.permutation_study(records(spark, sf), "id", [Spec("all", tuple(X), "y_label")], N_PERM, K, SEED, aggregate="r_oof"))


_FAMILY = {("L", "a"): "y_label", ("S", "a"): "y_size", ("L", "b"): "y_label_b", ("S", "b"): "y_size_b"}
_Y_SQL = {"y_label": "y_label", "y_size": "y_size", "y_label_b": "y_label + x_lines / 50", "y_size_b": "y_size - x_upper / 10"}


@query("g12_trait_families", f"""WITH t AS ({_union_all(f"SELECT '{t}' AS trait, '{w}' AS teacher, r_foldmean AS r_obs, round(p_value, 4) AS p_value FROM ({sql_test(sql_permuted(_src(_Y_SQL[y]), X), 'm', y, 5)})" for (t, w), y in _FAMILY.items())}),
  k AS (SELECT *, row_number() OVER (PARTITION BY teacher ORDER BY p_value) AS rn, count(*) OVER (PARTITION BY teacher) AS m FROM t)
  SELECT trait, teacher, r_obs, p_value, {r('least(1.0, max(p_value * (m - rn + 1)) OVER (PARTITION BY teacher ORDER BY rn))', 'p_corrected')} FROM k""")
def trait_families(spark, sf):
    d = records(spark, sf).withColumn("y_label_b", F.col("y_label") + F.col("x_lines") / 50).withColumn(
        "y_size_b", F.col("y_size") - F.col("x_upper") / 10)
    return rounded(st.trait_family(d, "id", X, _FAMILY, n_perm=N_PERM, k=K, seed=SEED))


def _pair_sql(parts: dict, outcome: str) -> str:
    (na, a), (nb, b) = parts.items()
    cols = lambda t, n: f"{t}.r_foldmean AS r_{n}, {t}.p_value AS p_{n}"
    return f"""SELECT '{outcome}' AS outcome, {cols('a', na)}, {cols('b', nb)}, round(b.raw - a.raw + 1e-9, 6) + 0.0 AS delta_r
  FROM ({a}) a, ({b}) b"""


def _raw(src: str, xs: list[str], outcome: str, n_perm: int = N_PERM) -> str:
    """The test's row with the unrounded observed r."""
    seen = sql_permuted(src, xs, n_perm=0)  # the observed order only
    test = sql_test(sql_permuted(src, xs, n_perm=n_perm), "m", outcome, len(xs), n_perm=n_perm)
    return f"SELECT t.*, (SELECT r_foldmean FROM ({seen}) WHERE rep = 0) AS raw FROM ({test}) t"


def _sets_sql(names, base, more, folded=FOLDED, y="y_label", n_perm=N_PERM):
    return _pair_sql({names[0]: _raw(_src(y, folded), base, y, n_perm),
                      names[1]: _raw(_src(y, folded), base + more, y, n_perm)}, y)


@query("g24_baseline_vs_extended", _sets_sql(("baseline", "extended"), X[:2], X[2:]))
def baseline_vs_extended(spark, sf):
    return rounded(st.compare_feature_sets(records(spark, sf), "id", ["y_label"], X[:2], X[2:], n_perm=N_PERM, k=K, seed=SEED))


_CONF = ("features_only", "with_confounds")


@query("g25_confound_control", _sets_sql(_CONF, X[:3], X[3:], y="y_size"))
def confound_control(spark, sf):
    return rounded(st.compare_feature_sets(records(spark, sf), "id", ["y_size"], X[:3], X[3:], _CONF, N_PERM, K, SEED))


@query("g26_confound_control_grouped", _sets_sql(_CONF, X[:3], X[3:], GROUP_FOLDED, n_perm=N_PERM_GROUPED))
def confound_control_grouped(spark, sf):
    return rounded(st.compare_feature_sets(records(spark, sf), "id", ["y_label"], X[:3], X[3:], _CONF, N_PERM_GROUPED, K, SEED, "source"))


@query("g27_kfold_vs_groupkfold", f"""SELECT *, CASE WHEN p_kfold < 0.05 THEN '**' ELSE 'n.s.' END AS sig_kfold,
  CASE WHEN p_groupkfold < 0.05 THEN '**' ELSE 'n.s.' END AS sig_groupkfold FROM (""" + _pair_sql({
    "kfold": _raw(_src("y_label"), X, "y_label", N_PERM_GROUPED),
    "groupkfold": _raw(_src("y_label", GROUP_FOLDED), X, "y_label", N_PERM_GROUPED)}, "y_label") + ")")
def kfold_vs_group(spark, sf):
    return rounded(st.compare_folds(records(spark, sf), "id", ["y_label"], X, "source", N_PERM_GROUPED, K, SEED))


STAGES = {1: ("demographics", tuple(X[:1])), 2: ("demographics+classical", tuple(X[:3])),
          3: ("demographics+classical+novel", tuple(X))}


@query("g21_nested_stages", f"""SELECT outcome, stage, n_features, feature_set, round(raw + 1e-9, 6) + 0.0 AS r_obs, p_value,
  round(raw - lag(raw) OVER (ORDER BY stage) + 1e-9, 6) + 0.0 AS delta_r_from_prev FROM (""" + _union_all(
    f"SELECT {s} AS stage, '{n}' AS feature_set, t.* FROM ({_raw(_src('y_label'), list(f), 'y_label')}) t"
    for s, (n, f) in STAGES.items()) + ")")
def nested_stages(spark, sf):
    return rounded(st.nested_stages(records(spark, sf), "id", ["y_label"], STAGES, N_PERM, K, SEED))


def _stage_sql(s):
    return sql_predictions(_src("y_label", GROUP_FOLDED), list(STAGES[s][1]))


@query("g22_d7_stage_metrics", f"""SELECT *, round(r2 - lag(r2) OVER w, 6) + 0.0 AS "dR2_from_prev", round(rm - lag(rm) OVER w, 6) + 0.0 AS "dRMSE_from_prev",
  round(ma - lag(ma) OVER w, 6) + 0.0 AS "dMAE_from_prev", round(ro - lag(ro) OVER w, 6) + 0.0 AS "dr_oof_from_prev" FROM (""" + _union_all(
    f"""SELECT {s} AS stage, {len(STAGES[s][1])} AS n_features, count(*) AS n, (SELECT avg(x) FROM (SELECT corr(y, yhat) AS x FROM ({_stage_sql(s)}) GROUP BY fold)) AS rf,
    corr(y, yhat) AS ro, 1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((yhat - y) ** 2)) AS rm, avg(abs(yhat - y)) AS ma
    FROM ({_stage_sql(s)})""" for s in STAGES) + ") WINDOW w AS (ORDER BY stage)")
def stage_metrics(spark, sf):
    return rounded(st.stage_metrics(records(spark, sf), "id", "y_label", STAGES, K, SEED, "source"))


def _fix_stage_sql(sql: str) -> str:
    head = 'SELECT stage, n_features, round(rf, 6) + 0.0 AS r_foldmean, n, round(ro, 6) + 0.0 AS r_oof, round(r2, 6) + 0.0 AS "R2_oof", round(rm, 6) + 0.0 AS "RMSE", round(ma, 6) + 0.0 AS "MAE", '
    return head + sql[len("SELECT *, "):]


from . import ORACLES  # noqa: E402

ORACLES["g22_d7_stage_metrics"] = _fix_stage_sql(ORACLES["g22_d7_stage_metrics"])

N_BOOT = 500
N_PAIRED = 5000


def sql_draws(n_rep: int, n: str = "(SELECT count(*) FROM base)") -> str:
    return f"""dr AS (SELECT rep.range AS rep, i.range AS i, ('0x' || substr(md5('{SEED}:' || rep.range || ':' || i.range), 1, 8))::BIGINT % {n} AS pos
  FROM range(1, {n_rep + 1}) rep, range({n}) i)"""


@query("g16_g23_stage_paired_test", f"""WITH base AS (SELECT a.pos, (a.yhat - a.y) ** 2 AS s1, (b.yhat - b.y) ** 2 AS s2
    FROM ({_stage_sql(2)}) a JOIN ({_stage_sql(3)}) b USING (pos)), {sql_draws(N_PAIRED)},
  m AS (SELECT rep, avg(s1 - s2) AS m FROM dr JOIN base USING (pos) GROUP BY 1),
  rk AS (SELECT s1 - s2 AS d, rank() OVER (ORDER BY abs(s1 - s2)) + (count(*) OVER (PARTITION BY abs(s1 - s2)) - 1) / 2 AS rk FROM base WHERE s1 <> s2),
  wx AS (SELECT least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS w, count(*) AS nd FROM rk),
  wp AS (SELECT {sql_tails.signed_rank_p('w', 'nd', '0')} AS pw FROM wx),
  q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, (count(*) FILTER (m <= 0) + 1) / {N_PAIRED + 1} AS pl,
        (count(*) FILTER (m >= 0) + 1) / {N_PAIRED + 1} AS pr FROM m)
  SELECT count(*) AS "N", {r('sqrt(avg(s1))', '"RMSE_stage2"')}, {r('sqrt(avg(s2))', '"RMSE_stage3"')}, {r('avg(s1 - s2)', 'mean_diff')},
  {r('any_value(lo)', 'ci_lo')}, {r('any_value(hi)', 'ci_hi')}, {r('least(1.0, 2 * least(any_value(pl), any_value(pr)))', 'p_boot')},
  {r('sqrt(avg(s2)) - sqrt(avg(s1))', '"dRMSE_2to3"')},
  {r('any_value(pw)', 'p_wilcoxon')} FROM base, q, wp""")
def stage_paired(spark, sf):
    return rounded(st.stage_paired_test(records(spark, sf), "id", "y_label", STAGES, n_boot=N_PAIRED, k=K, seed=SEED, group="source"))


@query("g31_alpha_sensitivity", _union_all(
    f"SELECT 'alpha' AS analysis_type, '{a}' AS condition, outcome, r_foldmean AS r_obs, p_value FROM ({sql_test(sql_permuted(_src('y_label'), X, a), 'm', 'y_label', 5)})"
    for a in st.ALPHA_CONDITIONS))
def alpha_sensitivity(spark, sf):
    return rounded(st.alpha_sensitivity(records(spark, sf), "id", "y_label", X, n_perm=N_PERM, k=K, seed=SEED))


_SETS = {"four": X[:4], "five": X}


@query("g33_sets_by_aggregation", _union_all(
    f"""SELECT '{n}' AS feature_set, {len(f)}::INTEGER AS n_features, n, agg AS aggregation, CASE agg WHEN 'fold_mean' THEN r_foldmean ELSE r_oof END AS r_obs
    FROM ({sql_scores(sql_predictions(_src('y_label'), f), n, 'y_label', len(f))}), (VALUES ('fold_mean'), ('oof_concat')) v(agg)""" for n, f in _SETS.items()))
def sets_by_aggregation(spark, sf):
    return rounded(st.sets_by_aggregation(records(spark, sf), "id", "y_label", _SETS, K, SEED))


# --- full-data coefficients ---------------------------------------------------------
VX = [f"v{i:02d}" for i in range(1, 65)]  # the whole vector
VEC = "SELECT vec_id::VARCHAR AS id, " + ", ".join(f"embedding[{i}]::DOUBLE AS {v}" for i, v in enumerate(VX, 1)) + ", label::DOUBLE AS y FROM embeddings"


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        *[F.col("embedding")[i].cast("double").alias(v) for i, v in enumerate(VX)], F.col("label").cast("double").alias("y"))


def sql_full(src: str, xs: list[str], n_perm: int, alpha: float = 100.0) -> str:
    """feature index i, rep, standardised coefficient of the full-data fit."""
    p = len(xs)
    rhs = f"""SELECT tf, i.range AS i, {p + 1} + rep AS j, sum(z[i.range] * ys) AS v FROM z JOIN ystar USING (pos), range(1, {p + 1}) i GROUP BY tf, i.range, rep"""
    return f"""WITH RECURSIVE base AS ({src}), {sql_design("SELECT *, -1 AS fold, 0 AS tf, true AS is_tr FROM base", xs)},
{sql_ystar(n_perm)},
{sql_solve(p, str(alpha), rhs)}
SELECT i, j - {p + 1} AS rep, v AS coef FROM coef"""


def _coef_sql(src, xs, n_perm):
    names = "CASE i " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs, 1)) + " END"
    return f"""SELECT {names} AS feature, {r('max(coef) FILTER (rep = 0)', 'coef_obs')},
  {r(f'(count(*) FILTER (rep > 0 AND abs(coef) >= seen) + 1.0) / {n_perm + 1}', 'p_value')},
  (count(*) FILTER (rep > 0 AND abs(coef) >= seen) + 1.0) / {n_perm + 1} < 0.05 AS significant
  FROM (SELECT *, max(abs(coef)) FILTER (rep = 0) OVER (PARTITION BY i) AS seen FROM ({sql_full(src, xs, n_perm)})) GROUP BY i"""


_POSED = lambda src: f"SELECT *, {POS} AS pos FROM ({src})"


@query("g6_g13_coefficient_test_64", _coef_sql(_POSED(VEC), VX, N_PERM))
def coefficient_test(spark, sf):
    t = st.record_table(vectors(spark, sf), "id", VX, ["y"], K, SEED)
    return rounded(rs.coefficient_test(t, VX, "y", "id", n_perm=N_PERM, seed=SEED))


@query("g4_g5_g13_coefficient_test_missing", _coef_sql(
    f"SELECT id, pos, y_label AS y, {', '.join(X)} FROM ({FOLDED})", X, N_PERM))
def coefficient_test_missing(spark, sf):
    t = st.record_table(records(spark, sf), "id", X, ["y_label"], K, SEED)
    return rounded(rs.coefficient_test(t, X, "y_label", "id", n_perm=N_PERM, seed=SEED))


# --- bootstrap ------------------------------------------------------------------------
def sql_boot(src: str, xs: list[str], n_boot: int, alpha: float = 100.0) -> str:
    p = len(xs)
    rhs = f"SELECT tf, i.range AS i, {p + 1} AS j, sum(z[i.range] * y) AS v FROM z, range(1, {p + 1}) i GROUP BY tf, i.range"
    names = "CASE i " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(xs, 1)) + " END"
    return f"""WITH RECURSIVE base AS ({src}), {sql_draws(n_boot)},
{sql_design(f"SELECT id, base.pos, -1 AS fold, y, {', '.join(xs)}, rep AS tf, true AS is_tr FROM dr JOIN base ON base.pos = dr.pos", xs)},
{sql_solve(p, str(alpha), rhs)}
SELECT tf AS rep, {names} AS feature, v AS coef FROM coef"""


BOOT = sql_boot(f"SELECT id, pos, y_label AS y, {', '.join(X)} FROM ({FOLDED})", X, N_BOOT)


def _boot(spark, sf):
    t = st.record_table(records(spark, sf), "id", X, ["y_label"], K, SEED)
    return rs.bootstrap_coefficients(t, X, "y_label", n_boot=N_BOOT, seed=SEED)


@query("g14_bootstrap_variance", f"""SELECT feature, {r('avg(coef)', 'coef_mean')}, {r('stddev_samp(coef)', 'coef_sd')},
  {r('quantile_cont(coef, 0.025)', 'ci_lower')}, {r('quantile_cont(coef, 0.975)', 'ci_upper')},
  quantile_cont(coef, 0.025) > 0 OR quantile_cont(coef, 0.975) < 0 AS ci_excludes_zero, count(*) AS n_valid, count(*) < 100 AS few_resamples
  FROM ({BOOT}) GROUP BY 1""")
def bootstrap_variance(spark, sf):
    return rounded(rs.bootstrap_variance(_boot(spark, sf)))


STABILITY = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY abs(coef) DESC, feature) <= 2 AS top,
    avg(coef) OVER (PARTITION BY feature) AS m FROM ({{boot}}))
  SELECT feature, {r('avg(coef)', 'coef_mean')}, {r('stddev_pop(coef)', 'coef_std')}, {r('quantile_cont(coef, 0.05)', 'coef_q05')},
  {r('quantile_cont(coef, 0.95)', 'coef_q95')}, {r('avg(sign(coef))', 'sign_mean')},
  {r('avg((sign(coef) = sign(m))::INT)', 'sign_agree_rate')}, {r('avg(top::INT)', 'topk_rate')} FROM b GROUP BY 1"""


@query("d5_g15_bootstrap_stability", STABILITY.format(boot=BOOT))
def bootstrap_stability(spark, sf):
    return rounded(rs.bootstrap_stability(_boot(spark, sf), 2))


# --- chosen penalties -------------------------------------------------------------------
_WITH_ALPHA = "(SELECT z.*, alpha FROM z JOIN choice USING (tf)) z"


def _problems(y: str) -> str:
    """Training problems 0..K-1 (one fold held out) and K (all rows)."""
    return f"SELECT base.*, range AS tf, fold <> range AS is_tr FROM ({_src(y)}) base CROSS JOIN range({K + 1})"


def _chosen(y: str) -> str:
    """CTEs up to beta(tf, b) with the chosen penalty of each problem."""
    p = len(X)
    rhs = f"SELECT tf, i.range AS i, {p + 1} AS j, sum(z[i.range] * (y - ybar)) AS v FROM z, range(1, {p + 1}) i WHERE is_tr GROUP BY tf, i.range"
    solve = sql_solve(p, "max(alpha)", rhs, source=_WITH_ALPHA)
    return f"""WITH RECURSIVE {sql_design(_problems(y), X)}, {sql_penalty.choice(p, K)}, {solve},
beta AS (SELECT tf, list(v ORDER BY i) AS b FROM coef GROUP BY 1)"""


def _alpha_sql(y: str) -> str:
    return f"""{_chosen(y)},
pr AS (SELECT y, ybar + list_dot_product(z, b) AS yhat FROM z JOIN beta USING (tf) WHERE NOT is_tr)
SELECT '{y}' AS outcome, count(*) AS n, {r('1 - sum((yhat - y) ** 2) / (var_pop(y) * count(*))', 'r2_cv')}, {r('corr(y, yhat)', 'pearson_cv')},
  {r(f'(SELECT alpha FROM choice WHERE tf = {K})', 'alpha')} FROM pr"""


def _top_sql(y: str) -> str:
    names = "[" + ", ".join(f"'{x}'" for x in X) + "]"
    return f"""SELECT outcome, feature, {r('coef', 'coef')}, {r('alpha', 'alpha')}, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY abs(coef) DESC, feature) AS rank FROM ({_chosen(y)}
  SELECT '{y}' AS outcome, {names}[i] AS feature, v AS coef, alpha FROM coef JOIN choice USING (tf) WHERE tf = {K})) WHERE rank <= 3"""


def _boot_chosen() -> str:
    """rep, feature, coef, alpha: the inner folds follow the order of the draws."""
    p, names = len(X), "[" + ", ".join(f"'{x}'" for x in X) + "]"
    rhs = f"SELECT tf, i.range AS i, {p + 1} AS j, sum(z[i.range] * y) AS v FROM z, range(1, {p + 1}) i GROUP BY tf, i.range"
    return f"""WITH RECURSIVE base AS (SELECT id, pos, y_label AS y, {', '.join(X)} FROM ({FOLDED})), {sql_draws(N_BOOT)},
{sql_design(f"SELECT id, dr.i AS pos, -1 AS fold, y, {', '.join(X)}, rep AS tf, true AS is_tr FROM dr JOIN base ON base.pos = dr.pos", X)},
{sql_penalty.choice(p, K)}, {sql_solve(p, "max(alpha)", rhs, source=_WITH_ALPHA)}
SELECT tf AS rep, {names}[i] AS feature, v AS coef, alpha FROM coef JOIN choice USING (tf)"""


@query("g15_bootstrap_stability_chosen_alpha", STABILITY.format(boot=_boot_chosen()))
def bootstrap_stability_alpha(spark, sf):
    t = st.record_table(records(spark, sf), "id", X, ["y_label"], K, SEED)
    return rounded(rs.bootstrap_stability(rs.bootstrap_coefficients(t, X, "y_label", None, N_BOOT, SEED), 2))


@query("e26_alpha_distribution", f"""WITH a AS (SELECT DISTINCT rep, alpha FROM ({_boot_chosen()}))
  SELECT count(*) AS n, {r('avg(alpha)', 'mean')}, {r('stddev_samp(alpha)', 'sd')}, {r('min(alpha)', 'min')}, {r('quantile_cont(alpha, 0.25)', 'p25')},
  {r('quantile_cont(alpha, 0.5)', 'p50')}, {r('quantile_cont(alpha, 0.75)', 'p75')}, {r('max(alpha)', 'max')} FROM a""")
def alpha_distribution(spark, sf):
    t = st.record_table(records(spark, sf), "id", X, ["y_label"], K, SEED)
    return rounded(rs.alpha_distribution(rs.bootstrap_coefficients(t, X, "y_label", None, N_BOOT, SEED)))


@query("g10_alpha_selection", _union_all(_alpha_sql(y) for y in ("y_label", "y_size")))
def alpha_selection(spark, sf):
    return rounded(st.alpha_selection(records(spark, sf), "id", ["y_label", "y_size"], X, K, SEED)[0])


@query("d10_top_coefficients", _union_all(_top_sql(y) for y in ("y_label", "y_size")))
def top_coefficients(spark, sf):
    return rounded(st.alpha_selection(records(spark, sf), "id", ["y_label", "y_size"], X, K, SEED, top=3)[1])
