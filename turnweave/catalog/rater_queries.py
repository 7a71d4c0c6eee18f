"""Rater answers, trait scores, reliability and agreement."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raters as ra
from ..operators.turns import KEYS
from ..plans import audit as au
from . import query
from .text_queries import RAW, V2, _SCORE, _case
from .views import q, r, rounded, table

RATERS = ["0", "1", "2", "3"]


# --- item and rater scores on lineitem ------------------------------------------
N_ITEMS = 7


def item_scores(spark, sf):
    d = table(spark, sf, "lineitem")
    s = (F.col("l_quantity").cast("int") % 5).cast("double")
    return d.select(
        F.col("l_orderkey").cast("string").alias("conversation_id"), F.lit("S").alias("speaker_id"),
        F.element_at(F.array(*[F.lit(t) for t in ra.TRAITS]), (F.col("l_orderkey") % 5 + 1).cast("int")).alias("trait"),
        F.col("l_linenumber").alias("item_id"), F.concat(F.lit("m"), F.col("l_suppkey") % 4).alias("model_id"),
        F.when(F.col("l_linenumber") % 2 == 1, 4 - s).otherwise(s).alias("score"),
    )


ITEMS = """SELECT l_orderkey::VARCHAR AS conversation_id, 'S' AS speaker_id,
  CASE l_orderkey % 5 WHEN 0 THEN 'O' WHEN 1 THEN 'C' WHEN 2 THEN 'E' WHEN 3 THEN 'A' ELSE 'N' END AS trait,
  l_linenumber AS item_id, 'm' || l_suppkey % 4 AS model_id,
  CASE WHEN l_linenumber % 2 = 1 THEN 4 - (l_quantity::INT % 5)::DOUBLE ELSE (l_quantity::INT % 5)::DOUBLE END AS score
  FROM lineitem"""


def rater_scores(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.groupBy(
        F.col("l_partkey").cast("string").alias("conversation_id"), F.lit("S").alias("speaker_id"),
        F.col("l_returnflag").alias("trait"), (F.col("l_suppkey") % 4).cast("string").alias("teacher"),
    ).agg(F.avg("l_quantity").alias("trait_score"))


SCORES = """SELECT l_partkey::VARCHAR AS conversation_id, 'S' AS speaker_id, l_returnflag AS trait,
  (l_suppkey % 4)::VARCHAR AS teacher, avg(l_quantity) AS trait_score FROM lineitem GROUP BY 1, 2, 3, 4"""
WIDE = f"""SELECT conversation_id, speaker_id, trait, {', '.join(f"max(trait_score) FILTER (teacher = '{t}') AS score_{t}" for t in RATERS)}
  FROM ({SCORES}) GROUP BY 1, 2, 3 HAVING count(DISTINCT teacher) = 4"""


@query("e15_trait_scores", f"SELECT conversation_id, speaker_id, trait, model_id, {r('avg(score)', 'trait_score')} FROM ({ITEMS}) GROUP BY 1, 2, 3, 4")
def trait_scores(spark, sf):
    return rounded(ra.trait_scores(item_scores(spark, sf), ("trait", "model_id")))


@query("b16_items_per_trait", f"SELECT trait, count(*) AS n_items, count(*) = 24 AS as_expected FROM ({ITEMS}) GROUP BY 1")
def items_per_trait(spark, sf):
    d = item_scores(spark, sf).withColumn("trait", F.concat(F.lit(" "), "trait", F.lit(" ")))
    return ra.items_per_trait(d)


@query("b16_items_of_trait", f"SELECT conversation_id, item_id, model_id, score FROM ({ITEMS}) WHERE trait = 'C'")
def items_of_trait(spark, sf):
    d = item_scores(spark, sf).withColumn("trait", F.concat(F.lit(" "), "trait", F.lit(" ")))
    return ra.items_of_trait(d, "C").select("conversation_id", "item_id", "model_id", "score")


@query("e16_item_matrix", f"""SELECT conversation_id, speaker_id, {', '.join(r(f'avg(score) FILTER (item_id = {i})', f'"{i}"') for i in range(1, N_ITEMS + 1))}
  FROM ({ITEMS}) GROUP BY 1, 2 HAVING count(DISTINCT item_id) = {N_ITEMS}""")
def item_matrix(spark, sf):
    return rounded(ra.item_matrix(item_scores(spark, sf), range(1, N_ITEMS + 1)))


@query("e17_cronbach_alpha", f"""WITH c AS (SELECT trait, conversation_id, item_id, avg(score) AS s FROM ({ITEMS}) GROUP BY 1, 2, 3),
  w AS (SELECT *, sum(s) OVER k AS total, count(*) OVER k AS answered FROM c WINDOW k AS (PARTITION BY trait, conversation_id)),
  k AS (SELECT trait, count(DISTINCT item_id) AS k FROM c GROUP BY 1),
  f AS (SELECT w.* FROM w JOIN k USING (trait) WHERE answered = k),
  v AS (SELECT trait, sum(v) AS iv FROM (SELECT trait, item_id, var_samp(s) AS v FROM f GROUP BY 1, 2) GROUP BY 1),
  t AS (SELECT trait, var_samp(total) AS tv, count(*) AS n FROM (SELECT DISTINCT trait, conversation_id, total FROM f) GROUP BY 1),
  n AS (SELECT trait, count(DISTINCT conversation_id) AS ns FROM c GROUP BY 1)
  SELECT trait, {r('CASE WHEN coalesce(t.n, 0) >= 2 AND tv > 0 THEN k / (k - 1) * (1 - iv / tv) END', 'alpha')}, ns AS n_subjects, k AS k_items,
    coalesce(t.n, 0) AS n_complete FROM n JOIN k USING (trait) LEFT JOIN t USING (trait) LEFT JOIN v USING (trait)""")
def cronbach(spark, sf):
    return rounded(ra.cronbach_alpha(item_scores(spark, sf)))


@query("c6_e18_ensemble", f"SELECT conversation_id, speaker_id, trait, {', '.join(r(f'score_{t}', f'score_{t}') for t in RATERS)}, {r('(score_0 + score_1 + score_2 + score_3) / 4', 'trait_score')} FROM ({WIDE})")
def ensemble(spark, sf):
    return rounded(ra.ensemble(rater_scores(spark, sf), RATERS))


_PAIRS = [(a, b) for i, a in enumerate(RATERS) for b in RATERS[i + 1:]]
AGREE = " UNION ALL ".join(
    f"SELECT trait, count(*) AS n, '{a}' AS rater_a, '{b}' AS rater_b, corr(score_{a}, score_{b}) AS r FROM ({WIDE}) GROUP BY 1"
    for a, b in _PAIRS)


@query("e21_rater_agreement", f"SELECT trait, n, rater_a, rater_b, {r('r', 'r')} FROM ({AGREE})")
def agreement(spark, sf):
    return rounded(ra.rater_agreement(rater_scores(spark, sf), RATERS))


@query("e21_agreement_summary", f"SELECT trait, max(n) AS n, {r('avg(r)', 'mean_r')} FROM ({AGREE}) GROUP BY 1")
def agreement_summary(spark, sf):
    return rounded(ra.agreement_summary(ra.rater_agreement(rater_scores(spark, sf), RATERS)))


@query("e21_agreement_per_rater", f"""SELECT trait, rater, {r('avg(r)', 'mean_r')} FROM (SELECT trait, rater_a AS rater, r FROM ({AGREE})
  UNION ALL SELECT trait, rater_b, r FROM ({AGREE})) GROUP BY 1, 2""")
def agreement_per_rater(spark, sf):
    return rounded(ra.agreement_per_rater(ra.rater_agreement(rater_scores(spark, sf), RATERS)))


_LI = "SELECT l_orderkey::VARCHAR AS conversation_id, l_linenumber::VARCHAR AS speaker_id, 'C' AS trait FROM lineitem"


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("conversation_id"),
        F.col("l_linenumber").cast("string").alias("speaker_id"), F.lit("C").alias("trait"))


@query("e22_duplicate_keys", f"SELECT *, count(*) AS n FROM ({_LI}) GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, sf):
    return ra.duplicate_keys(_li(spark, sf))


@query("e22_merge_check", f"""SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_records, sum(CASE WHEN n > 1 THEN n ELSE 0 END)::BIGINT AS n_duplicated,
  false AS ok FROM (SELECT conversation_id, speaker_id, count(*) AS n FROM ({_LI}) GROUP BY 1, 2)""")
def merge_check(spark, sf):
    return ra.merge_check(_li(spark, sf))


@query("e24_mean_over_raters", f"""SELECT trait, {r('avg(r)', 'r')}, {r('avg(n)', 'n')} FROM ({AGREE}) GROUP BY 1""")
def mean_over_raters(spark, sf):
    pairs = ra.rater_agreement(rater_scores(spark, sf), RATERS)
    return rounded(ra.mean_over_raters(pairs.withColumn("n", F.col("n").cast("double")), ["trait"], ["r", "n"]))


_TS = f"SELECT conversation_id, speaker_id, trait, model_id, avg(score) AS trait_score FROM ({ITEMS}) GROUP BY 1, 2, 3, 4"


@query("e27_model_trait_means", f"""SELECT model_id, {', '.join(r(f"avg(trait_score) FILTER (trait = '{t}')", f'"{t}"') for t in ra.TRAITS)}
  FROM ({_TS}) GROUP BY 1""")
def model_means(spark, sf):
    return rounded(ra.model_trait_means(ra.trait_scores(item_scores(spark, sf), ("trait", "model_id"))))


@query("e27_rater_spread", f"""SELECT trait, {r('avg(m)', 'mean_score')}, {r('avg(sd)', 'mean_sd')} FROM
  (SELECT conversation_id, trait, avg(trait_score) AS m, stddev_samp(trait_score) AS sd FROM ({_TS}) GROUP BY 1, 2) GROUP BY 1""")
def spread(spark, sf):
    return rounded(ra.rater_spread(ra.trait_scores(item_scores(spark, sf), ("trait", "model_id"))))


@query("e28_bands", """SELECT p_partkey, CASE WHEN p_size < 3 THEN 'NA' WHEN p_size / 50 >= 0.7 THEN 'high' WHEN p_size / 50 >= 0.5 THEN 'middle' ELSE 'low' END AS alpha_band,
  CASE WHEN p_size < 3 THEN 'NA' WHEN p_size / 10 < 3.0 THEN 'low' WHEN p_size / 10 > 3.4 THEN 'high' ELSE 'middle' END AS score_band FROM part""")
def bands(spark, sf):
    s = F.when(F.col("p_size") >= 3, F.col("p_size").cast("double"))
    return table(spark, sf, "part").select(
        "p_partkey", ra.alpha_band(s / 50).alias("alpha_band"), ra.score_band(s / 10).alias("score_band"))


# --- attempts ----------------------------------------------------------------------
def _attempts(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), ((F.col("l_orderkey") + F.col("l_partkey")) % 12 + 1).cast("int"))
    raw = F.when(F.col("l_partkey") % 3 == 0, "n/a").otherwise(raw)
    d = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("conversation_id"), F.lit("S").alias("speaker_id"),
        F.col("l_linenumber").alias("item_id"), F.col("l_partkey").alias("attempt_i"), raw.alias("choice_raw"))
    return d.dropDuplicates(["conversation_id", "item_id", "attempt_i"])


def _grid(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("conversation_id"), F.lit("S").alias("speaker_id"),
        F.col("l_linenumber").alias("item_id"), F.lit("C").alias("trait"), (F.col("l_linenumber") % 2).alias("reverse")).distinct()


def _resolve_sql(neutral: bool) -> str:
    idx = "(l_orderkey + l_partkey) % 12"
    score = f"CASE norm {' '.join(f'WHEN {q(c)} THEN {s}::DOUBLE' for c, s in _SCORE.items())} END"
    fb = ("'NEUTRAL_FALLBACK'", q(ra.CHOICES[2])) if neutral else ("''", "''")
    return f"""WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'n/a' ELSE {_case(RAW, idx)} END AS raw,
    CASE WHEN l_partkey % 3 = 0 THEN 'n/a' ELSE {_case(V2, idx)} END AS norm FROM lineitem),
  v AS (SELECT l_orderkey, l_linenumber, arg_min(raw, l_partkey) AS raw, arg_min(norm, l_partkey) AS norm FROM a
    WHERE norm IN ({', '.join(q(c) for c in ra.CHOICES)}) GROUP BY 1, 2),
  g AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
  j AS (SELECT g.l_orderkey, g.l_linenumber, coalesce(raw, {fb[0]}) AS raw, coalesce(norm, {fb[1]}) AS norm FROM g LEFT JOIN v USING (l_orderkey, l_linenumber))
  SELECT l_orderkey::VARCHAR AS conversation_id, 'S' AS speaker_id, l_linenumber AS item_id, 'C' AS trait, l_linenumber % 2 AS reverse,
    raw AS choice_raw, norm AS choice_norm, CASE WHEN l_linenumber % 2 = 1 THEN 4 - {score} ELSE {score} END AS score FROM j"""


@query("f15_resolve_attempts_neutral", _resolve_sql(True))
def resolve_neutral(spark, sf):
    return ra.resolve_attempts(_attempts(spark, sf), _grid(spark, sf))


@query("f15_resolve_attempts_missing", _resolve_sql(False))
def resolve_missing(spark, sf):
    return ra.resolve_attempts(_attempts(spark, sf), _grid(spark, sf), "nan")


# --- audits ------------------------------------------------------------------------
@query("h15_expected_values", f"""WITH a AS (SELECT p_brand, avg(p_size) AS v FROM (SELECT CASE WHEN p_brand = 'Brand#5' THEN 'renamed' ELSE p_brand END AS p_brand, p_size FROM part) GROUP BY 1),
  e AS (SELECT p_brand, round(avg(p_size) + CASE WHEN p_brand = 'Brand#2' THEN 1 ELSE 0 END, 3) AS v FROM part GROUP BY 1)
  SELECT p_brand, {r('e.v', 'expected', 3)}, {r('a.v', 'actual', 3)}, coalesce(round(e.v, 3) = round(a.v, 3), false) AS match,
  {r('abs(e.v - a.v)', 'diff')}, CASE WHEN a.v IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status FROM e LEFT JOIN a USING (p_brand)""")
def expected_values(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_size").alias("m"))
    e = g.select("p_brand", F.round(F.col("m") + F.when(F.col("p_brand") == "Brand#2", 1.0).otherwise(0.0), 3).alias("value"),
                 F.lit(3).alias("digits"))
    a = g.select(F.when(F.col("p_brand") == "Brand#5", "renamed").otherwise(F.col("p_brand")).alias("p_brand"), F.col("m").alias("value"))
    return rounded(au.expected_values(e, a, ["p_brand"]))


@query("h16_feature_set_check", """WITH c AS (SELECT DISTINCT p_type AS trait, p_brand AS feature FROM part),
  w AS (SELECT DISTINCT p_brand AS feature FROM part WHERE p_brand <> 'Brand#7'), t AS (SELECT DISTINCT trait FROM c)
  SELECT trait, 't' AS teacher, 'both' AS found,
   coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM w WHERE feature NOT IN (SELECT feature FROM c WHERE c.trait = t.trait)), '') AS missing,
   coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM c WHERE c.trait = t.trait AND feature NOT IN (SELECT feature FROM w)), '') AS unexpected,
   false AS consistent, 'feature sets differ' AS diagnosis FROM t""")
def feature_sets(spark, sf):
    p = table(spark, sf, "part")
    coefs = p.select(F.col("p_type").alias("trait"), F.lit("t").alias("teacher"), F.col("p_brand").alias("feature")).distinct()
    stages = p.select(F.col("p_type").alias("trait"), F.lit("t").alias("teacher"), F.lit(3).alias("stage"), F.lit(21).alias("n_features")).distinct()
    canon = [f"Brand#{i}" for i in range(1, 26) if i != 7]
    return au.feature_set_check(stages, coefs, canon)
