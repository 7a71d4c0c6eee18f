"""Selection, monologues, metadata joins, descriptives and rank tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import PROSE, WORDS
from ..operators import columns as cl
from ..operators import descriptives as de
from ..operators import features as ft
from ..operators import metadata as md
from ..operators import monologue as mo
from ..operators import ranks as rk
from ..operators import selection as se
from ..operators import turns
from ..operators.turns import KEYS
from ..runtime import materialize
from . import query, sql_tails
from .views import (
    UTT_TEXT, UTT_TIMED, q, r, rounded, sql_features, sql_nospace, sql_pairs, table, utt_text, utt_timed,
)


# --- conversation list -----------------------------------------------------------
def convlist(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    k = F.col("c_custkey")
    return table(spark, sf, "customer").join(n, "c_nationkey").select(
        F.concat(F.when(k % 3 == 0, "W").otherwise("K"), k).alias("会話ID"),
        F.col("c_mktsegment").alias("場所"),
        F.concat(F.lit(" "), F.col("c_nationkey") % 9, F.lit("人")).alias("話者数"),
        F.col("n_name").alias("会話概要"),
    )


CONVLIST = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'W' ELSE 'K' END || c_custkey AS cid, c_mktsegment AS place,
  c_nationkey % 9 AS n, n_name || ' ' || c_mktsegment AS blob FROM customer JOIN nation ON n_nationkey = c_nationkey"""


@query("b8_sampling_frame", f"SELECT DISTINCT cid AS conversation_id FROM ({CONVLIST}) WHERE contains(place, 'HOUSE') AND n = 2")
def sampling_frame(spark, sf):
    return se.sampling_frame(convlist(spark, sf), 2, "HOUSE")


_POS, _NEG = ("HOUSE", "BUILD", "_1", "_2"), ("MACH", "_13")
_SCORE = (
    " + ".join(f"contains(blob, {q(w)})::INT" for w in _POS) + " - 2 * ("
    + " + ".join(f"contains(blob, {q(w)})::INT" for w in _NEG)
    + ") + CASE WHEN cid LIKE 'W%' THEN 0 ELSE 2 END + CASE WHEN n = 1 THEN 4 WHEN n <= 3 THEN 1 WHEN n >= 6 THEN -2 ELSE 0 END"
)
_SCORED = f"""SELECT cid, ({_SCORE})::INTEGER AS diary_score,
  CASE WHEN cid LIKE 'W%' THEN 'specific_scene' ELSE 'personal_follow' END AS method, n::BIGINT AS speaker_n FROM ({CONVLIST})"""


def _scored(spark, sf):
    return se.candidate_scores(convlist(spark, sf), _POS, _NEG, ["会話概要", "場所"])


@query("b17_candidate_scores", _SCORED)
def candidate_scores(spark, sf):
    return _scored(spark, sf).select(F.col("会話ID").alias("cid"), "diary_score", "method", "speaker_n")


@query("b17_top_candidates", f"SELECT * FROM ({_SCORED}) ORDER BY diary_score DESC, method, cid LIMIT 200")
def top_candidates(spark, sf):
    return se.top_candidates(_scored(spark, sf)).select(F.col("会話ID").alias("cid"), "diary_score", "method", "speaker_n")


# --- candidates and quality filters ------------------------------------------------
def _conversations(spark, sf):
    """The frame: conversations of two speakers."""
    return utt_text(spark, sf).groupBy("conversation_id").agg(F.countDistinct("speaker_id").alias("n")).filter("n = 2").select("conversation_id")


CANDIDATES = f"""WITH {sql_pairs(f"SELECT * FROM ({UTT_TEXT}) WHERE conversation_id IN (SELECT conversation_id FROM ({UTT_TEXT}) GROUP BY 1 HAVING count(DISTINCT speaker_id) = 2)", PROSE)},
t AS (SELECT conversation_id, speaker_id, sum(length(replace(replace(text, ' ', ''), chr(12288), ''))) AS len FROM u GROUP BY 1, 2),
p AS (SELECT conversation_id, speaker_id, count(*) AS n, count(*) FILTER (prev_q) AS nq FROM pairs GROUP BY 1, 2)
SELECT conversation_id, speaker_id, len::BIGINT AS "FILL_text_len", coalesce(n, 0)::BIGINT AS n_pairs_total,
  coalesce(nq, 0)::BIGINT AS "IX_n_pairs_after_question" FROM t LEFT JOIN p USING (conversation_id, speaker_id)"""


def _candidates(spark, sf):
    return se.candidates(utt_text(spark, sf), _conversations(spark, sf), PROSE)


@query("c10_e1_e3_candidates", CANDIDATES)
def candidates(spark, sf):
    return _candidates(spark, sf)


QUALITY = se.Quality(2, 600, 1)
_KEEP = """n_pairs_total >= 2 AND "FILL_text_len" >= 600 AND "IX_n_pairs_after_question" >= 1"""


@query("b10_quality_filter", f"SELECT conversation_id, speaker_id FROM ({CANDIDATES}) WHERE {_KEEP}")
def quality_filter(spark, sf):
    return se.target_pairs(_candidates(spark, sf), QUALITY)


@query("b11_modelling_filter", f"""SELECT * FROM ({CANDIDATES}) WHERE n_pairs_total >= 1 AND "FILL_text_len" >= 300""")
def modelling_filter(spark, sf):
    return se.modelling_rows(_candidates(spark, sf), se.Quality(1, 300, 0))


@query("e25_selection_funnel", f"""WITH c AS ({CANDIDATES}), s AS (
  SELECT 1 AS stage, 'all conversations' AS name, 'conversation' AS unit, (SELECT count(DISTINCT conv_id) FROM conversations) AS n, '' AS reason
  UNION ALL SELECT 2, 'in frame', 'conversation', (SELECT count(DISTINCT conversation_id) FROM c), 'outside the frame'
  UNION ALL SELECT 3, 'records', 'record', (SELECT count(*) FROM c), 'expanded by speaker'
  UNION ALL SELECT 4, 'analysed', 'record', (SELECT count(*) FROM c WHERE {_KEEP}), 'below quality')
SELECT *, CASE stage WHEN 2 THEN lag(n) OVER (ORDER BY stage) - n WHEN 4 THEN lag(n) OVER (ORDER BY stage) - n ELSE 0 END AS excluded FROM s""")
def funnel(spark, sf):
    conv = utt_text(spark, sf).select("conversation_id").distinct()
    c = materialize(_candidates(spark, sf))  # two stages count it
    return se.funnel([
        ("all conversations", conv, "conversation", ""),
        ("in frame", _conversations(spark, sf), "conversation", "outside the frame"),
        ("records", c, "record", "expanded by speaker"),
        ("analysed", se.target_pairs(c, QUALITY), "record", "below quality"),
    ])


# --- monologues -------------------------------------------------------------------
PAIRS_SQL = f"SELECT conversation_id, speaker_id FROM ({UTT_TEXT}) GROUP BY 1, 2 HAVING count(*) >= 2"
MONOLOGUES = f"""SELECT conversation_id, speaker_id, count(*) AS n_utt,
  sum(length(replace(replace(text, ' ', ''), chr(12288), '')))::BIGINT AS n_chars,
  trim(string_agg(text, chr(10) ORDER BY utt_seq), ' ' || chr(10) || chr(9) || chr(13)) AS text
  FROM ({UTT_TEXT}) GROUP BY 1, 2"""


def monologues(spark, sf):
    return mo.build_monologues(utt_text(spark, sf))


@query("e2_monologues", MONOLOGUES)
def monologue_query(spark, sf):
    return monologues(spark, sf)


@query("c1_target_utterances", f"""SELECT conversation_id, speaker_id, utt_seq, text FROM ({UTT_TEXT})
  SEMI JOIN ({PAIRS_SQL}) p USING (conversation_id, speaker_id)""")
def target_utterances(spark, sf):
    utt = utt_text(spark, sf)
    pairs = utt.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return mo.monologue_lines(utt, pairs).select(*KEYS, "utt_seq", "text")


@query("a13_fixed_size_shards", f"""SELECT conversation_id, speaker_id, n_chars,
  (row_number() OVER (ORDER BY conversation_id, speaker_id) - 1) // 10 AS shard FROM ({MONOLOGUES})""")
def shards(spark, sf):
    return mo.shard(monologues(spark, sf), 10).select(*KEYS, "n_chars", "shard")


@query("a15_preview", f"""SELECT conversation_id, speaker_id, n_chars, n_utt, substr(replace(text, chr(10), ' '), 1, 200) AS head200
  FROM ({MONOLOGUES}) ORDER BY n_chars DESC, conversation_id, speaker_id LIMIT 200""")
def preview(spark, sf):
    return mo.preview(monologues(spark, sf), [F.desc("n_chars"), *[F.asc(k) for k in KEYS]], [*KEYS, "n_chars", "n_utt"])


# --- speaker metadata ---------------------------------------------------------------
def _mapping(spark, sf):
    k = F.col("o_custkey")
    label = F.concat(F.lit("IC"), F.lpad((k % 90).cast("string"), 2, "0"), F.lit("_名前"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("会話ID"), k.cast("string").alias("話者ID"),
        F.when(F.col("o_orderkey") % 11 == 0, "名前").otherwise(label).alias("話者ラベル"))


def _persons(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        F.when(k % 13 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("話者ID"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "女性").when(F.col("c_mktsegment") != "MACHINERY", "男性").alias("性別"),
        F.when(k % 4 > 0, F.concat(n + 20, F.lit("-"), n + 24, F.lit("歳"))).alias("年齢"),
        F.concat(F.lit("r"), n).alias("出身地"), F.concat(F.lit("q"), n).alias("居住地"),
        F.col("c_mktsegment").alias("職業"), F.col("c_name").alias("協力者からみた関係性"))


def _records(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("conversation_id"),
        F.concat(F.lit("IC"), F.lpad((F.col("o_custkey") % 90).cast("string"), 2, "0")).alias("speaker_id"))


def speaker_meta(spark, sf):
    return md.build_speaker_meta(_records(spark, sf), _mapping(spark, sf), _persons(spark, sf))


SPEAKER_META = """SELECT o_orderkey::VARCHAR AS conversation_id, 'IC' || lpad((o_custkey % 90)::VARCHAR, 2, '0') AS speaker_id,
  CASE WHEN o_orderkey % 11 > 0 THEN o_custkey::VARCHAR END AS person_id,
  CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'F' WHEN c_mktsegment <> 'MACHINERY' THEN 'M' END AS gender,
  CASE WHEN c_custkey % 4 > 0 THEN (c_nationkey + 20) || '-' || (c_nationkey + 24) || '歳' END AS age_band,
  CASE WHEN c_custkey % 4 > 0 THEN (c_nationkey + 22)::DOUBLE END AS age_mid,
  'r' || c_nationkey AS birthplace, 'q' || c_nationkey AS residence, c_mktsegment AS occupation, c_name AS relationship,
  CASE WHEN c_custkey % 4 > 0 THEN (c_nationkey + 22)::DOUBLE END AS age
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 11 > 0 AND c_custkey % 13 > 0"""


@query("c3_c4_speaker_meta", SPEAKER_META)
def meta(spark, sf):
    return speaker_meta(spark, sf)


@query("c3_c4_match_audit", f"""SELECT count(*) AS n_rows, count(*) FILTER (person_id IS NULL) AS unmatched_mapping,
  count(*) FILTER (gender IS NULL) AS unmatched_person FROM ({SPEAKER_META})""")
def match_audit(spark, sf):
    return md.match_audit(speaker_meta(spark, sf))


@query("e30_demographics_summary", f"""SELECT count(*) FILTER (gender = 'F') AS "n_F", count(*) FILTER (gender = 'M') AS "n_M",
  min(age_mid) AS age_min, max(age_mid) AS age_max, {r('avg(age_mid)', 'age_mean')},
  count(*) FILTER (birthplace IS NULL) AS birthplace_missing FROM ({SPEAKER_META})""")
def demographics(spark, sf):
    return rounded(md.demographics_summary(speaker_meta(spark, sf)))


_FIRST = "arg_min(gender, conversation_id) FILTER (gender IS NOT NULL)"


@query("e23_person_overlap_detail", f"""SELECT person_id, count(*) AS n_records,
  string_agg(DISTINCT conversation_id, ',' ORDER BY conversation_id) AS conversation_ids, {_FIRST} AS gender
  FROM ({SPEAKER_META}) WHERE person_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def overlap_detail(spark, sf):
    return md.overlap_detail(speaker_meta(spark, sf))


@query("e23_person_overlap_summary", f"""SELECT (SELECT count(*) FROM ({SPEAKER_META})) AS total_records, count(*) AS unique_speakers,
  count(*) FILTER (n >= 2) AS duplicate_speakers, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS duplicate_records,
  count(*) FILTER (g = 'F') AS "gender_F", count(*) FILTER (g = 'M') AS "gender_M"
  FROM (SELECT person_id, count(*) AS n, {_FIRST} AS g FROM ({SPEAKER_META}) WHERE person_id IS NOT NULL GROUP BY 1)""")
def overlap_summary(spark, sf):
    return md.overlap_summary(speaker_meta(spark, sf))


_XY = "SELECT o_orderkey::VARCHAR AS conversation_id, 'IC' || lpad((o_custkey % 90)::VARCHAR, 2, '0') AS speaker_id, o_totalprice AS y FROM orders"


def _order_xy(spark, sf):
    d = table(spark, sf, "orders")
    return d.select(F.col("o_orderkey").cast("string").alias("conversation_id"),
                    F.concat(F.lit("IC"), F.lpad((F.col("o_custkey") % 90).cast("string"), 2, "0")).alias("speaker_id"),
                    F.col("o_totalprice").alias("y"))


@query("b13_b18_c8_confounds", f"""SELECT x.conversation_id, x.speaker_id, y, person_id, gender, age,
  CASE gender WHEN 'F' THEN 1.0::DOUBLE WHEN 'M' THEN 0.0::DOUBLE END AS confound_gender, age AS confound_age
  FROM ({_XY}) x JOIN (SELECT DISTINCT conversation_id, speaker_id, person_id, gender, age FROM ({SPEAKER_META})) m
  USING (conversation_id, speaker_id)""")
def confounds(spark, sf):
    return md.confounds(_order_xy(spark, sf), speaker_meta(spark, sf))[0]


@query("c9_c16_left_join_meta", f"""SELECT x.conversation_id, x.speaker_id, y, gender, age FROM ({_XY}) x
  LEFT JOIN ({SPEAKER_META}) m USING (conversation_id, speaker_id)""")
def left_meta(spark, sf):
    return md.join_features(_order_xy(spark, sf), speaker_meta(spark, sf), ["gender", "age"])


# --- joins ------------------------------------------------------------------------
@query("c5_c7_join_loss", """SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM labels) AS n_right,
  count(*) AS n_joined, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS unmatched_left,
  (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS unmatched_right FROM documents JOIN labels USING (doc_id)""")
def join_loss(spark, sf):
    return md.join_loss(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("c15_key_set_comparison", """SELECT count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND b IS NULL) AS left_only,
  count(*) FILTER (b AND a IS NULL) AS right_only FROM (SELECT DISTINCT doc_id, true AS a FROM documents WHERE n_chars > 500)
  FULL JOIN (SELECT DISTINCT doc_id, true AS b FROM labels WHERE quality = 1) USING (doc_id)""")
def key_sets(spark, sf):
    from ..plans.audit import compare_keys
    a = table(spark, sf, "documents").filter("n_chars > 500").select("doc_id")
    return compare_keys(a, table(spark, sf, "labels").filter("quality = 1").select("doc_id"), ["doc_id"])


# --- descriptives -------------------------------------------------------------------
FEATURES = sql_features(UTT_TIMED, WORDS)
LONG = f"""SELECT conversation_id, speaker_id, feature, value FROM (UNPIVOT (SELECT * FROM ({FEATURES}))
  ON {', '.join(f'"{c}"' for c in ft.PREDICTORS)} INTO NAME feature VALUE value)"""


def feature_table(spark, sf):
    return rounded(ft.extract_features(utt_timed(spark, sf), lex=WORDS))


def _describe_sql(src):
    return f"""SELECT feature, count(value) AS n, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')},
  {r('min(value)', 'min')}, {r('quantile_cont(value, 0.25)', 'p25')}, {r('quantile_cont(value, 0.5)', 'p50')},
  {r('quantile_cont(value, 0.75)', 'p75')}, {r('quantile_cont(value, 0.9)', 'p90')}, {r('max(value)', 'max')}
  FROM ({src}) GROUP BY 1"""


@query("e19_descriptives", _describe_sql(LONG))
def describe(spark, sf):
    return rounded(de.describe(feature_table(spark, sf), ft.PREDICTORS))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e19_descriptives_histogram", _describe_sql(
    f"SELECT feature, value FROM (UNPIVOT (SELECT * FROM lineitem) ON {', '.join(_LINE)} INTO NAME feature VALUE value)"))
def describe_histogram(spark, sf):
    """The path for tables beyond one task: exact quantiles from histograms."""
    return rounded(de.describe(table(spark, sf, "lineitem"), _LINE, exact_in_task=1000))


@query("e20_correlation_matrix", f"""WITH l AS ({LONG}) SELECT a.feature AS feature_a, b.feature AS feature_b, count(*) AS n,
  {r('corr(a.value, b.value)', 'r')} FROM l a JOIN l b USING (conversation_id, speaker_id)
  WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2""")
def correlation_matrix(spark, sf):
    return rounded(de.correlation_matrix(feature_table(spark, sf), de.category_order(ft.PREDICTORS)))


@query("g20_regression_line", f"""SELECT l_returnflag, count(*) AS n, {r('regr_slope(l_extendedprice, l_quantity)', 'slope')},
  {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept')} FROM lineitem GROUP BY 1""")
def regression_line(spark, sf):
    return rounded(de.regression_line(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("d9_average_ranks", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_quantity,
  rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def average_ranks(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity")
    return rk.average_ranks(d, ["l_returnflag"], "l_quantity")


_RANKED = """r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value)
  + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk, count(*) OVER (PARTITION BY feature, value) AS c FROM l)"""


def _gendered(spark, sf):
    d = feature_table(spark, sf).withColumn("g", F.when(F.col("speaker_id").cast("long") % 3 == 0, "M").otherwise("F"))
    d = d.withColumn("age", (F.col("speaker_id").cast("long") * 7 % 60 + 20).cast("double"))
    return de.long_features(d, ft.PREDICTORS, ["g", "age"]).filter("value IS NOT NULL")


_GL = f"""l AS (SELECT *, CASE WHEN speaker_id::BIGINT % 3 = 0 THEN 'M' ELSE 'F' END AS g,
  (speaker_id::BIGINT * 7 % 60 + 20)::DOUBLE AS age FROM ({LONG}) WHERE value IS NOT NULL)"""


_FEWER = "feature NOT LIKE 'RESP%'"


def _mann_whitney_sql(rows: str = "true") -> str:
    groups = f"""WITH {_GL.replace("WHERE value IS NOT NULL", f"WHERE value IS NOT NULL AND ({rows})")}, {_RANKED}
  SELECT feature, count(*) FILTER (g = 'M') AS n1, count(*) FILTER (g = 'F') AS n2,
  CASE WHEN count(*) FILTER (g = 'M') > 0 AND count(*) FILTER (g = 'F') > 0
    THEN sum(rk) FILTER (g = 'M') - count(*) FILTER (g = 'M') * (count(*) FILTER (g = 'M') + 1) / 2 END AS u,
  sum(c::DOUBLE * c - 1) AS ties FROM r GROUP BY 1"""
    return f"SELECT feature, n1, n2, {r('u', 'u')}, {r('ties', 'ties')}, {r('p_value', 'p_value')} FROM ({sql_tails.mann_whitney(groups)})"


@query("g18_mann_whitney", _mann_whitney_sql())
def mann_whitney(spark, sf):
    return rounded(rk.mann_whitney(_gendered(spark, sf), ["feature"], "value", "g", "M", "F"))


@query("g18_mann_whitney_p", _mann_whitney_sql(f"speaker_id::BIGINT % 3 <> 0 OR {_FEWER}"))
def mann_whitney_p(spark, sf):
    """One family of features has no row of the first group: its rows stay, without U and p."""
    d = _gendered(spark, sf).filter(f"g = 'F' OR {_FEWER}")
    return rounded(rk.mann_whitney(d, ["feature"], "value", "g", "M", "F"))


def _correlations_sql(rows: str = "true") -> str:
    return f"""WITH {_GL}, r AS (SELECT feature, age, value,
  rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rv,
  rank() OVER (PARTITION BY feature ORDER BY age) + (count(*) OVER (PARTITION BY feature, age) - 1) / 2 AS ra FROM l WHERE {rows}),
  c AS (SELECT feature, count(*) AS n, CASE WHEN count(*) >= 3 AND NOT isnan(corr(age, value)) THEN corr(age, value) END AS r,
    CASE WHEN count(*) >= 3 AND NOT isnan(corr(ra, rv)) THEN corr(ra, rv) END AS rho FROM r GROUP BY 1)
  SELECT feature, n, {r('r', 'r')}, {r(sql_tails.correlation_p('r', 'n'), 'r_p')}, {r('rho', 'rho')}, {r(sql_tails.correlation_p('rho', 'n'), 'rho_p')} FROM c"""


@query("g19_correlations", _correlations_sql())
def correlations(spark, sf):
    return rounded(rk.correlations(_gendered(spark, sf), ["feature"], "age", "value"))


@query("g19_correlations_p", _correlations_sql(f"age < 21 OR {_FEWER}"))
def correlations_p(spark, sf):
    """One family of features has too few rows, or one age only: its rows stay, without r and p."""
    return rounded(rk.correlations(_gendered(spark, sf).filter(f"age < 21 OR {_FEWER}"), ["feature"], "age", "value"))


@query("g17_wilcoxon", f"""WITH d AS (SELECT l_returnflag, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity - 25 END AS d FROM lineitem),
  n AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag, abs(d)) AS c,
    rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0),
  t AS (SELECT l_returnflag, sum(rk) FILTER (d > 0) AS w_plus, sum(rk) FILTER (d < 0) AS w_minus, count(*) AS n, sum(c::DOUBLE * c - 1) AS ties FROM n GROUP BY 1),
  z AS (SELECT l_returnflag, count(*) FILTER (d = 0) AS zeros FROM d GROUP BY 1)
  SELECT l_returnflag, {r('coalesce(w_plus, 0)', 'w_plus')}, {r('coalesce(w_minus, 0)', 'w_minus')}, coalesce(n, 0) AS n, zeros,
  {r(sql_tails.signed_rank_p('least(w_plus, w_minus)', 'n', 'ties'), 'p_value')} FROM z LEFT JOIN t USING (l_returnflag)""")
def wilcoxon(spark, sf):
    """One return flag has no difference but zeros: its row stays, without p."""
    d = table(spark, sf, "lineitem").select("l_returnflag", F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_quantity") - 25).alias("d"))
    return rounded(rk.wilcoxon(d, ["l_returnflag"], "d").select("l_returnflag", "w_plus", "w_minus", "n", "zeros", "p_value"))


@query("d6_holm", """WITH p AS (SELECT p_type, p_brand, CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE least(1, avg(p_size) / 400) END AS p FROM part GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p NULLS LAST) AS rn, count(p) OVER (PARTITION BY p_type) AS m FROM p)
  SELECT p_type, p_brand, round(p, 6) + 0.0 AS p, CASE WHEN p IS NOT NULL THEN round(least(1.0,
    max(p * (m - rn + 1)) OVER (PARTITION BY p_type ORDER BY rn)), 6) + 0.0 END AS p_corrected FROM k""")
def holm(spark, sf):
    p = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(
        F.when(F.max("p_brand") != "Brand#3", F.least(F.lit(1.0), F.avg("p_size") / 400)).alias("p"))
    return rounded(rk.holm(p, "p", ["p_type"]))
