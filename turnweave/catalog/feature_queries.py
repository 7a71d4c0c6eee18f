"""Turn pairs, gaps, pauses and the feature table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import PROSE, WORDS
from ..operators import features, turns
from . import query
from .views import (
    UTT_TEXT, UTT_TIMED, q, r, rounded, sql_features, sql_pairs, utt_text, utt_timed,
)


@query("e13_features_timed", sql_features(UTT_TIMED, WORDS))
def features_timed(spark, sf):
    return rounded(features.extract_features(utt_timed(spark, sf), lex=WORDS))


@query("e13_features_text", sql_features(UTT_TEXT, PROSE))
def features_text(spark, sf):
    return rounded(features.extract_features(utt_text(spark, sf), lex=PROSE))


TARGETS_SQL = "SELECT conversation_id, speaker_id FROM ({}) GROUP BY 1, 2 HAVING count(*) >= 67"


def _targets(utt):
    return utt.groupBy(*turns.KEYS).count().filter("count >= 67").drop("count")


@query("c2_features_for_target_pairs", sql_features(
    UTT_TIMED, WORDS,
    only=f"SEMI JOIN ({TARGETS_SQL.format(UTT_TIMED)}) t USING (conversation_id, speaker_id)"))
def features_for_targets(spark, sf):
    utt = utt_timed(spark, sf)
    return rounded(features.extract_features(utt, _targets(utt), lex=WORDS))


@query("e13_features_split_conversations", sql_features(UTT_TIMED, WORDS))
def features_split(spark, sf):
    """The hot-key path: conversations above 120 turns are cut into chunks."""
    return rounded(features.extract_features(utt_timed(spark, sf), lex=WORDS, rows_per_task=130))


@query("d1_turn_pairs", f"""WITH {sql_pairs(UTT_TEXT, PROSE)}
SELECT conversation_id, prev_speaker AS prev_speaker_id, speaker_id AS resp_speaker_id, utt_seq,
  prev_text, text AS resp_text, prev_sfp AS prev_sfp_group, prev_q AS prev_is_question FROM pairs""")
def turn_pairs(spark, sf):
    return turns.turn_pairs(utt_text(spark, sf), PROSE).drop("prev_end", "resp_start", "gap")


@query("d2_own_pauses", f"""WITH {sql_pairs(UTT_TIMED, WORDS)}
SELECT conversation_id, speaker_id, utt_seq, {r('start_time - own_prev_end', 'pause')}
FROM seq WHERE start_time - own_prev_end >= 0.05""")
def own_pauses(spark, sf):
    return rounded(turns.own_pauses(utt_timed(spark, sf)))


@query("d3_response_gaps", f"""WITH {sql_pairs(UTT_TIMED, WORDS)}
SELECT conversation_id, speaker_id AS resp_speaker_id, utt_seq, {r('gap', 'gap')},
  gap >= 0.05 AS kept FROM pairs""")
def response_gaps(spark, sf):
    p = turns.turn_pairs(utt_timed(spark, sf), WORDS)
    return rounded(p.select("conversation_id", "resp_speaker_id", "utt_seq", "gap",
                            (F.col("gap") >= 0.05).alias("kept")))


@query("d4_overlap_rate", f"""WITH {sql_pairs(UTT_TIMED, WORDS)}
SELECT conversation_id, speaker_id, count(*) AS n_pairs, count(*) FILTER (gap < -0.05) AS n_overlaps,
  {r('avg(CASE WHEN gap < -0.05 THEN 1 ELSE 0 END)', 'overlap_rate')} FROM pairs GROUP BY 1, 2""")
def overlap_rate(spark, sf):
    p = turns.turn_pairs(utt_timed(spark, sf), WORDS)
    late = F.col("gap") < -0.05
    return rounded(
        p.groupBy("conversation_id", F.col("resp_speaker_id").alias("speaker_id")).agg(
            F.count(F.lit(1)).alias("n_pairs"),
            F.count_if(late).alias("n_overlaps"),
            F.avg(F.when(late, 1.0).otherwise(0.0).cast("double")).alias("overlap_rate"),
        )
    )


def _variant_sql(lexicons: dict, tols: list[float]) -> str:
    parts = []
    for name, lex in lexicons.items():
        for tol in tols:
            parts.append(f"SELECT {tol}::DOUBLE AS gap_tol, {q(name)} AS lexicon, * FROM ({sql_features(UTT_TIMED, lex, tol)})")
    return " UNION ALL ".join(parts)


@query("g28_features_by_gap_tol", _variant_sql({"words": WORDS}, features.GAP_TOLERANCES))
def features_by_gap_tol(spark, sf):
    return rounded(features.extract_feature_variants(
        utt_timed(spark, sf), gap_tols=features.GAP_TOLERANCES, lexicons={"words": WORDS}))


YESNO_VARIANTS = {"narrow": WORDS, "broad": WORDS.with_(yesno=("click", "view", "sign"))}


@query("g29_features_by_yesno_list", _variant_sql(YESNO_VARIANTS, [0.05]))
def features_by_yesno(spark, sf):
    return rounded(features.extract_feature_variants(utt_timed(spark, sf), lexicons=YESNO_VARIANTS))


RULE_VARIANTS = {
    "whole": WORDS,
    "1char": WORDS.with_(ne_tails=("p",), yo_tails=("e",)),
    "2char": WORDS.with_(ne_tails=("up", "ck"), yo_tails=("se",)),
}


@query("g30_features_by_particle_rule", _variant_sql(RULE_VARIANTS, [0.05]))
def features_by_rule(spark, sf):
    return rounded(features.extract_feature_variants(utt_timed(spark, sf), lexicons=RULE_VARIANTS))
