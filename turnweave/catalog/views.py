"""Canonical tables built from the driver tables, as DataFrames and as SQL.

`rounded` rounds doubles to six digits: sums run in another order in another
engine, so the last bits differ. Both sides add NUDGE first, so that a mean
that lies exactly between two six-digit numbers rounds the same way.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import PROSE, TAIL_PUNCTUATION, HEAD_PUNCTUATION, WORDS, Lexicon
from ..functions.text import WHITESPACE

DIGITS = 6
NUDGE = 1e-9


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[
        (F.round(F.col(f"`{f.name}`") + (NUDGE if digits == DIGITS else 0.0), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def r(expr: str, alias: str, digits: int = DIGITS) -> str:
    nudge = f" + {NUDGE}" if digits == DIGITS else ""
    return f"round(({expr})::DOUBLE{nudge}, {digits}) + 0.0 AS {alias}"


# --- utterances --------------------------------------------------------------
def utt_timed(spark: SparkSession, sf: str) -> DataFrame:
    start = (
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").cast("double")
        / 1e6
    )
    return table(spark, sf, "events").select(
        F.expr("user_id div 2").cast("string").alias("conversation_id"),
        F.col("user_id").cast("string").alias("speaker_id"),
        F.col("event_id").alias("utt_seq"),
        F.col("event_type").alias("text"),
        start.alias("start_time"),
        (start + F.col("value") * 60).alias("end_time"),
    )


UTT_TIMED = """
  SELECT CAST(user_id // 2 AS VARCHAR) AS conversation_id, CAST(user_id AS VARCHAR) AS speaker_id,
         event_id AS utt_seq, event_type AS text,
         epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + value * 60 AS end_time
  FROM events"""


def utt_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("role").alias("speaker_id"),
        F.col("turn").alias("utt_seq"),
        "text",
        F.lit(None).cast("double").alias("start_time"),
        F.lit(None).cast("double").alias("end_time"),
    )


UTT_TEXT = """
  SELECT CAST(conv_id AS VARCHAR) AS conversation_id, role AS speaker_id, turn AS utt_seq, text,
         NULL::DOUBLE AS start_time, NULL::DOUBLE AS end_time
  FROM conversations"""


# --- text predicates as SQL ----------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_norm(t: str) -> str:
    return f"trim(replace(coalesce({t}, ''), chr(12288), ' '), {q(WHITESPACE)})"


def sql_tail(t: str) -> str:
    return f"rtrim({t}, {q(TAIL_PUNCTUATION + WHITESPACE)})"


def sql_any(parts: list[str]) -> str:
    return "(" + " OR ".join(parts or ["false"]) + ")"


def sql_starts(t: str, prefixes) -> str:
    n = sql_norm(t)
    return sql_any([f"starts_with({n}, {q(p)})" for p in prefixes])


def sql_ends(t: str, tails) -> str:
    return sql_any([f"suffix({t}, {q(x)})" for x in tails])


def sql_question(t: str, lex: Lexicon) -> str:
    n = sql_norm(t)
    return f"(regexp_matches({n}, '[?？]') OR {sql_ends(sql_tail(n), lex.question_tails)})"


def sql_sfp(t: str, lex: Lexicon) -> str:
    n = sql_norm(t)
    tail = sql_tail(n)
    asks = f"(regexp_matches({tail}, '[?？]') OR {sql_ends(tail, lex.question_tails)})"
    return (
        f"CASE WHEN {n} = '' THEN 'NONE' WHEN {sql_ends(tail, lex.ne_tails)} "
        f"THEN CASE WHEN {asks} THEN 'NE_Q' ELSE 'NE' END "
        f"WHEN {sql_ends(tail, lex.yo_tails)} THEN 'YO' ELSE 'OTHER' END"
    )


def sql_token(t: str) -> str:
    head = f"ltrim({sql_norm(t)}, {q(HEAD_PUNCTUATION + WHITESPACE)})"
    return f"regexp_extract({head}, '^([A-Za-z0-9]+|[ぁ-んァ-ヶ一-龠]+)', 1)"


def sql_nospace(t: str) -> str:
    return f"translate(coalesce({t}, ''), {q(WHITESPACE)}, '')"


def sql_bigrams(t: str) -> str:
    return (
        f"list_distinct(list_transform(range(1, length({t})), lambda i: substring({t}, i, 2)))"
    )


def sql_count(t: str, rx: str) -> str:
    return f"len(regexp_extract_all({t}, {q(rx)}))"


def sql_fillers(t: str, lex: Lexicon) -> dict[str, str]:
    n = sql_norm(t)
    gone = f"regexp_replace({n}, {q(lex.filler_eto)}, '', 'g')"
    return {
        "eto": sql_count(n, lex.filler_eto),
        "e": sql_count(gone, lex.filler_e),
        "ano": sql_count(n, lex.filler_ano),
    }


ORDER = "ORDER BY start_time NULLS LAST, end_time NULLS LAST, utt_seq"


def sql_pairs(utt: str, lex: Lexicon) -> str:
    """CTE chain u -> seq -> pairs."""
    return f"""
u0 AS ({utt}),
u AS (SELECT *, {sql_sfp('text', lex)} AS sfp, {sql_question('text', lex)} AS question FROM u0),
seq AS (
  SELECT *, lag(speaker_id) OVER w AS prev_speaker, lag(text) OVER w AS prev_text,
         lag(sfp) OVER w AS prev_sfp, lag(question) OVER w AS prev_q, lag(end_time) OVER w AS prev_end,
         lag(end_time) OVER s AS own_prev_end
  FROM u
  WINDOW w AS (PARTITION BY conversation_id {ORDER}),
         s AS (PARTITION BY conversation_id, speaker_id {ORDER})),
pairs AS (SELECT *, start_time - prev_end AS gap FROM seq
          WHERE prev_speaker IS NOT NULL AND prev_speaker <> speaker_id)"""


def sql_features(utt: str, lex: Lexicon, tol: float = 0.05, only: str = "") -> str:
    """Feature query over an utterance subquery; `only` restricts the output."""
    fills = sql_fillers("text", lex)
    return f"""
WITH {sql_pairs(utt, lex)},
pf AS (
  SELECT *, CASE WHEN {sql_token('text')} = '' THEN '<EMPTY>' ELSE {sql_token('text')} END AS tok,
    CASE WHEN {sql_starts('text', lex.aizuchi)} THEN 1 ELSE 0 END AS aiz,
    CASE WHEN {sql_starts('text', lex.yesno)} THEN 1 ELSE 0 END AS yn,
    CASE WHEN {sql_starts('text', lex.oir)} THEN 1 ELSE 0 END AS oir,
    prev_sfp IN ('NE', 'NE_Q') AS ne, prev_sfp = 'YO' AS yo,
    {sql_nospace('prev_text')} AS ta, {sql_nospace('text')} AS tb
  FROM pairs),
pj AS (SELECT *, {sql_bigrams('ta')} AS ba, {sql_bigrams('tb')} AS bb FROM pf),
po AS (SELECT *, CASE WHEN len(ba) + len(bb) > 0 THEN
         len(list_intersect(ba, bb)) / (len(ba) + len(bb) - len(list_intersect(ba, bb))) END AS ov FROM pj),
pa AS (
  SELECT conversation_id, speaker_id, count(*) AS n,
    count(*) FILTER (ne) AS n_ne, count(*) FILTER (yo) AS n_yo, count(*) FILTER (prev_q) AS n_q,
    avg(aiz) FILTER (ne) AS ne_aiz, avg(oir) AS oir, avg(yn) AS yn,
    avg(oir) FILTER (prev_q) AS oir_q, avg(yn) FILTER (prev_q) AS yn_q,
    avg(ov) AS ov, avg(CASE WHEN gap < -{tol} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ovr,
    avg(gap) FILTER (gap >= {tol}) AS gm, quantile_cont(gap, 0.5) FILTER (gap >= {tol}) AS g50,
    quantile_cont(gap, 0.9) FILTER (gap >= {tol}) AS g90
  FROM po GROUP BY 1, 2),
tk AS (SELECT conversation_id, speaker_id, CASE WHEN ne THEN 'NE' ELSE 'YO' END AS kind, tok, count(*) AS c
       FROM pf WHERE ne OR yo GROUP BY 1, 2, 3, 4),
tp AS (SELECT *, c / sum(c) OVER (PARTITION BY conversation_id, speaker_id, kind) AS p FROM tk),
en AS (SELECT conversation_id, speaker_id, -sum(p * log2(p)) FILTER (kind = 'NE') AS ne_ent,
              -sum(p * log2(p)) FILTER (kind = 'YO') AS yo_ent FROM tp GROUP BY 1, 2),
sp AS (
  SELECT conversation_id, speaker_id, coalesce(sum(greatest(end_time - start_time, 0)), 0) AS speech,
    avg(start_time - own_prev_end) FILTER (start_time - own_prev_end >= {tol}) AS pm,
    stddev_samp(start_time - own_prev_end) FILTER (start_time - own_prev_end >= {tol}) AS psd,
    count(*) FILTER (start_time - own_prev_end >= {tol}) AS pn,
    quantile_cont(start_time - own_prev_end, 0.5) FILTER (start_time - own_prev_end >= {tol}) AS p50,
    quantile_cont(start_time - own_prev_end, 0.9) FILTER (start_time - own_prev_end >= {tol}) AS p90,
    sum(length({sql_nospace('text')})) AS chars,
    sum({fills['eto']}) AS eto, sum({fills['e']}) AS e, sum({fills['ano']}) AS ano,
    avg(CASE WHEN {fills['eto']} + {fills['e']} + {fills['ano']} > 0 THEN 1 ELSE 0 END) AS fany
  FROM seq GROUP BY 1, 2),
cv AS (SELECT conversation_id, max(end_time) - min(start_time) AS total FROM u GROUP BY 1)
SELECT pa.conversation_id, pa.speaker_id, n::BIGINT AS n_pairs_total, n_ne::BIGINT AS "n_pairs_after_NE",
  n_yo::BIGINT AS "n_pairs_after_YO", n::BIGINT AS "IX_n_pairs", n_q::BIGINT AS "IX_n_pairs_after_question",
  {r('ne_aiz', '"RESP_NE_AIZUCHI_RATE"')}, {r('ne_ent', '"RESP_NE_ENTROPY"')},
  {r('yo_ent', '"RESP_YO_ENTROPY"')}, {r('oir', '"IX_oirmarker_rate"')}, {r('yn', '"IX_yesno_rate"')},
  {r('ov', '"IX_lex_overlap_mean"')}, {r('1 - ov', '"IX_topic_drift_mean"')},
  {r('oir_q', '"IX_oirmarker_after_question_rate"')}, {r('yn_q', '"IX_yesno_after_question_rate"')},
  {r('total', '"PG_total_time"')},
  {r('CASE WHEN total > 0 THEN speech / total END', '"PG_speech_ratio"')},
  {r('pm', '"PG_pause_mean"')}, {r('p50', '"PG_pause_p50"')}, {r('p90', '"PG_pause_p90"')},
  {r('CASE WHEN pn >= 2 AND pm > 0 THEN psd / pm END', '"PG_pause_variability"')},
  {r('gm', '"PG_resp_gap_mean"')}, {r('g50', '"PG_resp_gap_p50"')}, {r('g90', '"PG_resp_gap_p90"')},
  {r('ovr', '"PG_overlap_rate"')}, {r('ovr', '"PG_resp_overlap_rate"')},
  chars::BIGINT AS "FILL_text_len", (eto + e + ano)::BIGINT AS "FILL_cnt_total",
  eto::BIGINT AS "FILL_cnt_eto", e::BIGINT AS "FILL_cnt_e", ano::BIGINT AS "FILL_cnt_ano",
  {r('CASE WHEN chars > 0 THEN 100.0 * (eto + e + ano) / chars END', '"FILL_rate_per_100chars"')},
  {r('fany', '"FILL_has_any"')}
FROM pa JOIN sp USING (conversation_id, speaker_id) JOIN cv USING (conversation_id)
LEFT JOIN en USING (conversation_id, speaker_id) {only}"""
