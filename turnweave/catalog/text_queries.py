"""Text predicates and cleaning functions over whole text columns."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text as tx
from ..functions.lexicon import JA, PROSE
from ..operators import columns as cl
from ..operators import metadata as md
from ..operators import raters as ra
from . import query
from .views import (
    q, r, rounded, sql_bigrams, sql_count, sql_fillers, sql_norm, sql_nospace, sql_question, sql_sfp,
    sql_starts, sql_token, table,
)

DECORATED = "concat('　 ', text, '。」  ')"


@query("f1_norm_text", f"SELECT conv_id, turn, {sql_norm(DECORATED)} AS norm FROM conversations")
def norm_text(spark, sf):
    t = F.concat(F.lit("　 "), F.col("text"), F.lit("。」  "))
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.norm_text(t).alias("norm"))


@query("f2_is_question", f"""SELECT conv_id, turn, {sql_question(DECORATED, PROSE)} AS prose,
  {sql_question("concat(text, '？')", JA)} AS marked, {sql_question("concat(text, 'いいかね。')", JA)} AS ja
  FROM conversations""")
def is_question(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn",
        tx.is_question(F.concat(F.lit("　 "), t, F.lit("。」  ")), PROSE).alias("prose"),
        tx.is_question(F.concat(t, F.lit("？"))).alias("marked"),
        tx.is_question(F.concat(t, F.lit("いいかね。"))).alias("ja"),
    )


ENDINGS = ("ね", "よ！", "かね", "の", "だよな。")
_end_sql = "CASE turn % 5 " + " ".join(f"WHEN {i} THEN {q(e)}" for i, e in enumerate(ENDINGS)) + " END"


@query("f3_sfp_group", f"""SELECT conv_id, turn, {sql_sfp('text', PROSE)} AS prose,
  {sql_sfp(f"concat(text, {_end_sql})", JA)} AS ja FROM conversations""")
def sfp_group(spark, sf):
    ends = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("turn") % 5 + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.sfp_group(F.col("text"), PROSE).alias("prose"),
        tx.sfp_group(F.concat("text", ends)).alias("ja"),
    )


@query("f4_first_token", f"SELECT conv_id, turn, {sql_token('text')} AS token FROM conversations")
def first_token(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.first_token(F.col("text")).alias("token"))


@query("f6_prefix_predicates", f"""SELECT conv_id, turn, {sql_starts('text', PROSE.aizuchi)} AS aizuchi,
  {sql_starts('text', PROSE.yesno)} AS yesno, {sql_starts('text', PROSE.oir)} AS oir FROM conversations""")
def prefixes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.is_aizuchi(t, PROSE).alias("aizuchi"), tx.is_yesno(t, PROSE).alias("yesno"),
        tx.is_oir(t, PROSE).alias("oir"))


@query("f7_char_bigrams", f"""SELECT conv_id, turn, len({sql_bigrams(sql_nospace('text'))})::BIGINT AS n_distinct,
  list_aggregate(list_sort({sql_bigrams(sql_nospace('text'))}), 'string_agg', '|') AS bigrams FROM conversations""")
def bigrams(spark, sf):
    b = F.array_sort(F.array_distinct(tx.char_bigrams(F.col("text"))))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.size(b).cast("long").alias("n_distinct"), F.array_join(b, "|").alias("bigrams"))


@query("f9_filler_counts", f"""SELECT doc_id, {sql_fillers('text', PROSE)['eto']}::BIGINT AS eto,
  {sql_fillers('text', PROSE)['e']}::BIGINT AS e, {sql_fillers('text', PROSE)['ano']}::BIGINT AS ano FROM documents""")
def fillers(spark, sf):
    c = tx.filler_counts(F.col("text"), PROSE)
    return table(spark, sf, "documents").select(
        "doc_id", *[c[k].cast("long").alias(k) for k in ("eto", "e", "ano")])


@query("f10_filler_count_simple", f"""SELECT doc_id, {sql_count('text', PROSE.filler_simple)}::BIGINT AS n
  FROM documents""")
def fillers_simple(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.filler_count_simple(F.col("text"), PROSE).cast("long").alias("n"))


@query("f11_lengths", f"""SELECT doc_id, length({sql_nospace('text')})::BIGINT AS no_space,
  length(replace(replace(text, ' ', ''), chr(12288), ''))::BIGINT AS no_blank FROM documents""")
def lengths(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", tx.length_without_space(t).cast("long").alias("no_space"),
        tx.length_without_blank(t).cast("long").alias("no_blank"))


# Answers with the decorations raters produce, spread over order lines.
RAW = ("  very   accurate ", '"Very Inaccurate"', "3", "Neither Accurate Nor Inaccurate.", "I think Moderately Accurate",
       "moderately inaccurate\nbecause", "0", "n/a", "'moderately accurate'", "Neither accurate nor inaccurate (neutral)",
       "VERY INACCURATE", "")
V1 = ("Very Accurate", "Very Inaccurate", None, "Neither Accurate Nor Inaccurate", "Moderately Accurate",
      "Moderately Inaccurate", None, None, "Moderately Accurate", "Neither Accurate Nor Inaccurate", "Very Inaccurate", None)
V2 = ("Very Accurate", "Very Inaccurate", "Moderately Accurate", "Neither Accurate nor Inaccurate",
      "I think Moderately Accurate", "Moderately Inaccurate", "Very Inaccurate", "n/a", "Moderately Accurate",
      "Neither Accurate nor Inaccurate", "Very Inaccurate", "")
_IDX = "(l_orderkey + l_linenumber) % 12"


def _case(values, idx=_IDX):
    return f"CASE {idx} " + " ".join(
        f"WHEN {i} THEN {'NULL' if v is None else q(v)}" for i, v in enumerate(values)) + " END"


@query("f12_f13_choice_normalisers", f"""SELECT l_orderkey, l_linenumber, {_case(V1)} AS v1, {_case(V2)} AS v2,
  count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4""")
def choices(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 12 + 1).cast("int"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return d.groupBy("l_orderkey", "l_linenumber", ra.normalise_choice_v1(F.col("raw")).alias("v1"),
                     ra.normalise_choice(F.col("raw")).alias("v2")).agg(F.count(F.lit(1)).alias("n"))


_SCORE = {c: float(i) for i, c in enumerate(ra.CHOICES)}


@query("f14_choice_scores", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN 4 - s ELSE s END AS score
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, CASE {_case(V2)} {' '.join(f"WHEN {q(c)} THEN {s}::DOUBLE" for c, s in _SCORE.items())} END AS s
  FROM lineitem)""")
def choice_scores(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in RAW]), ((F.col("l_orderkey") + F.col("l_linenumber")) % 12 + 1).cast("int"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return d.select("l_orderkey", "l_linenumber",
                    ra.choice_score(ra.normalise_choice(raw), F.col("l_linenumber") % 2).alias("score"))


@query("b3_b4_numeric_cleaning", """SELECT o_orderkey, o_totalprice AS price,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 100)::DOUBLE / 4 END AS coerced FROM orders""")
def cleaning(spark, sf):
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice",
        F.when(k % 3 == 0, F.when(k % 2 == 0, "inf").otherwise("n/a")).otherwise(
            ((k % 100).cast("double") / 4).cast("string")).alias("raw"))
    return d.select("o_orderkey", cl.finite(F.col("o_totalprice")).alias("price"), cl.to_number("raw").alias("coerced"))


@query("b5_drop_missing_outcome", """SELECT source, count(*) AS n, sum(quality)::BIGINT AS good FROM documents
  LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""")
def missing_outcome(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    y = d.withColumn("y", F.col("quality").cast("double"))
    return cl.with_outcome(y, "y").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"))


@query("b6_exclude_columns", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def excluded(spark, sf):
    return cl.exclude_columns(table(spark, sf, "orders"), {"o_totalprice"}, "o_orderdate, o_orderstatus")


@query("b9_speaker_count", """SELECT c_custkey, c_nationkey::BIGINT AS leading,
  (c_nationkey::VARCHAR || c_custkey::VARCHAR)::BIGINT AS digits FROM customer""")
def speaker_count(spark, sf):
    s = F.concat(F.lit(" "), F.col("c_nationkey"), F.lit("人/"), F.col("c_custkey"), F.lit("名"))
    return table(spark, sf, "customer").select(
        "c_custkey", cl.leading_int(s).alias("leading"), cl.all_digits(s).alias("digits"))


@query("b12_b14_recodes", f"""SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN (c_nationkey * 2 + 4) / 2 END::DOUBLE AS age,
  CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' END AS gender,
  CASE WHEN c_custkey % 5 > 0 THEN 'IC' || lpad((c_nationkey)::VARCHAR, 2, '0') END AS label FROM customer""")
def recodes(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    band = F.when(k % 4 > 0, F.concat(n, F.lit("-"), n + 4, F.lit("歳"))).otherwise("不明")
    word = F.when(k % 3 == 0, "女性").when(k % 3 == 1, "男性").otherwise("不明")
    label = F.when(k % 5 > 0, F.concat(F.lit("IC"), F.lpad(n.cast("string"), 2, "0"), F.lit("_名前"))).otherwise("名前")
    return table(spark, sf, "customer").select(
        "c_custkey", md.age_band_midpoint(band).alias("age"), md.recode(word, md.GENDER_WORDS).alias("gender"),
        md.label_prefix(label).alias("label"))


@query("hash_keys", """SELECT doc_id, md5('42:7:' || doc_id) AS key,
  ('0x' || substr(md5('42:7:' || doc_id), 1, 8))::BIGINT % 97 AS draw FROM documents""")
def hash_keys(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hashing.hash_key(42, 7, F.col("doc_id")).alias("key"),
        hashing.draw_index(97, 42, 7, F.col("doc_id")).alias("draw"))
