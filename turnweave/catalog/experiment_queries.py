"""Text conditions, dose rewrites and their reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import PROSE, WORDS
from ..functions.text import WHITESPACE
from ..operators import features as ft
from ..operators.raters import pearson
from ..operators.turns import KEYS
from ..plans import conditions as co
from ..plans import dose as do
from ..plans import studies as st
from . import query
from .feature_queries import RULE_VARIANTS, YESNO_VARIANTS, _variant_sql
from .record_queries import MONOLOGUES, monologues
from .resampling_queries import K, N_PERM, POS, SEED, _union_all, sql_permuted, sql_test
from .views import UTT_TEXT, UTT_TIMED, q, r, rounded, sql_count, sql_nospace, sql_starts, table, utt_text, utt_timed


# --- conditions --------------------------------------------------------------------
@query("g1_pearson", f"""SELECT l_returnflag, l_linestatus, {r('corr(l_quantity, l_extendedprice)', 'r')} FROM lineitem GROUP BY 1, 2""")
def pearson_r(spark, sf):
    return rounded(table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")))


def _stats_sql(utt, lex):
    return f"""SELECT conversation_id, speaker_id, n_utt, mean_chars, filler_count::BIGINT AS filler_count, duration_sec FROM
  (SELECT conversation_id, speaker_id, count(*) AS n_utt, avg(length({sql_nospace('text')})) AS mean_chars,
    sum({sql_count('text', lex.filler_simple)}) AS filler_count FROM ({utt}) GROUP BY 1, 2)
  JOIN (SELECT conversation_id, max(coalesce(end_time, 0)) - min(coalesce(start_time, 0)) AS duration_sec FROM ({utt}) GROUP BY 1) USING (conversation_id)"""


@query("e14_c11_summary_stats", f"""SELECT conversation_id, speaker_id, n_utt, {r('mean_chars', 'mean_chars')}, filler_count,
  {r('duration_sec', 'duration_sec')} FROM ({_stats_sql(UTT_TIMED, WORDS)})""")
def summary_stats(spark, sf):
    return rounded(co.summary_stats(utt_timed(spark, sf), WORDS))


@query("f16_c12_h2_summary_texts", f"""SELECT s.conversation_id, s.speaker_id, 'この話者は合計' || n_utt || '回発話し、平均発話長は' || format('{{:.1f}}', mean_chars)
  || '文字、会話全体の長さは' || format('{{:.0f}}', duration_sec) || '秒、フィラーは' || filler_count || '回使用しました。' AS text
  FROM ({_stats_sql(UTT_TEXT, PROSE)}) s SEMI JOIN ({MONOLOGUES}) m USING (conversation_id, speaker_id)""")
def summary_texts(spark, sf):
    return co.summary_texts(utt_text(spark, sf), monologues(spark, sf), PROSE)


_RING = f"""SELECT conversation_id, speaker_id, text, row_number() OVER (ORDER BY md5('{SEED}:' || conversation_id || ':' || speaker_id),
  conversation_id, speaker_id) - 1 AS p, count(*) OVER () AS n FROM ({MONOLOGUES})"""


@query("c14_h1_shuffle_mapping", f"""SELECT a.conversation_id, a.speaker_id, a.p AS original_index, b.p AS assigned_index,
  b.conversation_id AS assigned_conversation_id, b.speaker_id AS assigned_speaker_id FROM ({_RING}) a JOIN ({_RING}) b ON b.p = (a.p + 1) % a.n""")
def shuffle_mapping(spark, sf):
    return co.shuffle_mapping(monologues(spark, sf), SEED)


@query("c14_h1_shuffle_texts", f"SELECT a.conversation_id, a.speaker_id, b.text FROM ({_RING}) a JOIN ({_RING}) b ON b.p = (a.p + 1) % a.n")
def shuffle_texts(spark, sf):
    return co.shuffle_texts(monologues(spark, sf), SEED)


_RESULTS = """SELECT CASE l_suppkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'summary' ELSE 'random' END AS condition,
  'T' || l_partkey % 200 AS trait, round(avg(CASE WHEN l_suppkey % 3 < 2 OR l_partkey % 10 > 0 THEN l_discount END) * 10, 6) AS r_obs,
  round(avg(l_tax), 6) AS p_value, round(avg(l_tax) * 2, 6) AS p_corrected FROM lineitem GROUP BY 1, 2"""
_LABEL = f"""CASE WHEN r1 IS NULL OR r2 IS NULL OR r3 IS NULL THEN 'N/A' WHEN abs(r1 - r2) >= 0.1 AND abs(r1 - r3) >= 0.1 THEN {q(co.CONTENT)}
  WHEN abs(r1 - r2) < 0.1 THEN {q(co.SURFACE)} WHEN abs(r2 - r3) < 0.1 THEN {q(co.CONTRIBUTES)} ELSE 'N/A' END"""


@query("c13_h3_h4_compare_conditions", f"""WITH x AS ({_RESULTS}), w AS (SELECT trait, max(r_obs) FILTER (condition = 'text') AS r1,
  max(r_obs) FILTER (condition = 'summary') AS r2, max(r_obs) FILTER (condition = 'random') AS r3 FROM x GROUP BY 1)
  SELECT condition, trait, r_obs, p_value, p_corrected, CASE WHEN condition = 'text' THEN 0.0::DOUBLE ELSE round(r1 - r_obs, 6) + 0.0 END AS delta_r_vs_text,
  {_LABEL} AS label, CASE condition WHEN 'text' THEN 0 WHEN 'summary' THEN 1 ELSE 2 END::BIGINT AS condition_rank FROM x JOIN w USING (trait)""")
def compare_conditions(spark, sf):
    c = F.col("l_suppkey") % 3
    known = F.when((c < 2) | (F.col("l_partkey") % 10 > 0), F.col("l_discount"))  # some results are missing
    d = table(spark, sf, "lineitem").groupBy(F.when(c == 0, "text").when(c == 1, "summary").otherwise("random").alias("condition"),
                  F.concat(F.lit("T"), F.col("l_partkey") % 200).alias("trait")).agg(
        F.round(F.avg(known) * 10, 6).alias("r_obs"), F.round(F.avg("l_tax"), 6).alias("p_value"),
        F.round(F.avg("l_tax") * 2, 6).alias("p_corrected"))
    return rounded(co.compare_conditions(d))


# --- dose rewrites -------------------------------------------------------------------
PROSE_FILL = do.FillerRules("the", "on+", "er", (("the", "xxe"), ("o(n+)", "O$1"), ("er", "ar")), ("the", "on", "er"), ",")
PROSE_YESNO = do.LineRules.of(("The", "In"), {"The": "Zhe", "In": "Un"}, {"On": "In", "É": "The", "Re": "In"},
                              ("Th", "On", "É", "Re", "Er"), "Hm")
PROSE_OIR = do.LineRules.of(("On", "Re"), {"On": "Un"}, {"Er": "On", "The": "Re", "In": "On"}, ("The", "In", "Er"), "Hm")
PROSE_RULES = {"FILL": PROSE_FILL, "YESNO": PROSE_YESNO, "OIR": PROSE_OIR}

# Sentence ends carry an annotation, so the mask is exercised.
ANNOTATED = f"SELECT conversation_id, speaker_id, n_utt, replace(text, '. ', ' (F the). ') AS text FROM ({MONOLOGUES})"


def annotated(spark, sf):
    return monologues(spark, sf).select(*KEYS, "n_utt", F.replace("text", F.lit(". "), F.lit(" (F the). ")).alias("text"))


def _swap_sql(pairs, otherwise):
    return "CASE " + " ".join(f"WHEN starts_with(s, {q(p)}) THEN {q(n)} || substr(s, {len(p) + 1})" for p, n in pairs) + f" ELSE {otherwise} END"


def _ann(mark="chr(2)", t="text"):
    return f"regexp_replace({t}, {q(do.ANNOTATION)}, {mark}, 'g')"


def _fill_count(t):
    m, f = _ann(t=t), PROSE_FILL
    gone = f"regexp_replace({m}, {q(f.eto)}, '', 'g')"
    return f"({sql_count(m, f.eto)} + {sql_count(gone, f.e)} + {sql_count(m, f.ano)})"


def _line_count(t, prefixes):
    return f"len(list_filter(string_split({t}, chr(10)), lambda l: {sql_starts('l', prefixes)}))"


def _log_sql(rows, count):
    """rows(conversation_id, speaker_id, n_utt, original, text, dose_level, original_count, inserted, deleted)."""
    pct = "coalesce(abs(length(text) - length(original)) * 100.0::DOUBLE / nullif(length(original), 0), 0)"
    return f"""SELECT conversation_id, speaker_id, dose_level::INTEGER AS dose_level, n_utt, length({sql_nospace('text')})::BIGINT AS n_chars, text,
  original_count::INTEGER AS original_count, ({count})::INTEGER AS new_count, inserted::INTEGER AS inserted, deleted::INTEGER AS deleted,
  length(original)::INTEGER AS original_chars, length(text)::INTEGER AS new_chars, round({pct}, 2) + 0.0 AS char_change_pct,
  CASE WHEN {pct} > 5 THEN 'char_change ' || format('{{:.1f}}', {pct}) || '% exceeds ±5% limit' ELSE '' END AS warning FROM ({rows})"""


def _line_dose_sql(rules):
    neutral = dict(rules.neutral)
    longest = [(p, neutral.get(p, rules.fallback)) for p in sorted(rules.prefixes, key=len, reverse=True)]
    return f"""WITH m AS ({ANNOTATED}),
ln AS (SELECT conversation_id, speaker_id, n_utt, text, i, ls[i] AS l, trim(ls[i], {q(WHITESPACE)}) AS s FROM
  (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM m)),
fl AS (SELECT *, {sql_starts('s', rules.prefixes)} AS hit, md5('{SEED}:' || conversation_id || ':' || speaker_id || ':' || (i - 1)) AS h,
  {_swap_sql(longest, 'l')} AS less, {_swap_sql(rules.convert, 'NULL')} AS new FROM ln),
rk AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY conversation_id, speaker_id) AS cnt,
  row_number() OVER (PARTITION BY conversation_id, speaker_id, NOT hit AND new IS NOT NULL ORDER BY h) AS rn FROM fl),
ch AS (SELECT *, NOT hit AND new IS NOT NULL AND rn <= CASE WHEN cnt > 0 THEN 2 * cnt ELSE 3 END AS chosen FROM rk),
rows3 AS (
  SELECT conversation_id, speaker_id, n_utt, text AS original, cnt AS original_count, 0 AS dose_level, string_agg(less, chr(10) ORDER BY i) AS text,
    0 AS inserted, cnt AS deleted FROM ch GROUP BY conversation_id, speaker_id, n_utt, ch.text, cnt
  UNION ALL SELECT conversation_id, speaker_id, n_utt, text, cnt, 1, text, 0, 0 FROM ch GROUP BY conversation_id, speaker_id, n_utt, text, cnt
  UNION ALL SELECT conversation_id, speaker_id, n_utt, text, cnt, 3, string_agg(CASE WHEN chosen THEN new ELSE l END, chr(10) ORDER BY i),
    count(*) FILTER (chosen), 0 FROM ch GROUP BY conversation_id, speaker_id, n_utt, text, cnt)
{_log_sql('SELECT * FROM rows3', _line_count('text', rules.prefixes))}"""


def _u32(kind, i):
    return f"('0x' || substr(md5('{SEED}:{kind}:' || conversation_id || ':' || speaker_id || ':' || {i}), 1, 8))::BIGINT"


def _fill_dose_sql():
    f = PROSE_FILL
    word = lambda d: "list_value(" + ", ".join(q(w) for w in f.insertions) + f")[{_u32('word', d)} % {len(f.insertions)} + 1]"
    neutral = "s"
    for rx, new in f.neutral:
        neutral = f"regexp_replace({neutral}, {q(rx)}, {q(new.replace('$1', chr(92) + '1'))}, 'g')"
    seg = f"regexp_extract_all(text, {q(do.ANNOTATION + '|[^(]+|' + chr(92) + '(')})"
    less = f"array_to_string(list_transform({seg}, lambda s: CASE WHEN regexp_full_match(s, {q(do.ANNOTATION)}) THEN s ELSE {neutral} END), '')"
    rec = "conversation_id, speaker_id"
    return f"""WITH m AS (SELECT *, {_fill_count('text')} AS cnt FROM ({ANNOTATED})),
ln AS (SELECT {rec}, cnt, i - 1 AS line, ls[i] AS l, trim(ls[i], {q(WHITESPACE)}) = '' AS blank FROM
  (SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM m)),
pl AS (SELECT *, CASE WHEN blank THEN [l] ELSE list_filter(string_split(regexp_replace(l, {q('(' + do.ANNOTATION + '|' + f.comma + ')')}, '\\1' || chr(1), 'g'), chr(1)),
  lambda p: p <> '') END AS ps FROM ln),
pc AS (SELECT {rec}, cnt, line, blank, j, ps[j] AS piece, row_number() OVER (PARTITION BY {rec} ORDER BY line, j) - 1 AS place FROM
  (SELECT *, unnest(range(1, len(ps) + 1)) AS j FROM pl)),
sl AS (SELECT *, row_number() OVER (PARTITION BY {rec} ORDER BY place) - 1 AS slot, count(*) OVER (PARTITION BY {rec}) AS ns FROM pc WHERE NOT blank),
dm AS (SELECT {rec}, ns, unnest(range(1, 2 * cnt + 1)) AS d FROM (SELECT DISTINCT {rec}, ns, cnt FROM sl) WHERE cnt > 0),
many AS (SELECT dm.conversation_id, dm.speaker_id, d, place, w FROM (SELECT *, {_u32('slot', 'd')} % ns AS slot, {word('d')} AS w FROM dm) dm JOIN sl USING ({rec}, slot)),
few AS (SELECT *, {word('d')} AS w FROM (SELECT {rec}, place, row_number() OVER (PARTITION BY {rec} ORDER BY md5('{SEED}:line:' || conversation_id || ':' || speaker_id || ':' || line), place) AS d
  FROM sl WHERE j = 1 AND cnt = 0) WHERE d <= 3),
dr AS (SELECT {rec}, d, place, w FROM many UNION ALL SELECT {rec}, d, place, w FROM few),
ins AS (SELECT {rec}, place, string_agg(w, '' ORDER BY d) AS w, sum(length(w)) AS added FROM dr GROUP BY ALL),
nl AS (SELECT {rec}, line, string_agg(coalesce(w, '') || piece, '' ORDER BY place) AS s, sum(coalesce(added, 0)) AS added FROM pc LEFT JOIN ins USING ({rec}, place) GROUP BY {rec}, line),
hl AS (SELECT *, {_ann('repeat(chr(2), 11)', 's')} AS held FROM nl),
rm AS (SELECT *, length(held) AS hlen, CASE WHEN trim(s, {q(WHITESPACE)}) = '' THEN 0 ELSE
  greatest(length(regexp_extract(held, '(?s)^(?:.*(?:' || chr(2) || {q('|' + f.any)} || '))?(.*)$', 1)) - 2, 0) END AS room, sum(added) OVER (PARTITION BY {rec}) AS budget FROM hl),
us AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY {rec} ORDER BY hlen DESC, line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM rm),
tr AS (SELECT {rec}, string_agg(left(s, (length(s) - least(room, greatest(budget - used, 0)))::BIGINT), chr(10) ORDER BY line) AS more FROM us GROUP BY {rec}),
rows3 AS (
  SELECT {rec}, n_utt, text AS original, cnt AS original_count, 0 AS dose_level, {less} AS text, 0 AS inserted, cnt AS deleted FROM m
  UNION ALL SELECT {rec}, n_utt, text, cnt, 1, text, 0, 0 FROM m
  UNION ALL SELECT {rec}, n_utt, text, cnt, 3, more, CASE WHEN cnt > 0 THEN 2 * cnt ELSE {_fill_count('more')} END, 0 FROM m JOIN tr USING ({rec}))
{_log_sql('SELECT * FROM rows3', _fill_count('text'))}"""


DOSE = {"FILL": _fill_dose_sql(), "YESNO": _line_dose_sql(PROSE_YESNO), "OIR": _line_dose_sql(PROSE_OIR)}


def doses(spark, sf, feature):
    return do.dose_table(annotated(spark, sf), feature, rules=PROSE_RULES, seed=SEED)


@query("h5_h8_dose_fillers", DOSE["FILL"])
def dose_fillers(spark, sf):
    return doses(spark, sf, "FILL")


@query("h6_h8_dose_yesno", DOSE["YESNO"])
def dose_yesno(spark, sf):
    return doses(spark, sf, "YESNO")


@query("h7_h8_dose_repair", DOSE["OIR"])
def dose_repair(spark, sf):
    return doses(spark, sf, "OIR")


@query("h9_dose_log_summary", f"""SELECT dose_level, {r('avg(char_change_pct)', 'mean_char_change')}, count(*) FILTER (warning <> '') AS n_warnings,
  count(*) AS n_records FROM ({DOSE['YESNO']}) GROUP BY 1""")
def dose_log_summary(spark, sf):
    return rounded(do.dose_log_summary(doses(spark, sf, "YESNO")))


def _counts_sql(src):
    return f"""SELECT *, {_fill_count('text')}::DOUBLE AS "FILL_count", {_line_count('text', PROSE_YESNO.prefixes)}::DOUBLE AS "YESNO_count",
  {_line_count('text', PROSE_OIR.prefixes)}::DOUBLE AS "OIR_count", CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::DOUBLE AS n_lines,
  length({sql_nospace('text')})::DOUBLE AS n_chars FROM ({src})"""


@query("f17_f18_text_counts", f"""SELECT conversation_id, speaker_id, "FILL_count"::BIGINT AS "FILL_count", "YESNO_count"::BIGINT AS "YESNO_count",
  "OIR_count"::BIGINT AS "OIR_count", n_lines::BIGINT AS n_lines, n_chars::BIGINT AS n_chars FROM ({_counts_sql(ANNOTATED)})""")
def text_counts(spark, sf):
    c = do.text_counts(F.col("text"), PROSE_RULES)
    return annotated(spark, sf).select(*KEYS, *[e.cast("long").alias(n) for n, e in c.items()])


_C = ", ".join(f'"{c}"' for c in do.COUNTERS)


def _verify_sql(feature):
    up = lambda src, by: f"SELECT {by} feature_name, avg(v) AS m FROM (UNPIVOT (SELECT * FROM ({_counts_sql(src)})) ON {_C} INTO NAME feature_name VALUE v) GROUP BY ALL"
    dose = f"SELECT conversation_id, speaker_id, dose_level, text FROM ({DOSE[feature]})"
    return f"""SELECT dose_level, feature_name, {r('b.m', 'mean_original', 4)}, {r('a.m', 'mean_manipulated', 4)}, {r('a.m - b.m', 'delta', 4)},
  {r('coalesce((a.m - b.m) * 100 / nullif(b.m, 0), 0)', 'delta_pct', 2)}, feature_name = '{feature}_count' AS is_target
  FROM ({up(dose, 'dose_level,')}) a JOIN ({up(ANNOTATED, '')}) b USING (feature_name)"""


def _verify(spark, sf, feature):
    return do.verify_doses(annotated(spark, sf), doses(spark, sf, feature), feature, PROSE_RULES)


@query("h10_verify_fillers", _verify_sql("FILL"))
def verify_fillers(spark, sf):
    return rounded(_verify(spark, sf, "FILL"))


@query("h10_verify_yesno", _verify_sql("YESNO"))
def verify_yesno(spark, sf):
    return rounded(_verify(spark, sf, "YESNO"))


@query("h11_side_effects", f"SELECT * FROM ({_verify_sql('YESNO')}) WHERE NOT is_target AND abs(delta_pct) > 1.0")
def side_effects(spark, sf):
    return rounded(do.side_effects(_verify(spark, sf, "YESNO"), 1.0))


@query("d8_dose_monotonic", f"""SELECT feature_name, count(*) AS n_levels, coalesce(bool_and(step >= 0), true) AS monotonic FROM
  (SELECT feature_name, mean_manipulated - lag(mean_manipulated) OVER (PARTITION BY feature_name ORDER BY dose_level) AS step FROM ({_verify_sql('YESNO')})) GROUP BY 1""")
def dose_monotonic(spark, sf):
    return do.monotonic(_verify(spark, sf, "YESNO"), ["feature_name"], "dose_level", "mean_manipulated")


# --- dose report ----------------------------------------------------------------------
_DOSED = """SELECT CASE l_suppkey % 2 WHEN 0 THEN 'FILL' ELSE 'OIR' END AS target_feature, CASE l_linenumber % 3 WHEN 2 THEN 3 ELSE l_linenumber % 3 END::INTEGER AS dose_level,
  'T' || l_partkey % 5 AS trait, round(avg(l_discount) * 10, 6) AS r_obs, round(avg(l_tax), 6) AS p_value, round(avg(l_tax) * 2, 6) AS p_corrected FROM lineitem GROUP BY 1, 2, 3"""


def _dosed(spark, sf):
    level = F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").groupBy(
        F.when(F.col("l_suppkey") % 2 == 0, "FILL").otherwise("OIR").alias("target_feature"),
        F.when(level == 2, 3).otherwise(level).alias("dose_level"), F.concat(F.lit("T"), F.col("l_partkey") % 5).alias("trait"),
    ).agg(F.round(F.avg("l_discount") * 10, 6).alias("r_obs"), F.round(F.avg("l_tax"), 6).alias("p_value"),
          F.round(F.avg("l_tax") * 2, 6).alias("p_corrected"))


_REPORT = f"""WITH x AS ({_DOSED}), b AS (SELECT target_feature, trait, r_obs AS base FROM x WHERE dose_level = 1),
  d AS (SELECT x.*, base, base - r_obs AS diff FROM x JOIN b USING (target_feature, trait)),
  k AS (SELECT *, rank() OVER (PARTITION BY target_feature, dose_level ORDER BY abs(diff)) AS rk FROM d WHERE dose_level <> 1),
  w AS (SELECT target_feature, dose_level, least(sum(rk) FILTER (diff > 0), sum(rk) FILTER (diff < 0), 15) AS w,
    coalesce(sum(rk) FILTER (diff > 0), 0) AS wp, coalesce(sum(rk) FILTER (diff < 0), 0) AS wm FROM k GROUP BY 1, 2),
  p AS (SELECT target_feature, dose_level, least(1.0, 2 * (SELECT count(*) FROM range(32) s(s) WHERE
    (s & 1) * 1 + (s >> 1 & 1) * 2 + (s >> 2 & 1) * 3 + (s >> 3 & 1) * 4 + (s >> 4 & 1) * 5 <= least(wp, wm)) / 32)::DOUBLE AS wilcoxon_p FROM w)
  SELECT target_feature, dose_level, trait, r_obs, p_value, p_corrected, {r('r_obs - base', 'delta_r_vs_baseline')}, {r('wilcoxon_p', 'wilcoxon_p')}
  FROM d LEFT JOIN p USING (target_feature, dose_level)"""


@query("h12_dose_report", _REPORT)
def dose_report(spark, sf):
    return rounded(do.dose_report(_dosed(spark, sf)))


@query("h13_dose_judgement", f"""SELECT target_feature, trait, m AS monotonic, dir AS trend_direction,
  CASE WHEN m THEN 'dose-response relationship detected (' || dir || ')' ELSE 'no monotonic ' || dir || ' trend' END AS judgment FROM (
  SELECT target_feature, trait, CASE target_feature WHEN 'FILL' THEN 'increasing' ELSE 'decreasing' END AS dir,
   bool_and(CASE target_feature WHEN 'FILL' THEN step >= 0 ELSE step <= 0 END) AS m FROM
   (SELECT *, r_obs - lag(r_obs) OVER (PARTITION BY target_feature, trait ORDER BY dose_level) AS step FROM ({_DOSED})) WHERE step IS NOT NULL GROUP BY 1, 2)""")
def dose_judgement(spark, sf):
    d = _dosed(spark, sf)
    signs = d.select("target_feature").distinct().withColumn("sign", F.when(F.col("target_feature") == "FILL", "+").otherwise("-"))
    per_trait = d.select("target_feature", "trait").distinct().join(signs, "target_feature")
    return do.dose_judgement(d, per_trait, ["target_feature", "trait"])


@query("h13_specificity", f"""SELECT {r('t', 'target_max_delta')}, {r('c', 'control_max_delta')}, t - c > 0.05 AS specific,
  CASE WHEN t - c > 0.05 THEN 'the effect is specific to FILL' ELSE 'no effect specific to FILL' END AS judgment FROM
  (SELECT max(abs(delta_r_vs_baseline)) FILTER (target_feature = 'FILL') AS t, max(abs(delta_r_vs_baseline)) FILTER (target_feature = 'OIR') AS c FROM ({_REPORT}))""")
def specificity(spark, sf):
    return rounded(do.specificity(do.dose_report(_dosed(spark, sf)), "FILL", "OIR"))


@query("h14_direction_consistency", """WITH s AS (SELECT p_brand, max(CASE WHEN l_suppkey % 3 = 0 THEN 1 END) AS x,
    round(avg(l_quantity) FILTER (l_suppkey % 3 = 0), 4) AS b, round(avg(l_quantity) FILTER (l_suppkey % 3 = 1), 4) AS i,
    round(avg(l_quantity) FILTER (l_suppkey % 3 = 2), 4) AS d FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
  SELECT p_brand, CASE WHEN p_brand LIKE '%1' THEN '+' ELSE '-' END AS sign, b AS baseline, i AS increase, d AS decrease,
    round(i - b, 4) + 0.0 AS delta_increase, round(d - b, 4) + 0.0 AS delta_decrease,
    CASE WHEN p_brand LIKE '%1' THEN i - b > 0 AND d - b < 0 ELSE i - b < 0 AND d - b > 0 END AS direction_consistent FROM s""")
def direction(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    m = F.col("l_suppkey") % 3
    d = li.join(p, li.l_partkey == p.p_partkey).groupBy(
        "p_brand", F.when(m == 0, "baseline").when(m == 1, "increase").otherwise("decrease").alias("direction"),
    ).agg(F.round(F.avg("l_quantity"), 4).alias("score")).withColumn("sign", F.when(F.endswith("p_brand", F.lit("1")), "+").otherwise("-"))
    return rounded(do.direction_consistency(d, ["p_brand"]))


# --- sensitivity of the permutation test to the feature definition -----------------------
_SX = ["PG_pause_p90", "PG_resp_gap_mean", "IX_yesno_rate", "RESP_NE_ENTROPY", "IX_oirmarker_rate"]
_SCORE_SQL = f"SELECT conversation_id, speaker_id, (speaker_id::BIGINT * 37 % 101)::DOUBLE / 10 + count(*) / 10 AS score FROM ({UTT_TIMED}) GROUP BY 1, 2"


def _scores(spark, sf):
    return utt_timed(spark, sf).groupBy(*KEYS).agg(
        ((F.col("speaker_id").cast("long") * 37 % 101).cast("double") / 10 + F.count(F.lit(1)) / 10).alias("score"))


def _sens_sql(kind, col, conditions, variants):
    parts = []
    for c in conditions:
        src = f"SELECT conversation_id || '/' || speaker_id AS id, score AS y, {', '.join(q(x).replace(chr(39), chr(34)) for x in _SX)} FROM ({variants}) JOIN ({_SCORE_SQL}) USING (conversation_id, speaker_id) WHERE {col} = {q(c) if isinstance(c, str) else c}"
        src = f"SELECT *, ({POS}) % {K} AS fold, {POS} AS pos FROM ({src})"
        parts.append(f"SELECT '{kind}' AS analysis_type, '{c}' AS condition, outcome, r_foldmean AS r_obs, p_value FROM ({sql_test(sql_permuted(src, _SX, n_perm=N_PERM), 'm', 'score', 5)})")
    return _union_all(parts)


def _sens(spark, sf, kind, col, conditions, varying, **kw):
    v = ft.extract_feature_variants(utt_timed(spark, sf), **kw)
    v = rounded(v).select(*KEYS, col, *_SX)
    return rounded(st.variant_sensitivity(v, _scores(spark, sf), col, conditions, KEYS, _SX, "score", kind, N_PERM, K, SEED, varying=varying))


_TOLS = ft.GAP_TOLERANCES


@query("g28_gap_tol_sensitivity", _sens_sql("gap_tol", "gap_tol", _TOLS, _variant_sql({"words": WORDS}, _TOLS)))
def gap_tol_sensitivity(spark, sf):
    return _sens(spark, sf, "gap_tol", "gap_tol", _TOLS, ["PG_pause_p90", "PG_resp_gap_mean"], gap_tols=_TOLS, lexicons={"words": WORDS})


@query("g29_yesno_list_sensitivity", _sens_sql("yesno_list", "lexicon", list(YESNO_VARIANTS), _variant_sql(YESNO_VARIANTS, [0.05])))
def yesno_sensitivity(spark, sf):
    return _sens(spark, sf, "yesno_list", "lexicon", list(YESNO_VARIANTS), ["IX_yesno_rate"], lexicons=YESNO_VARIANTS)


@query("g30_particle_rule_sensitivity", _sens_sql("ne_yo_match", "lexicon", list(RULE_VARIANTS), _variant_sql(RULE_VARIANTS, [0.05])))
def rule_sensitivity(spark, sf):
    return _sens(spark, sf, "ne_yo_match", "lexicon", list(RULE_VARIANTS), ["RESP_NE_ENTROPY"], lexicons=RULE_VARIANTS)
