"""Long-form texts: line stores, counts, the shuffled condition and dose rewrites line by line."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linestore as ls
from ..operators import monologue as mo
from ..operators.turns import KEYS
from ..plans import line_doses as ld
from . import query
from .experiment_queries import _RING, ANNOTATED, DOSE, PROSE_RULES, _counts_sql
from .record_queries import MONOLOGUES
from .resampling_queries import SEED
from .views import utt_text


def _lines_sql(src, extra=""):
    return f"""SELECT conversation_id, speaker_id{extra}, i - 1 AS line, ls[i] AS text FROM (
  SELECT *, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM ({src}))"""


def store(spark, sf):
    return ls.line_store(utt_text(spark, sf))


def annotated_lines(spark, sf):
    return store(spark, sf).lines.withColumn("text", F.replace("text", F.lit(". "), F.lit(" (F the). ")))


@query("e2_lines", _lines_sql(MONOLOGUES))
def lines(spark, sf):
    return store(spark, sf).lines.select(*KEYS, "line", "text")


@query("e2_line_records", f"SELECT conversation_id, speaker_id, n_utt, n_chars, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM ({MONOLOGUES})")
def line_records(spark, sf):
    return store(spark, sf).records


@query("a13_line_shards", f"""SELECT conversation_id, speaker_id, n_chars,
  (row_number() OVER (ORDER BY conversation_id, speaker_id) - 1) // 10 AS shard FROM ({MONOLOGUES})""")
def line_shards(spark, sf):
    return mo.shard(store(spark, sf).records, 10).select(*KEYS, "n_chars", "shard")


@query("a15_line_preview", f"""SELECT conversation_id, speaker_id, n_chars, n_utt, substr(replace(text, chr(10), ' '), 1, 200) AS head200
  FROM ({MONOLOGUES}) ORDER BY n_chars DESC, conversation_id, speaker_id LIMIT 200""")
def line_preview(spark, sf):
    made = store(spark, sf)
    top = made.records.orderBy(F.desc("n_chars"), *KEYS).limit(200)
    return ls.line_heads(made.lines.join(F.broadcast(top.select(*KEYS)), KEYS, "left_semi")).join(top, KEYS).select(*KEYS, "n_chars", "n_utt", "head200")


@query("f18_line_counts", f"""SELECT conversation_id, speaker_id, "FILL_count"::BIGINT AS "FILL_count", "YESNO_count"::BIGINT AS "YESNO_count",
  "OIR_count"::BIGINT AS "OIR_count", n_lines::BIGINT AS n_lines, n_chars::BIGINT AS n_chars FROM ({_counts_sql(ANNOTATED)})""")
def line_counts(spark, sf):
    return ld.text_counts(annotated_lines(spark, sf), PROSE_RULES)


@query("c14_h1_shuffle_lines", _lines_sql(f"SELECT a.conversation_id, a.speaker_id, b.text FROM ({_RING}) a JOIN ({_RING}) b ON b.p = (a.p + 1) % a.n"))
def shuffle_lines(spark, sf):
    return ld.shuffle_lines(store(spark, sf), SEED)


@query("h5_dose_filler_lines", _lines_sql(DOSE["FILL"], ", dose_level"))
def filler_lines(spark, sf):
    return ld.filler_levels(annotated_lines(spark, sf), PROSE_RULES["FILL"], SEED)


@query("h6_dose_yesno_lines", _lines_sql(DOSE["YESNO"], ", dose_level"))
def yesno_lines(spark, sf):
    return ld.line_levels(annotated_lines(spark, sf), PROSE_RULES["YESNO"], SEED)


@query("h7_dose_repair_lines", _lines_sql(DOSE["OIR"], ", dose_level"))
def repair_lines(spark, sf):
    return ld.line_levels(annotated_lines(spark, sf), PROSE_RULES["OIR"], SEED)
