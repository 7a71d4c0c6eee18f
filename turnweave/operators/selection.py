"""Record selection: sampling frame, quality filters, candidate scores, funnel."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import JA, Lexicon
from ..runtime import materialize
from . import columns as cl
from . import skew
from .turns import CONV, KEYS, SPK, conform_utterances, turn_pairs

# --- fixed values -----------------------------------------------------------
HOME = "自宅"
POSITIVE_KEYWORDS = (
    "自宅", "雑談", "食事", "休息", "家族", "友人", "買い物", "移動", "夕食", "朝食",
    "昼食", "くつろ", "子ども", "子供",
)
NEGATIVE_KEYWORDS = (
    "会議", "打合せ", "授業", "レッスン", "講義", "職場", "学校", "研究", "面接",
    "インタビュー", "病院", "歯科", "発表", "プレゼン",
)
CONVLIST_TEXT = ("会話概要", "形式", "場所", "活動", "話者間の関係性")
SCENE_PREFIX = "W"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Quality:
    """Lower bounds a record has to reach."""

    n_pairs_total: int = 80
    FILL_text_len: int = 2000
    IX_n_pairs_after_question: int = 10

    def condition(self) -> Column:
        return cl.all_of([F.col(k) >= v for k, v in vars(self).items() if v])


STRICT = Quality()
MODELLING = Quality(20, 800, 0)
MIN_MODELLING_ROWS = 5


def sampling_frame(convlist: DataFrame, n_speakers: int = 2, place: str = HOME) -> DataFrame:
    """Distinct ids of conversations held at the place with n speakers."""
    cid = cl.first_present(convlist, cl.CONVERSATION_ID_NAMES, "conversation id")
    where = cl.first_present(convlist, cl.PLACE_NAMES, "place")
    if "speaker_n" in convlist.columns:
        size = F.col("speaker_n")
    else:
        size = cl.leading_int(F.col(cl.first_present(convlist, cl.SPEAKER_COUNT_NAMES, "speaker count")))
    return (
        convlist.filter(F.contains(F.col(where).cast("string"), F.lit(place)) & (size == n_speakers))
        .select(F.col(cid).cast("string").alias(CONV))
        .filter(F.col(CONV).isNotNull())
        .distinct()
    )


def pair_counts(
    utterances: DataFrame, lex: Lexicon = JA, rows_per_task: int = skew.ROWS_PER_TASK
) -> DataFrame:
    """Turn pairs per responder: total and after a question."""
    pairs = turn_pairs(utterances, lex, rows_per_task)
    return pairs.groupBy(CONV, F.col("resp_speaker_id").alias(SPK)).agg(
        F.count(F.lit(1)).alias("n_pairs_total"),
        F.count_if(F.col("prev_is_question")).alias("IX_n_pairs_after_question"),
    )


def candidates(
    utterances: DataFrame,
    conversations: DataFrame,
    lex: Lexicon = JA,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Text length and pair counts per record; records without pairs get 0."""
    utt = conform_utterances(utterances).join(conversations.select(CONV), CONV, "left_semi")
    length = utt.groupBy(*KEYS).agg(F.sum(tx.length_without_blank(F.col("text"))).alias("FILL_text_len"))
    return length.join(pair_counts(utt, lex, rows_per_task), KEYS, "left").na.fill(
        0, ["n_pairs_total", "IX_n_pairs_after_question"]
    )


def target_pairs(cands: DataFrame, quality: Quality = STRICT) -> DataFrame:
    return cands.filter(quality.condition()).select(*KEYS).distinct()


def modelling_rows(features: DataFrame, quality: Quality = MODELLING) -> DataFrame:
    """The looser filter used before fitting; too few rows is an error."""
    kept = materialize(features.filter(quality.condition()))  # counted, then used
    n = kept.limit(MIN_MODELLING_ROWS).count()
    if n < MIN_MODELLING_ROWS:
        raise ValueError(f"too few rows after the filter: {n}")
    return kept


def candidate_scores(
    convlist: DataFrame,
    positive=POSITIVE_KEYWORDS,
    negative=NEGATIVE_KEYWORDS,
    text_columns=CONVLIST_TEXT,
    id_col: str = "会話ID",
    size_col: str = "話者数",
) -> DataFrame:
    """Keyword score of each conversation, its recording method and size."""
    blob = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_columns])
    scene = F.startswith(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(SCENE_PREFIX))
    n = cl.all_digits(F.col(size_col))
    hits = lambda words: sum((F.contains(blob, F.lit(w)).cast("int") for w in words), F.lit(0))
    bonus = F.when(n == 1, 4).when(n <= 3, 1).when(n >= 6, -2).otherwise(0)
    return convlist.select(
        "*",
        (hits(positive) - 2 * hits(negative) + F.when(scene, 0).otherwise(2) + bonus).alias("diary_score"),
        F.when(scene, "specific_scene").otherwise("personal_follow").alias("method"),
        n.alias("speaker_n"),
    )


def top_candidates(scored: DataFrame, k: int = 200, ties=("会話ID",)) -> DataFrame:
    return scored.orderBy(F.desc("diary_score"), F.asc("method"), *ties).limit(k)


def funnel(stages: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(name, rows, unit, reason) stages -> count and excluded per stage.

    `excluded` is the drop from the previous stage when both count the same
    unit (conversations, records) and 0 otherwise.
    """
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(i).alias("stage"), F.lit(name).alias("name"), F.lit(unit).alias("unit"),
            F.col("n"), F.lit(reason).alias("reason"),
        )
        for i, (name, df, unit, reason) in enumerate(stages, 1)
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    w = Window.partitionBy(F.lit(1)).orderBy("stage")  # one row per stage
    drop = F.when(F.lag("unit").over(w) == F.col("unit"), F.lag("n").over(w) - F.col("n"))
    return out.withColumn("excluded", F.coalesce(drop, F.lit(0)).cast("long"))
