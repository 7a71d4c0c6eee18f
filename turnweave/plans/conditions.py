"""Text conditions: own text, summary only, another record's text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import hash_key
from ..functions.lexicon import JA, Lexicon
from ..operators.skew import hash_positions
from ..operators.turns import CONV, KEYS, conform_utterances, restrict_pairs

# --- fixed values: labels -----------------------------------------------------
CONTENT = "テキスト内容依存"
SURFACE = "表層統計量依存の可能性"
CONTRIBUTES = "テキスト内容が寄与"
CONDITION_ORDER = ("text", "summary", "random")
# ----------------------------------------------------------------------------


def shuffle_mapping(records: DataFrame, seed: int = 42) -> DataFrame:
    """Every record is assigned the next record in a random cyclic order: a
    one-to-one map without fixed points."""
    n = records.count()
    if n < 2:
        raise ValueError(f"a derangement needs at least 2 records, got {n}")
    keys = records.select(*KEYS)
    ring = hash_positions(keys, hash_key(seed, *[F.col(k) for k in KEYS]), KEYS, "original_index")
    ring = ring.withColumn("original_index", F.col("original_index") - 1)
    other = ring.select(
        F.col("original_index").alias("assigned_index"), *[F.col(k).alias(f"assigned_{k}") for k in KEYS])
    return ring.withColumn("assigned_index", (F.col("original_index") + 1) % n).join(other, "assigned_index")


def shuffle_texts(monologues: DataFrame, seed: int = 42) -> DataFrame:
    """Records with the text of the record they are mapped to."""
    texts = monologues.select(*[F.col(k).alias(f"assigned_{k}") for k in KEYS], "text")
    m = shuffle_mapping(monologues, seed)
    return m.join(texts, [f"assigned_{k}" for k in KEYS]).select(*KEYS, "text")


def summary_stats(utterances: DataFrame, lex: Lexicon = JA) -> DataFrame:
    """Utterances, mean length, fillers per record and the conversation's
    duration; missing times count as 0. Both aggregates combine map-side, the
    duration one reads three columns."""
    utt = conform_utterances(utterances)
    stats = utt.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_utt"),
        F.avg(tx.length_without_space(F.col("text"))).alias("mean_chars"),
        F.sum(tx.filler_count_simple(F.col("text"), lex)).alias("filler_count"),
    )
    zero = F.lit(0.0)
    span = utt.groupBy(CONV).agg(
        (F.max(F.coalesce("end_time", zero)) - F.min(F.coalesce("start_time", zero))).alias("duration_sec"))
    return stats.join(span, CONV)


def summary_texts(utterances: DataFrame, monologues: DataFrame, lex: Lexicon = JA) -> DataFrame:
    """Summary sentences for the records that have a monologue."""
    s = restrict_pairs(summary_stats(utterances, lex), monologues)
    return s.select(*KEYS, tx.summary_sentence(
        F.col("n_utt"), F.col("mean_chars"), F.col("duration_sec"), F.col("filler_count")).alias("text"))


def condition_label(r1: Column, r2: Column, r3: Column, threshold: float = 0.1) -> Column:
    """Own text r1, summary r2, other text r3; the first rule that holds."""
    d12, d13, d23 = F.abs(r1 - r2), F.abs(r1 - r3), F.abs(r2 - r3)
    return (
        F.when(r1.isNull() | r2.isNull() | r3.isNull(), "N/A")
        .when((d12 >= threshold) & (d13 >= threshold), CONTENT)
        .when(d12 < threshold, SURFACE)
        .when(d23 < threshold, CONTRIBUTES)
        .otherwise("N/A")
    )


def compare_conditions(results: DataFrame, threshold: float = 0.1, by: str = "trait") -> DataFrame:
    """results(condition, trait, r_obs, p_value, p_corrected) -> difference to
    the own-text condition, a label per trait and the display order."""
    wide = results.groupBy(by).pivot("condition", list(CONDITION_ORDER)).agg(F.first("r_obs"))
    labels = wide.select(by, F.col("text").alias("_r1"),
                         condition_label(*[F.col(c) for c in CONDITION_ORDER], threshold).alias("label"))
    order = F.array_position(F.array(*[F.lit(c) for c in CONDITION_ORDER]), F.col("condition"))
    delta = F.when(F.col("condition") == "text", 0.0).otherwise(F.col("_r1") - F.col("r_obs"))
    return results.join(labels, by).select(
        "condition", by, "r_obs", "p_value", "p_corrected", delta.alias("delta_r_vs_text"), "label",
        F.when(order > 0, order - 1).otherwise(len(CONDITION_ORDER)).alias("condition_rank"),
    )
