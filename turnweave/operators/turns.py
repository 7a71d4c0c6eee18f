"""Turn-taking windows: adjacency pairs, own pauses, response gaps."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import JA, Lexicon
from . import skew

CONV = "conversation_id"
SPK = "speaker_id"
KEYS = [CONV, SPK]


def turn_order() -> list[Column]:
    """(start, end, utt_seq), missing times last; utt_seq breaks ties."""
    return [
        F.col("start_time").asc_nulls_last(),
        F.col("end_time").asc_nulls_last(),
        F.col("utt_seq").asc(),
    ]


def _order_struct() -> Column:
    return F.struct(
        F.col("start_time").isNull(), F.col("start_time"),
        F.col("end_time").isNull(), F.col("end_time"), F.col("utt_seq"),
    )


def conform_utterances(df: DataFrame) -> DataFrame:
    """Keys to string, text NULL -> '', times to double (NaN -> NULL)."""
    def seconds(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("double").alias(name)
        v = F.expr(f"try_cast(`{name}` AS double)")
        return F.when(~F.isnan(v), v).alias(name)

    return df.select(
        F.col(CONV).cast("string").alias(CONV),
        F.col(SPK).cast("string").alias(SPK),
        F.col("utt_seq").cast("long").alias("utt_seq"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        seconds("start_time"),
        seconds("end_time"),
    )


def restrict_conversations(utt: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keep whole conversations of the target pairs, partner turns included."""
    conv = pairs.select(F.col(CONV).cast("string").alias(CONV)).distinct()
    return utt.join(conv, CONV, "left_semi")


def restrict_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keep only the target (conversation, speaker) records."""
    keep = pairs.select(*[F.col(k).cast("string").alias(k) for k in KEYS]).distinct()
    return df.join(keep, KEYS, "left_semi")


def with_previous(utt: DataFrame, carry: list[str], pieces: int = 0) -> DataFrame:
    """Add `prev` (speaker, end and `carry` of the previous turn of the
    conversation) and `own_prev_end` (end of the speaker's own previous turn).

    One exchange on conversation_id serves both windows and everything grouped
    by (conversation, speaker) after them. With `pieces`, conversations are cut
    into chunks of their order, and the first row of each chunk takes its
    predecessor from the small table of chunk tails.
    """
    part = [CONV, "chunk"] if pieces else [CONV]
    d = skew.order_chunks(utt, [CONV], turn_order(), pieces) if pieces else utt
    by_conv = Window.partitionBy(*part).orderBy(*turn_order())
    by_spk = Window.partitionBy(*part, SPK).orderBy(*turn_order())
    turn = F.struct(F.col(SPK), F.col("end_time"), *[F.col(c) for c in carry])
    own = F.struct(F.col("end_time"))
    out = d.withColumn("prev", F.lag(turn).over(by_conv)).withColumn(
        "own_prev", F.lag(own).over(by_spk)
    )
    if pieces:
        out = _stitch(out, d, turn, "prev", [CONV])
        out = _stitch(out, d, own, "own_prev", KEYS)
        out = out.drop("chunk")
    return out.withColumn("own_prev_end", F.col("own_prev.end_time")).drop("own_prev")


def _stitch(out: DataFrame, d: DataFrame, value: Column, name: str, keys: list[str]) -> DataFrame:
    tails = d.groupBy(*keys, "chunk").agg(F.max_by(value, _order_struct()).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("chunk")
    tails = tails.select(*keys, "chunk", F.lag("_tail").over(before).alias("_tail"))
    return (
        out.join(tails, [*keys, "chunk"], "left")
        .withColumn(name, F.coalesce(F.col(name), F.col("_tail")))
        .drop("_tail")
    )


def has_turn_change() -> Column:
    return F.col("prev").isNotNull() & (F.col(f"prev.{SPK}") != F.col(SPK))


def turn_pairs(utt: DataFrame, lex: Lexicon = JA, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Adjacency pairs: one row per response whose previous turn is another
    speaker's, with the previous text, its class and the two times."""
    def pairs(d: DataFrame, pieces: int) -> DataFrame:
        d = d.withColumn("sfp", tx.sfp_group(F.col("text"), lex)).withColumn(
            "question", tx.is_question(F.col("text"), lex)
        )
        return with_previous(d, ["text", "sfp", "question"], pieces).filter(has_turn_change()).select(
            CONV,
            F.col(f"prev.{SPK}").alias("prev_speaker_id"),
            F.col(SPK).alias("resp_speaker_id"),
            "utt_seq",
            F.col("prev.text").alias("prev_text"),
            F.col("text").alias("resp_text"),
            F.col("prev.sfp").alias("prev_sfp_group"),
            F.col("prev.question").alias("prev_is_question"),
            F.col("prev.end_time").alias("prev_end"),
            F.col("start_time").alias("resp_start"),
            (F.col("start_time") - F.col("prev.end_time")).alias("gap"),
        )

    return split_hot(utt, pairs, rows_per_task)


def split_hot(utt: DataFrame, job, rows_per_task: int) -> DataFrame:
    """Run `job(rows, 0)` on the normal conversations and, if any exist,
    `job(rows, pieces)` on the hot ones, and put the results together."""
    hot = skew.hot_keys(utt, [CONV], rows_per_task)
    size = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if not size["keys"]:
        return job(utt, 0)
    normal, crowded = skew.split_on(utt, [CONV], hot, size["keys"])
    return job(normal, 0).unionByName(job(crowded, skew.pieces_for(size["rows"], rows_per_task)))


def own_pauses(utt: DataFrame, gap_tol: float = 0.05, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """Pauses between a speaker's own consecutive turns, at least gap_tol."""
    def pauses(d: DataFrame, pieces: int) -> DataFrame:
        return with_previous(d.drop("text"), [], pieces).select(
            *KEYS, "utt_seq", (F.col("start_time") - F.col("own_prev_end")).alias("pause")
        )

    return split_hot(utt, pauses, rows_per_task).filter(F.col("pause") >= gap_tol)
