"""Per (conversation, speaker) interaction features.

All variants (gap tolerances, lexicons) come out of one pass: the tolerance
only enters final conditional aggregates and a lexicon only adds flag columns,
so a sensitivity study costs extra columns, not extra scans.
"""
from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.lexicon import JA, Lexicon
from ..runtime import materialize
from . import skew
from .turns import (
    CONV, KEYS, SPK, conform_utterances, has_turn_change, restrict_conversations,
    restrict_pairs, split_hot, with_previous,
)

# --- fixed values: column sets ----------------------------------------------
CLASSICAL = [
    "PG_speech_ratio", "PG_pause_mean", "PG_pause_p50", "PG_pause_p90",
    "PG_resp_gap_mean", "PG_resp_gap_p50", "PG_resp_gap_p90", "PG_overlap_rate",
    "FILL_has_any", "FILL_rate_per_100chars",
]
NOVEL = [
    "IX_oirmarker_rate", "IX_oirmarker_after_question_rate", "IX_yesno_rate",
    "IX_yesno_after_question_rate", "IX_lex_overlap_mean", "RESP_NE_AIZUCHI_RATE",
    "RESP_NE_ENTROPY", "RESP_YO_ENTROPY", "PG_pause_variability",
]
DEMOGRAPHICS = ["confound_gender", "confound_age"]
CONTROLS = [
    "n_pairs_total", "n_pairs_after_NE", "n_pairs_after_YO", "IX_n_pairs",
    "IX_n_pairs_after_question", "PG_total_time", "PG_resp_overlap_rate",
    "FILL_text_len", "FILL_cnt_total", "FILL_cnt_eto", "FILL_cnt_e", "FILL_cnt_ano",
    "IX_topic_drift_mean",
]
PREDICTORS = CLASSICAL + NOVEL
CATEGORY_ORDER = ["PG", "FILL", "IX", "RESP"]
GAP_TOLERANCES = [0.05, 0.1, 0.2, 0.3, 0.5, 1.0]
# ----------------------------------------------------------------------------

COUNTS = [
    "n_pairs_total", "n_pairs_after_NE", "n_pairs_after_YO", "IX_n_pairs",
    "IX_n_pairs_after_question", "FILL_text_len", "FILL_cnt_total", "FILL_cnt_eto",
    "FILL_cnt_e", "FILL_cnt_ano",
]


def utterance_facts(utt: DataFrame, lexicons: list[Lexicon], pieces: int = 0) -> DataFrame:
    """One narrow row per utterance: durations, filler counts, and for
    responses the gap, overlap and per-lexicon flags. Text ends here."""
    n = tx.Normalised
    text, tail = F.col("text"), F.col("tail")
    pre = utt.withColumn("text", tx.norm_text(text)).withColumn("tail", tx.strip_tail(text))
    pre = pre.select(
        *KEYS, "utt_seq", "text", "start_time", "end_time",
        *[n.particle(text, tail, lex).alias(f"sfp{i}") for i, lex in enumerate(lexicons)],
        *[n.asks(text, tail, lex).alias(f"q{i}") for i, lex in enumerate(lexicons)],
    )
    carry = ["text"] + [f"{c}{i}" for i in range(len(lexicons)) for c in ("sfp", "q")]
    pre = with_previous(pre, carry, pieces)
    pre = pre.withColumn("pair", has_turn_change()).withColumn("solid", tx.without_space(text))
    pair = F.col("pair")
    pre = pre.withColumns({
        "own_grams": F.when(pair, tx.bigrams_of(F.col("solid"))),
        "prev_grams": F.when(pair, tx.bigrams_of(tx.without_space(F.col("prev.text")))),
        "token": n.head_token(text),
    })
    cols = [
        *[F.col(k) for k in KEYS], "start_time", "end_time",
        F.greatest(F.col("end_time") - F.col("start_time"), F.lit(0.0)).alias("speech"),
        (F.col("start_time") - F.col("own_prev_end")).alias("pause"),
        F.length("solid").alias("chars"),
        "pair",
        F.when(pair, F.col("start_time") - F.col("prev.end_time")).alias("gap"),
        F.when(pair, tx.jaccard(F.col("prev_grams"), F.col("own_grams"))).alias("overlap"),
    ]
    for i, lex in enumerate(lexicons):
        sfp = F.col(f"prev.sfp{i}")
        kind = F.when(pair & sfp.isin("NE", "NE_Q"), "NE").when(pair & (sfp == "YO"), "YO")
        fills = n.fillers(text, lex)
        cols += [
            kind.alias(f"kind{i}"),
            F.when(kind.isNotNull(), F.when(F.col("token") == "", "<EMPTY>").otherwise(F.col("token")))
            .alias(f"tok{i}"),
            (pair & F.col(f"prev.q{i}")).alias(f"afterq{i}"),
            tx.prefix_any(text, lex.aizuchi).cast("double").alias(f"aiz{i}"),
            tx.prefix_any(text, lex.yesno).cast("double").alias(f"yn{i}"),
            tx.prefix_any(text, lex.oir).cast("double").alias(f"oir{i}"),
            *[fills[k].alias(f"{k}{i}") for k in ("eto", "e", "ano")],
        ]
    return pre.select(*cols)


def _tol(t: int, name: str) -> Column:
    return F.col(f"{name}_t{t}")


def _plain_aggregates(tols: list[float], n_lex: int) -> list[Column]:
    """Aggregates that combine map-side."""
    pair = F.col("pair")
    aggs = [
        F.min("start_time").alias("first_start"),
        F.max("end_time").alias("last_end"),
        F.coalesce(F.sum("speech"), F.lit(0.0)).alias("speech"),
        F.sum("chars").alias("chars"),
        F.count_if(pair).alias("n_pairs"),
        F.avg("overlap").alias("overlap"),
    ]
    for t, tol in enumerate(tols):
        kept_pause = F.when(F.col("pause") >= tol, F.col("pause"))
        kept_gap = F.when(F.col("gap") >= tol, F.col("gap"))
        aggs += [
            F.count(kept_pause).alias(f"pause_n_t{t}"),
            F.avg(kept_pause).alias(f"pause_mean_t{t}"),
            F.stddev_samp(kept_pause).alias(f"pause_sd_t{t}"),
            F.avg(kept_gap).alias(f"gap_mean_t{t}"),
            F.avg(F.when(pair, F.when(F.col("gap") < -tol, 1.0).otherwise(0.0).cast("double"))).alias(
                f"overlap_rate_t{t}"
            ),
        ]
    for i in range(n_lex):
        kind, afterq = F.col(f"kind{i}"), F.col(f"afterq{i}")
        fills = F.col(f"eto{i}") + F.col(f"e{i}") + F.col(f"ano{i}")
        aggs += [
            F.count_if(kind == "NE").alias(f"n_ne{i}"),
            F.count_if(kind == "YO").alias(f"n_yo{i}"),
            F.count_if(afterq).alias(f"n_q{i}"),
            F.avg(F.when(kind == "NE", F.col(f"aiz{i}"))).alias(f"ne_aiz{i}"),
            F.avg(F.when(pair, F.col(f"oir{i}"))).alias(f"oir{i}"),
            F.avg(F.when(pair, F.col(f"yn{i}"))).alias(f"yn{i}"),
            F.avg(F.when(afterq, F.col(f"oir{i}"))).alias(f"oir_q{i}"),
            F.avg(F.when(afterq, F.col(f"yn{i}"))).alias(f"yn_q{i}"),
            F.sum(f"eto{i}").alias(f"eto{i}"),
            F.sum(f"e{i}").alias(f"e{i}"),
            F.sum(f"ano{i}").alias(f"ano{i}"),
            F.avg((fills > 0).cast("double")).alias(f"fill_any{i}"),
        ]
    return aggs


def entropy_bits(n: Column, sum_log: Column) -> Column:
    """log2(N) - mean over rows of log2(count of the row's token)."""
    return F.when(n > 0, F.greatest(F.log2(n) - F.try_divide(sum_log, n), F.lit(0.0)))


def _whole_keys(facts: DataFrame, tols: list[float], n_lex: int) -> DataFrame:
    """Records small enough for one task: percentiles and token counts are
    taken inside the partitioning the turn windows already need."""
    d = facts
    for i in range(n_lex):
        same = Window.partitionBy(*KEYS, f"kind{i}", f"tok{i}")
        d = d.withColumn(
            f"logc{i}", F.when(F.col(f"kind{i}").isNotNull(), F.log2(F.count(F.lit(1)).over(same)))
        )
    aggs = _plain_aggregates(tols, n_lex)
    for t, tol in enumerate(tols):
        for name in ("pause", "gap"):
            v = F.when(F.col(name) >= tol, F.col(name))
            aggs.append(F.percentile(v, F.array(F.lit(0.5), F.lit(0.9))).alias(f"{name}_q_t{t}"))
    for i in range(n_lex):
        for kind in ("NE", "YO"):
            aggs.append(F.sum(F.when(F.col(f"kind{i}") == kind, F.col(f"logc{i}"))).alias(f"{kind}_log{i}"))
    g = d.groupBy(*KEYS).agg(*aggs)
    conv = Window.partitionBy(CONV)
    g = g.withColumn("conv_start", F.min("first_start").over(conv)).withColumn(
        "conv_end", F.max("last_end").over(conv)
    )
    for i in range(n_lex):
        g = g.withColumn(f"ne_ent{i}", entropy_bits(F.col(f"n_ne{i}"), F.col(f"NE_log{i}"))).withColumn(
            f"yo_ent{i}", entropy_bits(F.col(f"n_yo{i}"), F.col(f"YO_log{i}"))
        )
    for t in range(len(tols)):
        for name in ("pause", "gap"):
            g = g.withColumn(f"{name}_p50_t{t}", F.get(F.col(f"{name}_q_t{t}"), 0)).withColumn(
                f"{name}_p90_t{t}", F.get(F.col(f"{name}_q_t{t}"), 1)
            )
    return g


def _split_keys(facts: DataFrame, tols: list[float], n_lex: int) -> DataFrame:
    """Hot conversations: only map-side combinable aggregates, two-level token
    counts and histogram quantiles; nothing gathers a key.

    The facts (numbers and one token, no text) are written once: five
    aggregates read them.
    """
    facts = materialize(facts)
    g = facts.groupBy(*KEYS).agg(*_plain_aggregates(tols, n_lex))
    span = facts.groupBy(CONV).agg(
        F.min("start_time").alias("conv_start"), F.max("end_time").alias("conv_end")
    )
    g = g.join(span, CONV)
    for i in range(n_lex):
        tokens = (
            facts.filter(F.col(f"kind{i}").isNotNull())
            .groupBy(*KEYS, f"kind{i}", f"tok{i}")
            .agg(F.count(F.lit(1)).alias("c"))
        )
        ent = tokens.groupBy(*KEYS).agg(*[
            entropy_bits(
                F.sum(F.when(F.col(f"kind{i}") == k, F.col("c"))),
                F.sum(F.when(F.col(f"kind{i}") == k, F.col("c") * F.log2("c"))),
            ).alias(f"{k.lower()}_ent{i}")
            for k in ("NE", "YO")
        ])
        g = g.join(ent, KEYS, "left")
    kept = F.array(*[
        F.struct(F.lit(f"{name}_t{t}").alias("which"), F.when(F.col(name) >= tol, F.col(name)).alias("value"))
        for t, tol in enumerate(tols) for name in ("pause", "gap")
    ])
    long = facts.select(*KEYS, F.explode(kept).alias("x")).select(*KEYS, "x.*")
    q = skew.exact_quantiles(long, [*KEYS, "which"], "value", [0.5, 0.9], ["p50", "p90"])
    pick = lambda which, p: F.max(F.when(F.col("which") == which, F.col(p)))
    wide = q.groupBy(*KEYS).agg(*[
        pick(f"{name}_t{t}", p).alias(f"{name}_{p}_t{t}")
        for t in range(len(tols)) for name in ("pause", "gap") for p in ("p50", "p90")
    ])
    return g.join(wide, KEYS, "left")


def _record(t: int, i: int) -> list[Column]:
    total = F.col("conv_end") - F.col("conv_start")
    fills = F.col(f"eto{i}") + F.col(f"e{i}") + F.col(f"ano{i}")
    cols = {
        "n_pairs_total": F.col("n_pairs"),
        "n_pairs_after_NE": F.col(f"n_ne{i}"),
        "n_pairs_after_YO": F.col(f"n_yo{i}"),
        "IX_n_pairs": F.col("n_pairs"),
        "IX_n_pairs_after_question": F.col(f"n_q{i}"),
        "RESP_NE_AIZUCHI_RATE": F.col(f"ne_aiz{i}"),
        "RESP_NE_ENTROPY": F.col(f"ne_ent{i}"),
        "RESP_YO_ENTROPY": F.col(f"yo_ent{i}"),
        "IX_oirmarker_rate": F.col(f"oir{i}"),
        "IX_yesno_rate": F.col(f"yn{i}"),
        "IX_lex_overlap_mean": F.col("overlap"),
        "IX_topic_drift_mean": 1 - F.col("overlap"),
        "IX_oirmarker_after_question_rate": F.col(f"oir_q{i}"),
        "IX_yesno_after_question_rate": F.col(f"yn_q{i}"),
        "PG_total_time": total,
        "PG_speech_ratio": F.when(total > 0, F.try_divide(F.col("speech"), total)),
        "PG_pause_mean": _tol(t, "pause_mean"),
        "PG_pause_p50": _tol(t, "pause_p50"),
        "PG_pause_p90": _tol(t, "pause_p90"),
        "PG_pause_variability": F.when(
            (_tol(t, "pause_n") >= 2) & (_tol(t, "pause_mean") > 0),
            F.try_divide(_tol(t, "pause_sd"), _tol(t, "pause_mean")),
        ),
        "PG_resp_gap_mean": _tol(t, "gap_mean"),
        "PG_resp_gap_p50": _tol(t, "gap_p50"),
        "PG_resp_gap_p90": _tol(t, "gap_p90"),
        "PG_overlap_rate": _tol(t, "overlap_rate"),
        "PG_resp_overlap_rate": _tol(t, "overlap_rate"),
        "FILL_text_len": F.col("chars"),
        "FILL_cnt_total": fills,
        "FILL_cnt_eto": F.col(f"eto{i}"),
        "FILL_cnt_e": F.col(f"e{i}"),
        "FILL_cnt_ano": F.col(f"ano{i}"),
        "FILL_rate_per_100chars": F.try_divide(fills * 100.0, F.col("chars").cast("double")),
        "FILL_has_any": F.col(f"fill_any{i}"),
    }
    return [c.cast("long" if n in COUNTS else "double").alias(n) for n, c in cols.items()]


def extract_feature_variants(
    utterances: DataFrame,
    target_pairs: DataFrame | None = None,
    gap_tols: list[float] = (0.05,),
    lexicons: dict[str, Lexicon] | None = None,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """Feature rows for every (gap_tol, lexicon) pair, keyed by
    (conversation_id, speaker_id, gap_tol, lexicon)."""
    lexicons = lexicons or {"ja": JA}
    tols, names = list(gap_tols), list(lexicons)
    utt = conform_utterances(utterances)
    if target_pairs is not None:
        utt = restrict_conversations(utt, target_pairs)

    def job(rows: DataFrame, pieces: int) -> DataFrame:
        facts = utterance_facts(rows, list(lexicons.values()), pieces)
        build = _split_keys if pieces else _whole_keys
        g = build(facts, tols, len(names)).filter(F.col("n_pairs") > 0)
        variants = [
            F.struct(F.lit(float(tol)).alias("gap_tol"), F.lit(n).alias("lexicon"), *_record(t, i))
            for (t, tol), (i, n) in product(enumerate(tols), enumerate(names))
        ]
        if len(variants) == 1:
            return g.select(*KEYS, F.lit(float(tols[0])).alias("gap_tol"),
                            F.lit(names[0]).alias("lexicon"), *_record(0, 0))
        return g.select(*KEYS, F.explode(F.array(*variants)).alias("v")).select(*KEYS, "v.*")

    out = split_hot(utt, job, rows_per_task)
    return out if target_pairs is None else restrict_pairs(out, target_pairs)


def extract_features(
    utterances: DataFrame,
    target_pairs: DataFrame | None = None,
    gap_tol: float = 0.05,
    lex: Lexicon = JA,
    rows_per_task: int = skew.ROWS_PER_TASK,
) -> DataFrame:
    """32 feature columns, one row per responding speaker and conversation."""
    return extract_feature_variants(
        utterances, target_pairs, [gap_tol], {lex.name: lex}, rows_per_task
    ).drop("gap_tol", "lexicon")
