"""Dose rewrites and text conditions on line stores: no cell holds a record.

The same draws and rules as the one-cell forms in `dose` and `conditions`, for
records of any size. Which lines turn is a selection of the n smallest hashes;
slot and draw numbers and the trim budget are running sums carried across range
pieces; words meet their slots in an equality join. An annotation ends with its
line at the latest.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_key, hash_uint32
from ..operators import skew
from ..operators.linestore import LineStore, pieces_of
from ..operators.turns import KEYS
from ..runtime import materialize
from . import dose as do
from .conditions import shuffle_mapping

LINE = [*KEYS, "line"]


def _level(rows: DataFrame, level: int, text: Column) -> DataFrame:
    return rows.select(*KEYS, F.lit(level).alias("dose_level"), "line", text.alias("text"))


def text_counts(lines: DataFrame, rules: dict = do.RULES) -> DataFrame:
    """The counters of every record from its lines."""
    from ..operators.linestore import counts

    text = F.col("text")
    per_line = {
        "FILL_count": do.count_fillers(text, rules["FILL"]),
        "YESNO_count": do._starts(text, rules["YESNO"].prefixes).cast("int"), "OIR_count": do._starts(text, rules["OIR"].prefixes).cast("int"),
        "n_lines": F.lit(1), "n_chars": do.tx.length_without_space(text), "_length": F.length(text),
    }
    out = counts(lines, per_line)
    blank = (F.col("n_lines") == 1) & (F.col("_length") == 0)  # the empty text has no lines
    return out.withColumn("n_lines", F.when(blank, 0).otherwise(F.col("n_lines"))).drop("_length")


def line_levels(lines: DataFrame, rules: do.LineRules, seed: int = 42, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """KEYS, dose_level, line, text: the lines of the three levels of a line rule (yes/no or repair markers)."""
    text, neutral = F.col("text"), dict(rules.neutral)
    longest = [(p, neutral.get(p, rules.fallback)) for p in sorted(rules.prefixes, key=len, reverse=True)]
    hit = do._starts(text, rules.prefixes)
    rows = materialize(lines.select(
        *LINE, "text", hit.alias("hit"), do._swap(text, longest, text).alias("less"),
        F.when(~hit, do._swap(text, rules.convert, F.lit(None).cast("string"))).alias("new"), hash_key(seed, *[F.col(k) for k in KEYS], F.col("line")).alias("h")))
    need = rows.groupBy(*KEYS).agg(F.count_if("hit").alias("c")).select(*KEYS, F.when(F.col("c") > 0, 2 * F.col("c")).otherwise(3).alias("n"))
    chosen = skew.smallest(rows.filter("new IS NOT NULL").select(*LINE, "h"), KEYS, "h", need, rows_per_task).select(*LINE, F.lit(True).alias("chosen"))
    more = rows.select(*LINE, "text", "new").join(chosen, LINE, "left")
    return _level(rows, 0, F.col("less")).union(_level(rows, 1, F.col("text"))).union(
        _level(more, 3, F.when(F.col("chosen"), F.col("new")).otherwise(F.col("text"))))


def filler_levels(lines: DataFrame, rules: do.FillerRules = do.FILL, seed: int = 42, rows_per_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """KEYS, dose_level, line, text: fillers neutralised, kept, and about tripled with the length given back at line tails."""
    text, cut = F.col("text"), "\u0001"
    ids = [F.col(k) for k in KEYS]
    blank = do._strip(text) == ""
    parts = F.filter(F.split(F.regexp_replace(text, f"({do.ANNOTATION}|{rules.comma})", f"$1{cut}"), cut), lambda p: p != "")
    rows = lines.select(*LINE, "text", blank.alias("blank"), F.when(blank, F.array(text)).otherwise(parts).alias("parts"), do.count_fillers(text, rules).alias("c"))
    slots = F.when(F.col("blank"), 0).otherwise(F.size("parts"))
    rows = materialize(rows)
    pieces = pieces_of(rows, rows_per_task)
    # The number of the line's first slot and of its first draw: running sums of arbitrary weights.
    rows = materialize(skew.carried_sums(rows, KEYS, [F.col("line")], {"slot0": slots, "draw0": 2 * F.col("c")}, pieces).drop("chunk"))
    totals = materialize(rows.groupBy(*KEYS).agg(F.sum(slots).alias("n_slots"), F.sum("c").alias("fillers")))
    word = lambda i: F.element_at(F.array(*[F.lit(w) for w in rules.insertions]), (hash_uint32(seed, "word", *ids, i) % len(rules.insertions) + 1).cast("int"))
    at = hash_uint32(seed, "slot", *ids, F.col("draw")) % F.col("n_slots")
    many = rows.filter("c > 0").join(totals, KEYS).filter("n_slots > 0")
    many = many.select(*KEYS, "n_slots", F.explode(F.sequence(F.col("draw0") + 1, F.col("draw0") + 2 * F.col("c"))).alias("draw"))
    many = many.select(*KEYS, at.alias("slot"), "draw", word(F.col("draw")).alias("word"))
    # Without fillers: the three line starts with the smallest hashes.
    starts = rows.filter("NOT blank").join(totals.filter("fillers = 0"), KEYS).select(*LINE, F.col("slot0").alias("slot"), hash_key(seed, "line", *ids, F.col("line")).alias("h"))
    few = skew.smallest(starts, KEYS, "h", totals.filter("fillers = 0").select(*KEYS, F.lit(3).alias("n")), rows_per_task)
    few = few.withColumn("draw", F.col("rank").cast("long")).select(*KEYS, "slot", "draw", word(F.col("draw")).alias("word"))
    drawn = many.union(few).groupBy(*KEYS, "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("draw", "word"))), lambda x: x["word"]), "").alias("words"))
    spots = rows.select(*LINE, "slot0", "blank", F.posexplode("parts").alias("j", "piece"))
    spots = spots.withColumn("slot", F.when(~F.col("blank"), F.col("slot0") + F.col("j")))
    spots = spots.join(drawn, [*KEYS, "slot"], "left")
    grown = spots.groupBy(*LINE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.concat(F.coalesce("words", F.lit("")), F.col("piece")).alias("s")))), lambda x: x["s"]), "").alias("s"),
        F.sum(F.coalesce(F.length("words"), F.lit(0))).alias("added"))
    held = F.regexp_replace("s", do.ANNOTATION, "\u0000" * do.PLACEHOLDER_LENGTH)
    tail = F.length(F.regexp_extract(held, f"(?s)^(?:.*(?:\u0000|{rules.any}))?(.*)$", 1))
    grown = grown.withColumn("held", F.length(held)).withColumn("room", F.when(do._strip(F.col("s")) == "", 0).otherwise(F.greatest(tail - 2, F.lit(0))))
    grown = materialize(grown)
    budget = grown.groupBy(*KEYS).agg(F.sum("added").alias("budget"))
    # Longest lines give back first: the room before a line, in an order of its own, is carried across pieces too.
    used = skew.carried_sums(grown, KEYS, [F.desc("held"), F.desc("line")], {"used": F.col("room")}, pieces).join(budget, KEYS)
    trim = F.least("room", F.greatest(F.col("budget") - F.col("used"), F.lit(0)))
    high = _level(used, 3, F.substring("s", F.lit(1), (F.length("s") - trim).cast("int")))
    return _level(rows, 0, do.replace_fillers(text, rules)).union(_level(rows, 1, text)).union(high)


def shuffle_lines(store: LineStore, seed: int = 42) -> DataFrame:
    """The lines of the shuffled condition: every record gets the lines of the record it is mapped to."""
    mapped = shuffle_mapping(store.records, seed).select(*KEYS, *[f"assigned_{k}" for k in KEYS])
    lines = store.lines.select(*[F.col(k).alias(f"assigned_{k}") for k in KEYS], "line", "text")
    return lines.join(mapped, [f"assigned_{k}" for k in KEYS]).select(*LINE, "text")
