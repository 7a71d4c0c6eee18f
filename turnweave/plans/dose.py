"""Dose experiments: rewrite a record's text to less or more of one feature.

Row-wise rewrites are array expressions over the record's lines. Filler
insertion explodes a record into pieces and draws; everything after the one
partitioning by record stays in it.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.hashing import hash_key, hash_uint32
from ..functions.lexicon import AIZUCHI_PREFIXES, FILLER_ANO, FILLER_E, FILLER_ETO, OIR_PREFIXES, YESNO_PREFIXES
from ..operators import ranks as rk
from ..operators.turns import KEYS

# --- fixed values: annotation mask, replacement maps ----------------------------
LEVELS = (0, 1, 3)
ANNOTATION = r"\([LFDWG][^)]*\)|\([0-9]+\.?[0-9]*\)"
PLACEHOLDER_LENGTH = 11
FILLER_NEUTRAL = (("えっと", "それで"), ("えと", "それ"), ("え(ー+|ぇ+|〜+)", "で$1"), ("あの", "その"))
FILLER_INSERTIONS = ("えっと", "えー", "あの")
COMMA = "、"
YESNO_NEUTRAL = {
    "はい": "ほう", "うん": "ふーん", "ええ": "へえ", "そうです": "なるほど", "そう": "ふむ",
    "もちろん": "なるほど", "了解": "ふむ", "OK": "ふむ", "オーケー": "なるほど", "いいえ": "ふーん",
    "いや": "ふむ", "ううん": "ふーん", "違う": "ふむ", "ちがう": "ふーん", "だめ": "ふむ",
    "無理": "ふむ", "そうじゃない": "なるほどね",
}
YESNO_CONVERT = {
    "そうそう": "そうです", "そっか": "そうです", "なるほど": "はい", "へえ": "ええ", "わかった": "はい",
    "わかりました": "はい", "あー": "うん", "ああ": "うん", "うーん": "うん",
}
OIR_NEUTRAL = {
    "え？": "ふむ", "えっ": "ふむ", "えっ？": "ふむ？", "ん？": "ふむ", "は？": "ふむ", "なに？": "ふーん",
    "何？": "ふむ", "もう一回": "なるほど", "もう一度": "なるほど", "どういうこと": "なるほどね",
    "どういう意味": "なるほどね", "聞こえ": "なるほ", "聞き取": "なるほ", "わから": "なるほ", "分から": "なるほ",
}
OIR_CONVERT = {
    "そうそう": "えっ", "そっか": "え？", "なるほど": "えっ", "へえ": "え？", "あー": "ん？", "ああ": "ん？",
    "うーん": "ん？",
}
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class FillerRules:
    eto: str = FILLER_ETO
    e: str = FILLER_E
    ano: str = FILLER_ANO
    neutral: tuple = FILLER_NEUTRAL
    insertions: tuple[str, ...] = FILLER_INSERTIONS
    comma: str = COMMA

    @property
    def any(self) -> str:
        return f"{self.eto}|{self.e}|{self.ano}"


@dataclass(frozen=True)
class LineRules:
    """Lines that start with a prefix: how to neutralise them, and which other
    backchannel lines can be turned into them."""

    prefixes: tuple[str, ...]
    neutral: tuple[tuple[str, str], ...]
    convert: tuple[tuple[str, str], ...]
    fallback: str = "ふむ"

    @classmethod
    def of(cls, prefixes, neutral: dict, convert: dict, backchannels, fallback: str = "ふむ"):
        ordered = tuple((p, convert[p]) for p in backchannels if p in convert)
        return cls(tuple(prefixes), tuple(neutral.items()), ordered, fallback)


FILL = FillerRules()
YESNO = LineRules.of(YESNO_PREFIXES, YESNO_NEUTRAL, YESNO_CONVERT, AIZUCHI_PREFIXES)
OIR = LineRules.of(OIR_PREFIXES, OIR_NEUTRAL, OIR_CONVERT, AIZUCHI_PREFIXES)
RULES = {"FILL": FILL, "YESNO": YESNO, "OIR": OIR}
COUNTERS = ("FILL_count", "YESNO_count", "OIR_count", "n_lines", "n_chars")


# --- counting -----------------------------------------------------------------
def mask(text: Column) -> Column:
    """Annotations replaced by one character no pattern matches."""
    return F.regexp_replace(text, ANNOTATION, "\u0000")


def count_fillers(text: Column, rules: FillerRules = FILL) -> Column:
    """Fillers outside annotations."""
    t = mask(F.coalesce(text, F.lit("")))
    return (
        F.regexp_count(t, F.lit(rules.eto))
        + F.regexp_count(F.regexp_replace(t, rules.eto, ""), F.lit(rules.e))
        + F.regexp_count(t, F.lit(rules.ano))
    )


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(tx.WHITESPACE))


def _starts(line: Column, prefixes) -> Column:
    return tx.prefix_any(_strip(line), prefixes)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def count_lines(text: Column, prefixes) -> Column:
    return F.size(F.filter(lines_of(text), lambda l: _starts(l, prefixes)))


def text_counts(text: Column, rules: dict = RULES) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    return {
        "FILL_count": count_fillers(t, rules["FILL"]),
        "YESNO_count": count_lines(t, rules["YESNO"].prefixes),
        "OIR_count": count_lines(t, rules["OIR"].prefixes),
        "n_lines": F.when(t == "", 0).otherwise(F.size(lines_of(t))),
        "n_chars": tx.length_without_space(t),
    }


# --- line rewrites (yes/no and repair markers) -----------------------------------
def _swap(line: Column, pairs, fallback: Column) -> Column:
    """First matching prefix replaced in the stripped line, else fallback."""
    s = _strip(line)
    out = None
    for prefix, new in pairs:
        hit = F.concat(F.lit(new), F.substring(s, F.lit(len(prefix) + 1), F.length(s)))
        cond = F.startswith(s, F.lit(prefix))
        out = F.when(cond, hit) if out is None else out.when(cond, hit)
    return out.otherwise(fallback)


def _rewrite_lines(rules: LineRules, seed: int, keys: list[str]) -> Column:
    """Array of (level, text, inserted, deleted) for the three levels."""
    neutral = dict(rules.neutral)
    longest = [(p, neutral.get(p, rules.fallback)) for p in sorted(rules.prefixes, key=len, reverse=True)]
    lines, count = F.col("_lines"), F.col("_count")
    less = F.array_join(F.transform(lines, lambda l: _swap(l, longest, l)), "\n")
    rank = lambda i: hash_key(seed, *[F.col(k) for k in keys], i)
    turned = lambda l: F.when(~_starts(l, rules.prefixes), _swap(l, rules.convert, F.lit(None).cast("string")))
    # Candidates carry their hash; the n-th smallest hash is the cut.
    needed = F.when(count > 0, 2 * count).otherwise(3)
    cand = F.transform(lines, lambda l, i: F.struct(
        F.when(turned(l).isNotNull(), rank(i)).alias("h"), turned(l).alias("new"), l.alias("old")))
    hashes = F.array_sort(F.filter(F.transform(F.col("_cand"), lambda c: c["h"]), lambda h: h.isNotNull()))
    cut = F.get(hashes, F.least(needed, F.size(hashes)) - 1)
    return less, cand, cut, needed, hashes


def _line_levels(df: DataFrame, rules: LineRules, seed: int) -> DataFrame:
    d = df.withColumn("_lines", lines_of(F.col("text"))).withColumn(
        "_count", count_lines(F.col("text"), rules.prefixes))
    less, cand, cut, needed, hashes = _rewrite_lines(rules, seed, KEYS)
    d = d.withColumn("_cand", cand).withColumn("_cut", cut).withColumn(
        "_n", F.least(needed, F.size(hashes)))
    more = F.array_join(F.transform(
        F.col("_cand"), lambda c: F.when(c["h"] <= F.col("_cut"), c["new"]).otherwise(c["old"])), "\n")
    empty = F.col("text") == ""
    zero = F.lit(0)
    levels = F.array(
        _level(0, F.when(F.col("_count") == 0, F.col("text")).otherwise(less), zero, F.col("_count")),
        _level(1, F.col("text"), zero, zero),
        _level(3, F.when(empty, "").otherwise(more), F.when(empty, 0).otherwise(F.col("_n")), zero),
    )
    return d.select(*KEYS, "n_utt", F.col("text").alias("original"), F.col("_count").alias("original_count"),
                    F.explode(levels).alias("x")).select(*KEYS, "n_utt", "original", "original_count", "x.*")


def _level(level: int, text: Column, inserted: Column, deleted: Column) -> Column:
    return F.struct(F.lit(level).alias("dose_level"), text.alias("text"),
                    inserted.cast("int").alias("inserted"), deleted.cast("int").alias("deleted"))


# --- filler rewrites -------------------------------------------------------------
def replace_fillers(text: Column, rules: FillerRules = FILL) -> Column:
    """Length-preserving neutral words outside annotations."""
    segments = F.regexp_extract_all(text, F.lit(rf"{ANNOTATION}|[^(]+|\("), 0)

    def neutral(s: Column) -> Column:
        plain = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules.neutral, s)
        return F.when(F.rlike(s, F.lit(f"^(?:{ANNOTATION})$")), s).otherwise(plain)

    return F.array_join(F.transform(segments, neutral), "")


def insert_fillers(df: DataFrame, rules: FillerRules = FILL, seed: int = 42) -> DataFrame:
    """About three times the fillers: 2n draws with replacement over the slots
    (line start, after a comma, after an annotation), or up to three line
    starts when there are none; line tails give back the inserted length.

    A record is exploded into its pieces (one slot each) and its draws; after
    the single partitioning by record, grouping by slot, by line and by record
    needs no further exchange.
    """
    d = df.repartition(*KEYS).withColumn("_count", count_fillers(F.col("text"), rules))
    cut = "\u0001"
    pieces = F.flatten(F.transform(lines_of(F.col("text")), lambda l, i: F.transform(
        F.when(_strip(l) == "", F.array(l)).otherwise(F.filter(
            F.split(F.regexp_replace(l, f"({ANNOTATION}|{rules.comma})", f"$1{cut}"), cut), lambda p: p != "")),
        lambda p, j: F.struct(i.alias("line"), j.alias("part"), p.alias("piece"), (_strip(l) == "").alias("blank")))))
    d = d.withColumn("_pieces", pieces)
    # every piece of a non-blank line is a slot: its own start
    d = d.withColumn("_slots", F.filter(
        F.transform(F.col("_pieces"), lambda p, i: F.struct(i.alias("at"), p["part"].alias("part"),
                                                            p["line"].alias("line"), p["blank"].alias("blank"))),
        lambda s: ~s["blank"]))
    ids = [F.col(k) for k in KEYS]
    n_slots = F.size("_slots")
    starts = F.filter(F.col("_slots"), lambda s: s["part"] == 0)
    some = F.slice(F.array_sort(F.transform(starts, lambda s: F.struct(
        hash_key(seed, "line", *ids, s["line"]).alias("h"), s["at"].alias("at")))), 1, 3)
    word = lambda *key: F.element_at(F.array(*[F.lit(w) for w in rules.insertions]),
                                     (hash_uint32(seed, "word", *ids, *key) % len(rules.insertions) + 1).cast("int"))
    many = F.transform(F.sequence(F.lit(1), F.greatest(2 * F.col("_count"), F.lit(1))), lambda i: F.struct(
        F.get(F.col("_slots"), (hash_uint32(seed, "slot", *ids, i) % F.greatest(n_slots, F.lit(1))).cast("int"))["at"].alias("at"),
        i.alias("draw"), word(i).alias("word")))
    few = F.transform(some, lambda s, i: F.struct(s["at"].alias("at"), (i + 1).alias("draw"), word(i + 1).alias("word")))
    none = F.array().cast("array<struct<at:int,draw:int,word:string>>")
    drawn = F.when(n_slots == 0, none).when(F.col("_count") > 0, many).otherwise(few)
    item = lambda at, draw, line, s: F.struct(at.cast("int").alias("at"), draw.cast("int").alias("draw"),
                                              line.cast("int").alias("line"), s.alias("s"))
    d = d.withColumn("_draws", drawn)
    items = F.concat(
        F.transform(F.col("_draws"), lambda x: item(x["at"], x["draw"], F.lit(None), x["word"])),
        F.transform(F.col("_pieces"), lambda p, i: item(i, F.lit(2147483647), p["line"], p["piece"])),
    )
    rows = d.select(*KEYS, F.explode(items).alias("x")).select(*KEYS, "x.*")
    # piece and its insertions, in draw order with the piece last
    part = rows.groupBy(*KEYS, "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("draw", "s"))), lambda x: x["s"]), "").alias("s"),
        F.max("line").alias("line"),
        F.sum(F.when(F.col("line").isNull(), F.length("s")).otherwise(0)).alias("added"),
    )
    line = part.groupBy(*KEYS, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), "").alias("s"),
        F.sum("added").alias("added"),
    )
    held = F.regexp_replace("s", ANNOTATION, "\u0000" * PLACEHOLDER_LENGTH)
    tail = F.length(F.regexp_extract(held, f"(?s)^(?:.*(?:\u0000|{rules.any}))?(.*)$", 1))
    record = Window.partitionBy(*KEYS)
    longest = record.orderBy(F.desc("held_length"), F.desc("line"))
    line = (
        line.withColumn("held_length", F.length(held))
        .withColumn("room", F.when(_strip(F.col("s")) == "", 0).otherwise(F.greatest(tail - 2, F.lit(0))))
        .withColumn("budget", F.sum("added").over(record))
        .withColumn("used", F.coalesce(F.sum("room").over(longest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("trim", F.least("room", F.greatest(F.col("budget") - F.col("used"), F.lit(0))))
        .withColumn("s", F.substring("s", F.lit(1), (F.length("s") - F.col("trim")).cast("int")))
    )
    texts = line.groupBy(*KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "s"))), lambda x: x["s"]), "\n").alias("new_text"))
    return d.select(*KEYS, "n_utt", "text", F.col("_count").alias("original_count"),
                    F.size("_draws").alias("n_draws")).join(texts, KEYS)


def _filler_levels(df: DataFrame, rules: FillerRules, seed: int) -> DataFrame:
    d = df.withColumn("_count", count_fillers(F.col("text"), rules))
    zero = F.lit(0)
    levels = F.array(
        _level(0, F.when(F.col("_count") == 0, F.col("text")).otherwise(replace_fillers(F.col("text"), rules)), zero, F.col("_count")),
        _level(1, F.col("text"), zero, zero),
    )
    low = d.select(*KEYS, "n_utt", F.col("text").alias("original"), F.col("_count").alias("original_count"),
                   F.explode(levels).alias("x")).select(*KEYS, "n_utt", "original", "original_count", "x.*")
    high = insert_fillers(df, rules, seed)
    grown = F.when(F.col("original_count") > 0, F.col("n_draws")).otherwise(count_fillers(F.col("new_text"), rules))
    high = high.select(*KEYS, "n_utt", F.col("text").alias("original"), "original_count",
                       F.lit(3).alias("dose_level"), F.col("new_text").alias("text"),
                       grown.cast("int").alias("inserted"), F.lit(0).alias("deleted"))
    return low.unionByName(high)


# --- the dose table ----------------------------------------------------------------
def one_digit(value: Column) -> Column:
    """A double from 4 to 2^50 as text with one decimal, like printf: the stored binary number is rounded, a tie to even.

    (`bround` and Java's formatter round the shortest decimal form instead: 28.05 is stored as a little more and prints 28.1.)
    """
    bits = 50  # such a double is a whole number of 2^-50
    whole = F.floor(value)
    scaled = ((value - whole) * float(1 << bits)).cast("bigint") * 10
    tenths, rest = F.shiftright(scaled, bits), scaled.bitwiseAND(F.lit((1 << bits) - 1))
    half = F.lit(1 << (bits - 1))
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    n = whole * 10 + tenths + up.cast("bigint")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def dose_table(monologues: DataFrame, feature: str, levels=LEVELS, rules: dict = RULES, seed: int = 42) -> DataFrame:
    """Rewritten text and log per (record, level)."""
    if feature not in rules:
        raise ValueError(f"unknown feature {feature!r}; known: {list(rules)}")
    bad = [l for l in levels if l not in LEVELS]
    if bad:
        raise ValueError(f"invalid dose levels {bad}; allowed: {list(LEVELS)}")
    d = monologues.select(*KEYS, "n_utt", F.coalesce("text", F.lit("")).alias("text"))
    rule = rules[feature]
    rows = _filler_levels(d, rule, seed) if feature == "FILL" else _line_levels(d, rule, seed)
    count = count_fillers(F.col("text"), rule) if feature == "FILL" else count_lines(F.col("text"), rule.prefixes)
    a, b = F.length("original"), F.length("text")
    pct = F.coalesce(F.try_divide(F.abs(b - a) * 100.0, a.cast("double")), F.lit(0.0))
    return rows.filter(F.col("dose_level").isin(*levels)).select(
        *KEYS, "dose_level", F.col("n_utt").cast("long").alias("n_utt"),
        tx.length_without_space(F.col("text")).cast("long").alias("n_chars"), "text",
        "original_count", count.alias("new_count"), "inserted", "deleted",
        a.alias("original_chars"), b.alias("new_chars"), (F.round(pct * 100.0, 0) / 100.0).alias("char_change_pct"),
        F.when(pct > 5.0, F.concat(F.lit("char_change "), one_digit(pct),
                                   F.lit("% exceeds ±5% limit"))).otherwise("").alias("warning"),
    )


def dose_log_summary(doses: DataFrame) -> DataFrame:
    return doses.groupBy("dose_level").agg(
        F.avg("char_change_pct").alias("mean_char_change"), F.count_if(F.col("warning") != "").alias("n_warnings"),
        F.count(F.lit(1)).alias("n_records"))


def verify_doses(original: DataFrame, doses: DataFrame, feature: str, rules: dict = RULES) -> DataFrame:
    """Mean of five counters before and after, per level."""
    def means(df: DataFrame, by: list[str]) -> DataFrame:
        counted = df.select(*by, *[c.cast("double").alias(n) for n, c in text_counts(F.col("text"), rules).items()])
        return counted.unpivot(by, list(COUNTERS), "feature_name", "v").groupBy(*by, "feature_name").agg(F.avg("v").alias("m"))

    base = means(original, []).select("feature_name", F.col("m").alias("o"))
    j = means(doses, ["dose_level"]).join(F.broadcast(base), "feature_name")  # five rows
    o, m = F.col("o"), F.col("m")
    return j.select(
        "dose_level", "feature_name", F.round(o, 4).alias("mean_original"), F.round(m, 4).alias("mean_manipulated"),
        F.round(m - o, 4).alias("delta"), F.round(F.coalesce(F.try_divide((m - o) * 100, o), F.lit(0.0)), 2).alias("delta_pct"),
        (F.col("feature_name") == f"{feature}_count").alias("is_target"))


def monotonic(report: DataFrame, by: list[str], order: str, value: str, sign: Column | int = 1) -> DataFrame:
    """Whether `value` never moves against the sign along `order`."""
    w = Window.partitionBy(*by).orderBy(order)  # one row per level
    step = (F.col(value) - F.lag(value).over(w)) * sign
    return report.withColumn("_step", step).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_levels"),
        F.coalesce(F.min(F.col("_step") >= 0), F.lit(True)).alias("monotonic"))


def side_effects(report: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    return report.filter(~F.col("is_target") & (F.abs("delta_pct") > threshold_pct))


# --- dose report ---------------------------------------------------------------------
def dose_report(results: DataFrame, baseline_level: int = 1, by: str = "trait") -> DataFrame:
    """results(target_feature, dose_level, trait, r_obs, ...) with the change
    from the baseline level and a signed-rank p across traits per level."""
    keys = ["target_feature"]
    base = results.filter(F.col("dose_level") == baseline_level).select(*keys, by, F.col("r_obs").alias("_base"))
    d = results.join(base, [*keys, by], "left")
    diffs = d.filter(F.col("_base").isNotNull() & (F.col("dose_level") != baseline_level)).select(
        *keys, "dose_level", (F.col("_base") - F.col("r_obs")).alias("diff"))
    n = diffs.groupBy(*keys, "dose_level").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("diff") != 0).alias("_moved"))
    w = rk.wilcoxon(diffs, [*keys, "dose_level"], "diff").select(*keys, "dose_level", "p_value")
    test = n.join(w, [*keys, "dose_level"], "left").filter(F.col("_n") >= 3).select(
        *keys, "dose_level", F.when(F.col("_moved") == 0, 1.0).otherwise(F.col("p_value")).alias("wilcoxon_p"))
    delta = F.col("r_obs") - F.coalesce("_base", F.lit(0.0))
    return d.join(test, [*keys, "dose_level"], "left").select(
        "target_feature", "dose_level", by, "r_obs", "p_value", "p_corrected",
        delta.alias("delta_r_vs_baseline"), "wilcoxon_p")


def dose_judgement(results: DataFrame, signs: DataFrame, by: list[str]) -> DataFrame:
    """Monotone in the direction of the expected sign ('+' or '-')?"""
    up = F.col("sign") == "+"
    j = results.join(signs, by)
    bad = ~F.col("sign").isin("+", "-")
    j = j.withColumn("sign", F.when(bad, F.raise_error(F.lit("sign must be '+' or '-'")).cast("string")).otherwise(F.col("sign")))
    m = monotonic(j.withColumn("_v", F.when(up, F.col("r_obs")).otherwise(-F.col("r_obs"))), [*by, "sign"], "dose_level", "_v")
    way = F.when(up, "increasing").otherwise("decreasing")
    return m.select(*by, "monotonic", way.alias("trend_direction"),
                    F.when(F.col("monotonic"), F.concat(F.lit("dose-response relationship detected ("), way, F.lit(")")))
                    .otherwise(F.concat(F.lit("no monotonic "), way, F.lit(" trend"))).alias("judgment"))


def specificity(report: DataFrame, target: str, control: str, threshold: float = 0.05) -> DataFrame:
    """Largest |change| of the target feature against the control feature."""
    big = lambda f: F.coalesce(F.max(F.when(F.col("target_feature") == f, F.abs("delta_r_vs_baseline"))), F.lit(0.0))
    g = report.agg(big(target).alias("target_max_delta"), big(control).alias("control_max_delta"))
    g = g.withColumn("specific", (F.col("target_max_delta") - F.col("control_max_delta")) > threshold)
    return g.withColumn("judgment", F.when(F.col("specific"), F.lit(f"the effect is specific to {target}"))
                        .otherwise(F.lit(f"no effect specific to {target}")))


def direction_consistency(scores: DataFrame, by: list[str]) -> DataFrame:
    """scores(by..., sign, direction, score) with direction baseline /
    increase / decrease: do both interventions move as the sign says?"""
    w = scores.groupBy(*by, "sign").pivot("direction", ["baseline", "increase", "decrease"]).agg(F.first("score"))
    inc = F.round(F.col("increase") - F.col("baseline"), 4)
    dec = F.round(F.col("decrease") - F.col("baseline"), 4)
    ok = F.when(F.col("sign") == "+", (inc > 0) & (dec < 0)).otherwise((inc < 0) & (dec > 0))
    return w.filter(F.col("baseline").isNotNull()).select(
        *by, "sign", "baseline", "increase", "decrease", inc.alias("delta_increase"), dec.alias("delta_decrease"),
        F.coalesce(ok, F.lit(False)).alias("direction_consistent"))
