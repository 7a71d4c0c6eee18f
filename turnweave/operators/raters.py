"""Rater answers and scores: normalising, resolving, reliability, agreement."""
from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE
from . import columns as cl
from .turns import CONV, KEYS, SPK

# --- fixed values: the answer scale -------------------------------------------
CHOICES = (
    "Very Inaccurate", "Moderately Inaccurate", "Neither Accurate nor Inaccurate",
    "Moderately Accurate", "Very Accurate",
)
CHOICES_V1 = (
    "Very Inaccurate", "Moderately Inaccurate", "Neither Accurate Nor Inaccurate",
    "Moderately Accurate", "Very Accurate",
)
NEUTRAL_ANSWERS = (
    "neither accurate nor inaccurate",
    "neither accurate nor inaccurate.",
    "neither accurate nor inaccurate,",
    "neither accurate nor inaccurate!",
    "neither accurate nor inaccurate?",
    "neither accurate nor inaccurate;",
    "neither accurate nor inaccurate:",
    "neither accurate nor inaccurate (neutral)",
    "neither accurate nor inaccurate (neither)",
    "neither accurate nor inaccurate (neither accurate nor inaccurate)",
)
TRAITS = ("O", "C", "E", "A", "N")
MIDPOINT = 2.0
# ----------------------------------------------------------------------------


def _collapse(c: Column) -> Column:
    spaced = F.translate(c, WHITESPACE, " " * len(WHITESPACE))
    return F.btrim(F.regexp_replace(spaced, " +", " "), F.lit(" "))


def _lookup(key: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise_choice_v1(raw: Column) -> Column:
    """Exact label, else the first scale label contained in the text."""
    def pick(t: Column) -> Column:
        out = F.when(t.isin(*CHOICES_V1), t)
        for c in CHOICES_V1:
            out = out.when(F.contains(F.lower(t), F.lit(c.lower())), c)
        return out

    return _let(_collapse(raw), pick)


def normalise_choice(raw: Column) -> Column:
    """First line, outer quotes removed, spaces collapsed; digits 0-4, labels
    in any case and decorated neutral labels map to the label, other text is
    kept as it is (invalid)."""
    def unquote(t: Column) -> Column:
        quoted = reduce(lambda a, b: a | b, [F.startswith(t, F.lit(c)) & F.endswith(t, F.lit(c)) for c in "\"'"])
        return F.when(quoted, F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)

    t = F.btrim(F.coalesce(raw, F.lit("")), F.lit(WHITESPACE))
    t = F.btrim(F.element_at(F.split(t, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", 2), 1), F.lit(WHITESPACE))
    known = {str(i): c for i, c in enumerate(CHOICES)}
    known |= {c.lower(): c for c in CHOICES}
    known |= {answer: CHOICES[2] for answer in NEUTRAL_ANSWERS}
    return _let(_collapse(_let(t, unquote)), lambda x: F.coalesce(_lookup(F.lower(x), known), x))


def is_valid(norm: Column) -> Column:
    return norm.isin(*CHOICES)


def choice_score(norm: Column, reverse: Column, labels=CHOICES) -> Column:
    """0..4, reverse-keyed as 4 - s, invalid -> NULL."""
    pairs = [F.lit(x) for i, c in enumerate(labels) for x in (c, float(i))]
    turned = reverse == 1
    return F.when(turned, 4.0).otherwise(0.0) + F.when(turned, -1.0).otherwise(1.0) * F.element_at(
        F.create_map(*pairs), norm
    )


def resolve_attempts(attempts: DataFrame, grid: DataFrame, on_fail: str = "neutral") -> DataFrame:
    """One score per (record, item): the first valid attempt, else the policy.

    `grid` lists every (record, item) with trait and reverse; `on_fail` is
    'neutral' (midpoint) or 'nan' (missing).
    """
    if on_fail not in ("neutral", "nan"):
        raise ValueError(f"on_fail must be 'neutral' or 'nan', got {on_fail!r}")
    a = attempts.withColumn("choice_norm", normalise_choice(F.col("choice_raw")))
    first = (
        a.filter(is_valid(F.col("choice_norm")))
        .groupBy(*KEYS, "item_id")
        .agg(F.min_by(F.struct("choice_raw", "choice_norm"), "attempt_i").alias("c"))
    )
    j = grid.join(first, [*KEYS, "item_id"], "left")
    found = F.col("c").isNotNull()
    neutral = on_fail == "neutral"
    norm = F.when(found, F.col("c.choice_norm")).otherwise(CHOICES[2] if neutral else "")
    return j.select(
        *KEYS, "item_id", "trait", "reverse",
        F.when(found, F.col("c.choice_raw")).otherwise("NEUTRAL_FALLBACK" if neutral else "").alias("choice_raw"),
        norm.alias("choice_norm"),
        choice_score(norm, F.col("reverse")).alias("score"),
    )


def trait_scores(items: DataFrame, by=("trait",)) -> DataFrame:
    return items.groupBy(*KEYS, *by).agg(F.avg("score").alias("trait_score"))


def items_of_trait(items: DataFrame, trait: str) -> DataFrame:
    col = cl.first_present(items, cl.TRAIT_NAMES, "trait")
    return items.filter(F.btrim(F.col(col).cast("string")) == trait)


def items_per_trait(items: DataFrame, expected: int = 24) -> DataFrame:
    col = cl.first_present(items, cl.TRAIT_NAMES, "trait")
    return items.groupBy(F.btrim(F.col(col).cast("string")).alias("trait")).agg(
        F.count(F.lit(1)).alias("n_items")
    ).withColumn("as_expected", F.col("n_items") == expected)


def item_matrix(items: DataFrame, item_ids: list) -> DataFrame:
    """Records x items, complete cases only; the item list is given, so no
    extra job looks for the pivot values."""
    wide = items.groupBy(*KEYS).pivot("item_id", list(item_ids)).agg(F.avg("score"))
    return wide.dropna(how="any", subset=[str(i) for i in item_ids])


def cronbach_alpha(items: DataFrame, by=("trait",), min_subjects: int = 2) -> DataFrame:
    """alpha = k/(k-1) (1 - sum item variances / variance of sums) on complete
    records. NULL for fewer than two items, too few records, or no variance.

    Long form: one aggregate per cell, one per record to find complete cases,
    then variances; no pivot, so the item count is open.
    """
    by = list(by)
    cell = items.groupBy(*by, *KEYS, "item_id").agg(F.avg("score").alias("s"))
    k = cell.groupBy(*by).agg(F.countDistinct(F.when(F.col("s").isNotNull(), F.col("item_id"))).alias("k_items"))
    record = (
        cell.groupBy(*by, *KEYS)
        .agg(F.sum("s").alias("total"), F.count("s").alias("answered"))
        .join(k, by)
    )
    complete = record.filter(F.col("answered") == F.col("k_items"))
    totals = complete.groupBy(*by).agg(
        F.var_samp("total").alias("total_var"), F.count(F.lit(1)).alias("n_complete")
    )
    subjects = record.groupBy(*by).agg(F.count_if(F.col("answered") > 0).alias("n_subjects"))
    item_var = (
        cell.join(complete.select(*by, *KEYS), [*by, *KEYS], "left_semi")
        .groupBy(*by, "item_id").agg(F.var_samp("s").alias("v"))
        .groupBy(*by).agg(F.sum("v").alias("item_var"))
    )
    out = k.join(subjects, by, "left").join(totals, by, "left").join(item_var, by, "left")
    kk = F.col("k_items").cast("double")
    ok = (F.col("k_items") >= 2) & (F.coalesce("n_complete", F.lit(0)) >= min_subjects) & (F.col("total_var") > 0)
    alpha = F.when(ok, F.try_divide(kk, kk - 1) * (1 - F.try_divide(F.col("item_var"), F.col("total_var"))))
    return out.select(
        *by, alpha.alias("alpha"), F.coalesce("n_subjects", F.lit(0)).alias("n_subjects"), "k_items",
        F.coalesce("n_complete", F.lit(0)).alias("n_complete"),
    )


def ensemble(scores: DataFrame, raters: list[str], rater_col: str = "teacher", value: str = "trait_score",
             keys=(*KEYS, "trait")) -> DataFrame:
    """Wide scores per rater, records present for every rater, and their mean."""
    wide = scores.groupBy(*keys).pivot(rater_col, list(raters)).agg(F.first(value, ignorenulls=True))
    names = [f"score_{t}" for t in raters]
    wide = wide.select(*keys, *[F.col(f"`{t}`").alias(n) for t, n in zip(raters, names)])
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return wide.dropna(subset=names).withColumn("trait_score", total / len(names))


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; NULL when either side has no variance.
    (`corr` raises on a zero denominator under ANSI mode.)"""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rater_agreement(scores: DataFrame, raters: list[str], by=("trait",), rater_col: str = "teacher",
                    value: str = "trait_score") -> DataFrame:
    """Pairwise Pearson r over records scored by all raters, one row per pair."""
    by = list(by)
    wide = ensemble(scores, raters, rater_col, value, keys=(*KEYS, *by))
    pairs = list(combinations(raters, 2))
    g = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[pearson(F.col(f"score_{a}"), F.col(f"score_{b}")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
    )
    rows = F.array(*[
        F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
    ])
    return g.select(*by, "n", F.explode(rows).alias("x")).select(*by, "n", "x.*")


def agreement_summary(pairs: DataFrame, by=("trait",)) -> DataFrame:
    """Mean off-diagonal r (the matrix is symmetric, so one triangle serves)."""
    return pairs.groupBy(*by).agg(F.max("n").alias("n"), F.avg("r").alias("mean_r"))


def agreement_per_rater(pairs: DataFrame, by=("trait",)) -> DataFrame:
    both = pairs.select(*by, F.explode(F.array("rater_a", "rater_b")).alias("rater"), "r")
    return both.groupBy(*by, "rater").agg(F.avg("r").alias("mean_r"))


def merge_check(scores: DataFrame, expected: int = 0, keys=(*KEYS, "trait")) -> DataFrame:
    """Rows, unique records and rows with a repeated key after a shard merge."""
    per_key = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    per_rec = per_key.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("dup")
    )
    out = per_rec.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_records"), F.sum("dup").alias("n_duplicated")
    )
    ok = (F.col("n_duplicated") == 0) & (F.lit(not expected) | (F.col("n_records") == expected))
    return out.withColumn("ok", ok)


def duplicate_keys(scores: DataFrame, keys=(*KEYS, "trait")) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def model_trait_means(scores: DataFrame, traits=TRAITS, model: str = "model_id") -> DataFrame:
    """Mean record score per model and trait, traits as columns."""
    rec = scores.groupBy(model, *KEYS, "trait").agg(F.avg("trait_score").alias("v"))
    return rec.groupBy(model).pivot("trait", list(traits)).agg(F.avg("v"))


def rater_spread(scores: DataFrame, model: str = "model_id") -> DataFrame:
    """Per trait: mean of record means and mean sd across models."""
    rec = scores.groupBy(*KEYS, "trait").agg(
        F.avg("trait_score").alias("m"), F.stddev_samp("trait_score").alias("sd")
    )
    return rec.groupBy("trait").agg(F.avg("m").alias("mean_score"), F.avg("sd").alias("mean_sd"))


def alpha_band(alpha: Column) -> Column:
    return F.when(alpha.isNull(), "NA").when(alpha >= 0.7, "high").when(alpha >= 0.5, "middle").otherwise("low")


def score_band(mean: Column) -> Column:
    return F.when(mean.isNull(), "NA").when(mean < 3.0, "low").when(mean > 3.4, "high").otherwise("middle")


def mean_over_raters(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])
