"""Audits of result tables: key sets, expected values, feature sets."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import DEMOGRAPHICS, PREDICTORS


def compare_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are common, only left, only right."""
    l = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    r = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return l.join(r, keys, "full_outer").agg(
        F.count_if(F.col("_l") & F.col("_r")).alias("common"),
        F.count_if(F.col("_l") & F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_r") & F.col("_l").isNull()).alias("right_only"),
    )


def expected_values(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Stated values against results, rounded to the precision they are stated in.

    `expected(keys, value, digits)`, `actual(keys, value)`; a result that is
    absent is reported as NOT_FOUND.
    """
    a = actual.select(*keys, F.col("value").alias("actual"))
    j = expected.join(a, keys, "left")
    scale = F.pow(F.lit(10.0), F.col("digits"))
    shown = F.round(F.col("actual") * scale) / scale
    want = F.round(F.col("value") * scale) / scale
    return j.select(
        *keys, want.alias("expected"), shown.alias("actual"),
        F.coalesce(want == shown, F.lit(False)).alias("match"),
        F.abs(F.col("value") - F.col("actual")).alias("diff"),
        F.when(F.col("actual").isNull(), "NOT_FOUND").otherwise("FOUND").alias("status"),
    )


def top_features(summary: DataFrame, by: str = "topk_rate", k: int = 3) -> DataFrame:
    return summary.orderBy(F.desc(by), "feature").limit(k)


def feature_set_check(stages: DataFrame, coefs: DataFrame, canonical: list[str] = PREDICTORS,
                      stage3: int | None = None) -> DataFrame:
    """Per (trait, teacher) present in both results: features missing from or
    unexpected in the coefficient table, and a diagnosis."""
    want = F.array(*[F.lit(c) for c in canonical])
    stage3 = stage3 or len(DEMOGRAPHICS) + len(PREDICTORS)
    keys = ["trait", "teacher"]
    last = stages.filter(F.col("stage") == 3).select(*keys, F.col("n_features").alias("stage3_n"))
    have = coefs.groupBy(*keys).agg(F.collect_set("feature").alias("have"))  # one row per feature
    j = last.join(have, keys, "full_outer")
    missing = F.array_sort(F.array_except(want, F.col("have")))
    unexpected = F.array_sort(F.array_except(F.col("have"), want))
    j = j.withColumn("missing", F.array_join(missing, ",")).withColumn("unexpected", F.array_join(unexpected, ","))
    both = F.col("stage3_n").isNotNull() & F.col("have").isNotNull()
    matches = (F.col("missing") == "") & (F.col("unexpected") == "")
    return j.select(
        *keys,
        F.when(both, "both").when(F.col("have").isNull(), "stages only").otherwise("coefficients only").alias("found"),
        "missing", "unexpected",
        F.coalesce(both & matches, F.lit(False)).alias("consistent"),
        F.when(~both, "no counterpart")
        .when(matches & (F.col("stage3_n") == stage3), "feature sets agree")
        .when(matches, "stage 3 has another feature count")
        .when(F.contains(F.col("unexpected"), F.lit("IX_topic_drift_mean")), "coefficients from an older feature set")
        .otherwise("feature sets differ").alias("diagnosis"),
    )
