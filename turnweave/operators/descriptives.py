"""Descriptive tables over a wide feature table."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import columns as cl
from . import skew
from .features import CATEGORY_ORDER


def _numeric(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*[cl.to_number(f) for f in features])


def long_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per (record, feature)."""
    return df.unpivot(list(keep), [cl.to_number(f) for f in features], "feature", "value")


def describe(df: DataFrame, features: list[str], exact_in_task: int = skew.ROWS_PER_TASK) -> DataFrame:
    """N, mean, sd, min, p25, p50, p75, p90, max of each feature.

    Every feature is a group holding all records, so beyond `exact_in_task`
    records the order statistics come from the histogram method.
    """
    df = materialize(_numeric(df, features))  # its size decides the method
    d = long_features(df, features).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    qs = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    aggs = [
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ]
    if df.count() <= exact_in_task:
        q = F.percentile("value", F.array(*[F.lit(v) for v in qs.values()])).alias("_q")
        out = d.groupBy("feature").agg(*aggs, q)
        out = out.select(
            "feature", "n", "mean", "sd", "min", *[F.col("_q")[i].alias(k) for i, k in enumerate(qs)], "max"
        )
    else:
        quant = skew.exact_quantiles(d, ["feature"], "value", list(qs.values()), list(qs))
        out = d.groupBy("feature").agg(*aggs).join(quant, "feature")
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(F.broadcast(out), "feature", "left").na.fill(0, ["n"])


def category_order(features: list[str]) -> list[str]:
    """Features by category prefix: PG, FILL, IX, RESP."""
    return [f for c in CATEGORY_ORDER for f in features if f.startswith(c + "_")]


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered feature pair.

    Each task folds its rows into p x p sums and emits them once, so the
    shuffle carries tasks * p^2 numbers whatever the row count.
    """
    p = len(features)
    df = materialize(_numeric(df, features))  # read for the means and for the sums
    centre = df.agg(*[F.avg(F.col(f"`{f}`").cast("double")).alias(f"c{i}") for i, f in enumerate(features)]).first()
    shift = np.array([centre[i] if centre[i] is not None else 0.0 for i in range(p)])

    def fold(batches):
        total = np.zeros((p * p, 6))
        for b in batches:
            x = b.to_numpy(dtype=float) - shift
            m = np.isfinite(x).astype(float)
            z = np.where(m > 0, x, 0.0)
            z2 = z * z
            parts = (m.T @ m, z.T @ m, m.T @ z, z2.T @ m, m.T @ z2, z.T @ z)
            total += np.stack([a.ravel() for a in parts], axis=1)
        i, j = np.divmod(np.arange(p * p), p)
        out = pd.DataFrame(total, columns=["n", "sx", "sy", "sxx", "syy", "sxy"])
        out.insert(0, "i", i)
        out.insert(1, "j", j)
        yield out

    sums = (
        df.select(*[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
        .mapInPandas(fold, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
        .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    )
    n = F.col("n")
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in features]), F.col(c) + 1)
    r = F.when((n >= 2) & (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy")),
               F.try_divide(cov, F.sqrt(vx * vy)))
    return sums.select(
        name("i").alias("feature_a"), name("j").alias("feature_b"), n.cast("long").alias("n"),
        F.when(F.col("i") == F.col("j"), F.when(r.isNotNull(), 1.0)).otherwise(r).alias("r"),
    )


def regression_line(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Degree-one least squares line of y on x."""
    xx, yy = F.col(x), F.col(y)
    both = xx.isNotNull() & yy.isNotNull()
    a, b = F.when(both, xx), F.when(both, yy)
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(a))
    return df.groupBy(*by).agg(
        F.count(a).alias("n"), slope.alias("slope"), (F.avg(b) - slope * F.avg(a)).alias("intercept")
    )
