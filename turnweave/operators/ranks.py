"""Tie-averaged ranks and the rank tests built on them.

Rows are first counted per (key, value) - ties collapse map-side - and running
counts are taken per quantile bucket with offsets, so no key is sorted whole
in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..runtime import materialize
from . import skew
from .raters import pearson

WHOLE = "_whole"  # constant key of a table ranked as one group


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(WHOLE, F.lit(0)), [WHOLE])


def _small(side: DataFrame, keys: list[str]) -> DataFrame:
    """One row when the table is one group; else Spark decides by size."""
    return F.broadcast(side) if keys == [WHOLE] else side


def value_ranks(df: DataFrame, keys: list[str], value: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, c, extra..., before, avg_rank): one row per distinct value.

    `before` counts the rows with a smaller value; avg_rank = before + (c+1)/2.
    `extra` aggregates are computed per (key, value) in the same shuffle.

    The cut points are a sketch that depends on the order in which partial
    sketches arrive, so rows get their bucket once and are written with it:
    found anew for the offsets, an edge could lie elsewhere.
    """
    d, keys = _keyed(df.filter(F.col(value).isNotNull()), keys)
    counts = d.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("c"), *[e.alias(n) for n, e in (extra or {}).items()]
    )
    cuts = d.groupBy(*keys).agg(skew.cut_points(F.col(value)).alias("_cuts"))
    b = counts.join(_small(cuts, keys), keys).withColumn(
        "_b", skew.chunk_of(F.col(value), F.col("_cuts"))
    ).drop("_cuts")
    b = materialize(b)
    sizes = b.groupBy(*keys, "_b").agg(F.sum("c").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = b.withColumn("_in", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(offsets, [*keys, "_b"])
    before = F.col("_off") + F.col("_in")
    return out.select(
        *keys, value, "c", *(extra or {}), before.alias("before"),
        (before + (F.col("c") + 1) / 2).alias("avg_rank"),
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Attach the tie-averaged rank of `value` within each key to every row."""
    ranks = value_ranks(df, keys, value).select(*keys, value, F.col("avg_rank").alias(out))
    return df.join(ranks, [*keys, value], "left")


def tie_term() -> Column:
    return F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str, first: str, second: str) -> DataFrame:
    """U of the first group, group sizes and two-sided p per key; U and p are
    NULL where a group is empty."""
    d, keys = _keyed(df.filter(F.col(group).isin(first, second)), keys)
    d = materialize(d.select(*keys, value, group))  # read by counts and by cut points
    per = value_ranks(d, keys, value, {"c1": F.count_if(F.col(group) == first)})
    g = per.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("c1")).alias("r1"),
        F.sum("c1").alias("n1"),
        F.sum(F.col("c") - F.col("c1")).alias("n2"),
        tie_term().alias("ties"),
    )
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    return g.select(*keys, "n1", "n2", F.when(both, u).alias("u"), "ties").withColumn(
        "p_value", tails.mann_whitney_p("u", "n1", "n2", "ties")
    ).drop(WHOLE)


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman with p per key, over rows where both are present;
    all NULL for keys with fewer than three of them."""
    d, keys = _keyed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys)
    d = materialize(d.select(*keys, x, y))  # read by both rankings and the moments
    cells = d.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("m"))
    rx = value_ranks(d, keys, x).select(*keys, x, F.col("avg_rank").alias("rx"))
    ry = value_ranks(d, keys, y).select(*keys, y, F.col("avg_rank").alias("ry"))
    j = cells.join(rx, [*keys, x]).join(ry, [*keys, y])
    m = F.col("m")

    def moments(a: str, b: str) -> Column:
        n = F.sum(m)
        sa, sb = F.sum(m * F.col(a)), F.sum(m * F.col(b))
        saa, sbb = F.sum(m * F.col(a) * F.col(a)), F.sum(m * F.col(b) * F.col(b))
        sab = F.sum(m * F.col(a) * F.col(b))
        va, vb = saa - sa * sa / n, sbb - sb * sb / n
        return F.when((va > 0) & (vb > 0), (sab - sa * sb / n) / F.sqrt(va * vb))

    spear = j.groupBy(*keys).agg(moments("rx", "ry").alias("rho"))
    pear = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("r"))
    both = pear.join(_small(spear, keys), keys)
    enough = lambda c: F.when(F.col("n") >= 3, F.col(c)).alias(c)
    return both.select(*keys, "n", enough("r"), enough("rho")).select(
        *keys, "n", "r", tails.correlation_p("r", "n").alias("r_p"),
        "rho", tails.correlation_p("rho", "n").alias("rho_p"),
    ).drop(WHOLE)


def wilcoxon(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Signed-rank test of paired differences per key; zeros are dropped. A key
    of zeros only has n = 0 and a NULL p."""
    d, keys = _keyed(df.filter(F.col(diff).isNotNull()), keys)
    d = materialize(d.select(*keys, diff, F.abs(diff).alias("_abs")))
    zeros = d.groupBy(*keys).agg(F.count_if(F.col("_abs") == 0).alias("zeros"))
    per = value_ranks(d.filter(F.col("_abs") > 0), keys, "_abs", {"plus": F.count_if(F.col(diff) > 0)})
    g = per.groupBy(*keys).agg(
        F.sum(F.col("avg_rank") * F.col("plus")).alias("w_plus"),
        F.sum(F.col("avg_rank") * (F.col("c") - F.col("plus"))).alias("w_minus"),
        F.sum("c").alias("n"),
        F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"),
    )
    j = zeros.join(_small(g, keys), keys, "left").na.fill(0, ["w_plus", "w_minus", "n", "ties"])
    return j.withColumn("w", F.least("w_plus", "w_minus")).withColumn(
        "p_value", tails.signed_rank_p("w", "n", "ties", "zeros")
    ).drop(WHOLE)


def holm(df: DataFrame, p: str, family: list[str] = (), out: str = "p_corrected") -> DataFrame:
    """Step-down correction inside each family of tests.

    NULL p-values stay NULL and do not count; values outside [0, 1] raise. A
    family is the set of tests of one study (traits, features), so it is small.
    """
    v = F.col(p)
    bad = v.isNotNull() & ((v < 0) | (v > 1))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("p-value outside [0, 1]: "), v.cast("string"))).cast("double")).otherwise(v)
    fam = [F.col(c) for c in family] or [F.lit(1)]
    rank = Window.partitionBy(*fam).orderBy(F.col("_p").asc_nulls_last())
    m = F.count("_p").over(Window.partitionBy(*fam))
    d = df.withColumn("_p", F.when(~F.isnan(checked), checked)).withColumn("_rank", F.row_number().over(rank) - 1)
    run = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adj = F.max(F.col("_p") * (F.col("_m") - F.col("_rank"))).over(run)
    return (
        d.withColumn("_m", m)
        .withColumn(out, F.when(F.col("_p").isNotNull(), F.least(adj, F.lit(1.0))))
        .drop("_p", "_rank", "_m")
    )
