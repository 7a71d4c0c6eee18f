"""Deterministic cross-validation folds."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_key
from ..runtime import materialize
from .skew import hash_positions


def record_order(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """`pos`: 0-based position of each record in md5(seed:fold:id) order."""
    d = hash_positions(df, hash_key(seed, "fold", F.col(id_col)), [id_col])
    return d.withColumn("pos", F.col("pos") - 1)


def shuffled_folds(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """Shuffled folds whose sizes differ by at most one; keeps `pos`."""
    return record_order(df, id_col, seed).withColumn("fold", (F.col("pos") % k).cast("int"))


# Groups above this share of a fold are placed one by one.
LARGE = 1000


def greedy(sizes: list[tuple], k: int) -> tuple[list[tuple], list[int]]:
    """[(group, fold)] of the groups in the given order, each to the fold with
    the fewest rows so far, and the resulting rows per fold."""
    load, placed = [0] * k, []
    for group, n in sizes:
        fold = min(range(k), key=lambda f: (load[f], f))
        load[fold] += n
        placed.append((group, fold))
    return placed, load


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """Balanced folds in which no group is split.

    Groups by falling size, ties by md5: those of more than (rows / k) / LARGE
    rows, at most k * LARGE of them, go one after another to the emptiest fold.
    The small ones then fill the folds up to equal shares along their running
    sum, so a fold is off by at most one small group.
    """
    sizes = materialize(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn("_key", F.md5(F.col(group).cast("string"))))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    large = F.col("_size") * (k * LARGE) > total
    order = [F.desc("_size"), F.asc("_key"), F.asc(group)]
    rows = [(r[0], r[1]) for r in sizes.filter(large).orderBy(*order).select(group, "_size").collect()]
    placed, load = greedy(rows, k)
    # Room left in each fold below an equal share, laid end to end.
    share, ends, at = total / k, [], 0.0
    for f in range(k):
        at += max(share - load[f], 0.0)
        ends.append(at)
    small = sizes.filter(~large)
    chunk = F.substring("_key", 1, 4)
    before = Window.partitionBy(F.lit(1)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    offsets = small.groupBy(chunk.alias("_chunk")).agg(F.sum("_size").alias("_n")).select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_chunk").orderBy("_key", group).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_off") + F.sum("_size").over(inside) - F.col("_size") / 2
    small = small.withColumn("_chunk", chunk).join(F.broadcast(offsets), "_chunk")
    fold = F.lit(k - 1)
    for f in reversed(range(k - 1)):
        fold = F.when(middle < ends[f], f).otherwise(fold)
    folds = small.select(group, fold.cast("int").alias("fold"))
    if placed:
        schema = f"`{group}` {df.schema[group].dataType.simpleString()}, fold int"
        big = df.sparkSession.createDataFrame(placed, schema)  # at most k * LARGE rows
        hot = F.broadcast(big)
        return df.join(hot, group).unionByName(df.join(hot, group, "left_anti").join(folds, group))
    return df.join(folds, group)
