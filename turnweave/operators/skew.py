"""Order-dependent work that stays distributed when one key is huge.

Spark windows send a whole key to one task. These primitives avoid that:

* `hot_keys`      - which keys are too big for one task (a bounded probe);
* `order_chunks`  - cuts hot keys into consecutive pieces of their sort order;
* `positions`     - global 1..n numbering from per-chunk numbers plus offsets;
* `exact_quantiles` - order statistics from a histogram and one small sort.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

# Rows of one key a single task is trusted to sort (spilling to disk).
ROWS_PER_TASK = 2_000_000
# Pieces per hot key, and the step of the two-level search among their cuts.
CUTS = 256
STEP = 16


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(key..., n) of every key above `rows_per_task` rows, as a written table.

    The count is combined map-side and reads only the key columns. There are
    at most rows / rows_per_task such keys.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.filter(F.col("n") > rows_per_task))


# Most rows of a key table that is sent to every task.
BROADCAST_ROWS = 1_000_000


def split_on(df: DataFrame, keys: list[str], hot: DataFrame, n_hot: int) -> tuple[DataFrame, DataFrame]:
    """(rows of other keys, rows of the hot keys); NULL keys are other keys."""
    side = hot.select(*keys)
    side = F.broadcast(side) if n_hot <= BROADCAST_ROWS else side
    return df.join(side, keys, "left_anti"), df.join(side, keys, "left_semi")


def cut_points(value: Column) -> Column:
    """Aggregate: CUTS - 1 approximate quantiles (a mergeable sketch) with
    every STEP-th of them as `marks` for a two-level search."""
    share = [i / CUTS for i in range(1, CUTS)]
    cuts = F.percentile_approx(value, share, 10_000)
    marks = F.array(*[F.get(cuts, i - 1) for i in range(STEP, CUTS, STEP)])
    return F.struct(F.coalesce(cuts, F.array()).alias("cuts"), F.array_compact(marks).alias("marks"))


def chunk_of(value: Column, points: Column) -> Column:
    """How many cut points lie at or below the value: about 2 * STEP
    comparisons for CUTS - 1 points."""
    below = lambda part: F.size(F.filter(part, lambda c: c <= value))
    start = below(points["marks"]) * STEP
    return F.coalesce(start + below(F.slice(points["cuts"], start + 1, F.lit(STEP - 1))), F.lit(0))


# Most range partitions of one exchange; more pieces than that are cut inside them.
RANGES = 512


def order_chunks(df: DataFrame, keys: list[str], order: list[Column], pieces: int) -> DataFrame:
    """Add `chunk`: consecutive pieces of the sort order (key, order...).

    Range partitioning compares the whole sort key, so rows with equal times
    are still cut at the unique sequence number. Beyond RANGES pieces every
    range is sorted and cut into runs of rows / pieces rows: the number of
    tasks, and what they sample and write, does not grow with the pieces. The
    table is written with its chunk numbers: they do not change when a task is
    run again.
    """
    by = [*[F.col(k) for k in keys], *order]
    if pieces <= RANGES:
        return materialize(df.repartitionByRange(pieces, *by).withColumn("chunk", F.spark_partition_id()))
    run = max(1, -(-df.count() // pieces))
    ranged = df.repartitionByRange(RANGES, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    return materialize(ranged.withColumn("chunk", F.col("_id") - place + F.floor(place / run)).drop("_id"))


def pieces_for(rows: int, rows_per_task: int) -> int:
    return max(2, -(-rows // max(rows_per_task, 1)))


# Largest table handed to every task, in bytes of its numbers.
BROADCAST_BYTES = 64 << 20


def join_side(df: DataFrame, rows: int, width: int) -> DataFrame:
    """Mark a numeric side of known size: broadcast while it is small, else a
    shuffle join. Without the mark Spark may judge the other side, rows times
    replicates from one explode, by its size before the explode."""
    return F.broadcast(df) if rows * width * 8 <= BROADCAST_BYTES else df.hint("merge")


def spread_rows(df: DataFrame, rows: int, copies: int) -> DataFrame:
    """Partition rows that are about to be copied, about a million copies per
    task, so that a small table does not grow inside one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(rows, max(cores, rows * copies // 1_000_000))))


def positions(
    df: DataFrame,
    order: list[Column],
    chunk: Column,
    keys: list[str] = (),
    out: str = "pos",
) -> DataFrame:
    """1-based position in the order, over all rows or within each key.

    `chunk` must be non-decreasing in the order and have few values (the first
    digits of a hash, a quantile bucket). Numbers are given inside a chunk and
    shifted by the rows of earlier chunks; the offset table has one row per
    (key, chunk).
    """
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    sizes = cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = before.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(out, (F.col("_rn") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_rn", "_before")
    )


def hash_positions(df: DataFrame, key: Column, ties: list[str], out: str = "pos") -> DataFrame:
    """Global position in md5 order; 65,536 even chunks by the first four digits."""
    return positions(
        df.withColumn("_key", key),
        [F.col("_key"), *[F.col(t) for t in ties]],
        F.substring("_key", 1, 4),
        out=out,
    ).drop("_key")


# Rows of a key whose quantiles one aggregate may take whole.
SMALL_KEY = 1000


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, qs: list[float], names: list[str], weight: str | None = None
) -> DataFrame:
    """Linearly interpolated exact quantiles per key, without gathering a key.

    1. a mergeable sketch gives cut points per key;
    2. rows are counted per (key, value) with map-side combining, so heavy ties
       collapse before the shuffle, and the values are put into buckets. They
       are written with their bucket: a sketch depends on the order in which
       its parts arrive, and the counts are read twice;
    3. running counts name the one or two buckets that hold each wanted rank,
       and only those buckets are ordered.
    NULL values are ignored. A `weight` column of whole numbers says how often a
    row counts. Only keys of more than SMALL_KEY rows go this way; `percentile`
    takes the others, which would carry CUTS cut points each for a few rows.
    """
    times = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), times.alias("_w"))
    d = d.filter("_w > 0")
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    hot = hot_keys(d, keys, SMALL_KEY)
    n_hot = hot.count()
    few, many = split_on(d, keys, hot, n_hot) if n_hot else (d, None)
    p = F.percentile("v", F.array(*[F.lit(float(q)) for q in qs]), F.col("_w"))
    few = few.groupBy(*keys).agg(p.alias("_p")).select(*keys, *[F.get("_p", F.lit(i)).alias(nm) for i, nm in enumerate(names)])
    return few.unionByName(_bucket_quantiles(many, keys, qs, names)) if n_hot else few


def _bucket_quantiles(d: DataFrame, keys: list[str], qs: list[float], names: list[str]) -> DataFrame:
    cuts = d.groupBy(*keys).agg(cut_points(F.col("v")).alias("_cuts"))
    counts = d.groupBy(*keys, "v").agg(F.sum("_w").alias("c"))
    counts = counts.join(cuts, keys).withColumn("_b", chunk_of(F.col("v"), F.col("_cuts"))).drop("_cuts")
    counts = materialize(counts)
    by_bucket = counts.groupBy(*keys, "_b").agg(F.sum("c").alias("nb"))
    w = Window.partitionBy(*keys).orderBy("_b")
    buckets = by_bucket.select(
        *keys, "_b",
        (F.sum("nb").over(w) - F.col("nb")).alias("before"),
        F.sum("nb").over(w).alias("upto"),
        F.sum("nb").over(Window.partitionBy(*keys)).alias("n"),
    )
    wanted = (
        buckets.withColumn("_q", F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(qs)
        ])))
        .withColumn("at", F.col("_q.q") * (F.col("n") - 1))
        .withColumn("lo", F.floor("at"))
        .withColumn("hi", F.ceil("at"))
        .filter((F.col("before") <= F.col("hi")) & (F.col("lo") < F.col("upto")))
        .select(*keys, "_b", "before", "n", F.col("_q.i").alias("i"), "at", "lo", "hi")
    )
    inside = Window.partitionBy(*keys, "_b", "i").orderBy("v")
    near = (
        counts.join(wanted, [*keys, "_b"])
        .withColumn("last", F.col("before") + F.sum("c").over(inside) - 1)
        .withColumn("first", F.col("last") - F.col("c") + 1)
    )
    frac = F.col("at") - F.col("lo")
    holds = lambda r: (F.col("first") <= r) & (r <= F.col("last"))
    part = F.when(holds(F.col("lo")), F.col("v") * (1 - frac)).otherwise(0.0) + F.when(
        (F.col("hi") > F.col("lo")) & holds(F.col("hi")), F.col("v") * frac
    ).otherwise(0.0)
    picked = near.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("i") == i, part)).alias(nm) for i, nm in enumerate(names)]
    )
    return picked


def carried_sums(df: DataFrame, keys: list[str], order: list[Column], weights: dict[str, Column], pieces: int) -> DataFrame:
    """Add running sums over the earlier rows of a key, in an order, for keys of any size.

    `weights` maps new columns to weights. The rows are cut into range pieces of
    (key, order), summed up per piece, and every piece takes the sums of the
    earlier ones as its carry; a window never spans two pieces. The column
    `chunk` numbers the pieces. Keys are not NULL and the order is total.
    """
    rows = order_chunks(df.withColumns({f"_w_{n}": w for n, w in weights.items()}), keys, order, pieces)
    sums = rows.groupBy(*keys, "chunk").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    carry = sums.select(*keys, "chunk", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in weights])
    inside = Window.partitionBy(*keys, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({n: F.coalesce(F.sum(f"_w_{n}").over(inside), F.lit(0)) for n in weights})
    out = local.join(carry, [*keys, "chunk"]).withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in weights})
    return out.drop(*[f"_{p}_{n}" for n in weights for p in ("w", "c")])


def smallest(df: DataFrame, keys: list[str], hashed: str, wanted: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows with the n smallest hashes of each key, with `rank` (from 1), without sorting or gathering a key.

    `hashed` is a column of lower-case hex digits, `wanted` has (keys, n). Rows
    are counted by the first four digits; the running counts name the one bucket
    that holds rank n, and what lies below it is taken whole. A bucket that is
    too big for a task is counted again by four more digits. Equal hashes are
    ordered arbitrarily. A key with fewer rows gives all of them.
    """
    rest = df.join(wanted.select(*keys, F.col("n").alias("_left")).filter("_left > 0"), keys).withColumn("_before", F.lit(0).cast("long"))
    taken, digits = None, 0
    while True:
        digits += 4
        head = F.substring(hashed, 1, digits)
        buckets = rest.groupBy(*keys, head.alias("_b"), "_left", "_before").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*keys, "_before").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
        cut = buckets.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0))).filter("_below < _left")
        cut = materialize(cut.select(*keys, "_b", "_n", (F.col("_left") - F.col("_below")).alias("_left"), (F.col("_before") + F.col("_below")).alias("_before")))
        rows = rest.drop("_left", "_before").withColumn("_b", head).join(cut, [*keys, "_b"])
        inside = Window.partitionBy(*keys, "_b").orderBy(hashed)
        fits = (F.col("_n") <= rows_per_task) if digits < 32 else F.lit(True)
        # Whole buckets and the last one of each key are ranked alike: a bucket is a task's work.
        part = rows.filter(fits).withColumn("rank", F.row_number().over(inside) + F.col("_before")).filter(F.col("rank") - F.col("_before") <= F.col("_left"))
        part = part.drop("_b", "_n", "_left", "_before")
        taken = part if taken is None else taken.unionByName(part)
        if digits >= 32 or cut.filter(~fits).isEmpty():
            return taken
        rest = rows.filter(~fits).drop("_b", "_n")
