"""Per-record texts: ordered concatenation, previews, fixed-size shards."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize
from .turns import CONV, KEYS, SPK, conform_utterances, restrict_pairs


def build_monologues(utterances: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """n_utt, n_chars and the newline-joined text of each target record (all without `pairs`).

    The result holds one record's text in one cell by definition, so a record
    is bounded by Spark's 2 GB cell; `monologue_lines` is the long form without
    that bound.
    """
    utt = conform_utterances(utterances)
    utt = utt if pairs is None else restrict_pairs(utt, pairs)
    turn = F.struct(
        F.col("start_time").isNull().alias("a"), F.col("start_time").alias("b"),
        F.col("end_time").isNull().alias("c"), F.col("end_time").alias("d"),
        F.col("utt_seq").alias("e"), F.col("text").alias("text"),
    )
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["text"]), "\n"
    )
    return utt.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_utt"),
        F.sum(tx.length_without_blank(F.col("text"))).alias("n_chars"),
        F.btrim(joined, F.lit(tx.WHITESPACE)).alias("text"),
    )


def monologue_lines(utterances: DataFrame, pairs: DataFrame) -> DataFrame:
    """Long form: the target records' utterances with their order columns."""
    return restrict_pairs(conform_utterances(utterances), pairs)


def preview(df: DataFrame, by: list[Column], columns: list[str], rows: int = 200, chars: int = 200) -> DataFrame:
    """Top rows with the head of the text on one line (a display sink)."""
    head = F.substring(F.translate(F.col("text"), "\n", " "), 1, chars)
    return df.orderBy(*by).limit(rows).select(*columns, head.alias("head200"))


def sorted_positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """1-based position in the order of unique sortable columns of any type.

    One range shuffle sorts the rows over all tasks. The table is written so
    that the per-partition counts and the rows come from the same partitioning
    even after a task is retried; the count table has one row per partition.
    """
    marked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_mid", F.monotonically_increasing_id()
    )
    stored = materialize(marked)
    part = F.shiftright("_mid", 33)
    counts = stored.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    starts, total = [], 0
    for row in sorted(counts.collect()):  # one row per partition
        starts.append((row["_pid"], total))
        total += row["_n"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(starts or [(0, 0)], "_pid bigint, _before bigint")
    return (
        stored.withColumn("_pid", part)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_pid", "_before", "_mid")
    )


def shard(monologues: DataFrame, size: int = 10, order: list[str] = KEYS) -> DataFrame:
    """Number the shards of `size` consecutive rows."""
    if size < 1:
        raise ValueError("shard size must be >= 1")
    numbered = sorted_positions(monologues, list(order))
    return numbered.withColumn("shard", F.floor((F.col("pos") - 1) / size).cast("long")).drop("pos")
