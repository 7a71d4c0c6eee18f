"""Line dedup: a suffix array over line ids by distributed prefix doubling.

The corpus is a sequence of line ids per document (128 hash bits a line). A
suffix starts at a line and ends with its document. Round by round the suffixes
are ordered by their first 1, 2, 4, ... lines: a suffix's rank is one plus the
number of suffixes with a smaller head, and the order of twice the length
follows from the pair (rank here, rank that many lines further on). Suffixes
whose head occurs once keep their rank and take no further part.

Suffixes that share their first L lines are neighbours in that order, an LCP
interval. L lines are named by two overlapping heads of the largest round that
fits, so an interval of any length is one group of equal names. The depth
needed is bounded: a run counts once it holds `min_chars` characters (every
line counts one more for its end), so rounds stop at the longest such run.

A line is deleted if it lies in a run of at least `min_chars` characters that
also occurs earlier in the corpus, in the order (doc_id, text hash, line): every
later copy of a maximal repeated run goes, whole, and first copies stay. It is
enough to look at the shortest sufficient run from each line on and up to each
line, because these cover every longer one.

All steps are DataFrame expressions. Ranks never gather a hot line's followers:
pairs are counted first, and their running sums are cut into buckets of the
second rank, with offsets per bucket. Joins on names are plain shuffle joins,
which adaptive execution splits where one name is hot.

Defined results: a NULL text stays NULL and has no lines; an empty text is one
empty line. Rows equal in doc_id and text are one document and all get the same
result. A document all of whose lines are later copies becomes an empty text.
All columns of the input are kept, whatever their names.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

KEY = ("__tw_id", "__tw_hash")


def _keyed(docs: DataFrame) -> dict[str, Column]:
    return {"__tw_id": F.col("doc_id").cast("long"), "__tw_hash": F.xxhash64("text")}


def _buckets(rows: int) -> int:
    """How many buckets keep a bucket near a million rows: 64 to 2^20."""
    return 1 << min(max(math.ceil(math.log2(max(rows, 1) / 1e6)), 6), 20)


def _line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """Key columns, i, two line hashes, and the sufficient lengths lf (from the line on) and lb (up to it); 0: none."""
    line = F.transform(F.split("text", "\n"), lambda x: F.struct(
        F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"), (F.length(x) + 1).alias("c")))
    docs = docs.filter("text IS NOT NULL").select(*[c.alias(n) for n, c in _keyed(docs).items()], line.alias("lines"))
    docs = docs.groupBy(*KEY).agg(F.first("lines").alias("lines"))
    rows = docs.select(*KEY, F.posexplode("lines").alias("i", "x")).select(*KEY, "i", "x.*")
    by_doc = Window.partitionBy(*KEY)
    end = F.sum("c").over(by_doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("c"))
    total = F.max("end").over(by_doc)
    ahead = F.count(F.lit(1)).over(by_doc.orderBy("start").rangeBetween(0, min_chars - 1))
    behind = F.count(F.lit(1)).over(by_doc.orderBy("end").rangeBetween(1 - min_chars, 0))
    return rows.select(
        *KEY, "i", "a", "b",
        F.when(F.col("start") + min_chars <= total, ahead).otherwise(0).cast("int").alias("lf"),
        F.when(F.col("end") >= min_chars, behind).otherwise(0).cast("int").alias("lb"))


def _running(counts: DataFrame, major: list[str], bucket: str, minor: list[str], n: str) -> DataFrame:
    """`counts` with `before`: the sum of n over smaller (bucket, minor) of the same major, without one task per major."""
    inner = Window.partitionBy(*major, bucket).orderBy(*minor).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*major, bucket).agg(F.sum(n).alias("t"))
    outer = Window.partitionBy(*major).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*major, bucket, F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("base"))
    inside = counts.withColumn("inside", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    return inside.join(totals, [*major, bucket]).withColumn("before", F.col("inside") + F.col("base")).drop("inside", "base")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """Rank by the first line. The rank is negative where the line occurs once."""
    kinds = materialize(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    bits = int(math.log2(_buckets(kinds.count())))
    kinds = kinds.withColumn("bucket", F.shiftright("a", 64 - bits)).withColumn("all", F.lit(0))
    ranked = _running(kinds, ["all"], "bucket", ["a", "b"], "n")
    rank = F.when(F.col("n") > 1, F.col("before") + 1).otherwise(-F.col("before") - 1)
    return lines.join(ranked.select("a", "b", rank.alias("rank")), ["a", "b"]).select(*KEY, "i", "lf", "lb", "rank")


def _doubled(ranks: DataFrame, k: int, total: int) -> DataFrame:
    """Ranks by the first 2k lines from ranks by the first k."""
    by_doc = Window.partitionBy(*KEY).orderBy("i")
    rows = ranks.withColumn("next", F.coalesce(F.abs(F.lead("rank", k).over(by_doc)), F.lit(0)))
    alive = rows.filter("rank > 0")
    step = max(total // _buckets(total), 1)
    pairs = alive.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.expr(f"next div {step}"))
    place = _running(pairs, ["rank"], "bucket", ["next"], "n")
    new = F.col("rank") + F.col("before")
    place = place.select("rank", "next", F.when(F.col("n") > 1, new).otherwise(-new).alias("new"))
    fresh = alive.join(place, ["rank", "next"]).select(*KEY, "i", "lf", "lb", F.col("new").alias("rank"))
    return rows.filter("rank < 0").select(*KEY, "i", "lf", "lb", "rank").union(fresh)


def _windows(ranks: DataFrame, k: int) -> DataFrame:
    """Sufficient runs of k to 2k - 1 lines: length, name (r1, r2) and place. Runs with a unique head are left out."""
    by_doc = Window.partitionBy(*KEY).orderBy("i")
    ahead = F.collect_list("rank").over(by_doc.rowsBetween(0, k - 1))
    behind = F.collect_list("rank").over(by_doc.rowsBetween(-(2 * k - 2), 0))
    rows = ranks.select(*KEY, "i", "lf", "lb", "rank", ahead.alias("ahead"), behind.alias("behind"))
    n = F.size("behind")
    forward = F.struct(F.col("lf").alias("length"), F.col("i").alias("p"), F.col("rank").alias("r1"), F.get("ahead", F.col("lf") - k).alias("r2"))
    backward = F.struct(F.col("lb").alias("length"), (F.col("i") - F.col("lb") + 1).alias("p"), F.get("behind", n - F.col("lb")).alias("r1"), F.get("behind", n - k).alias("r2"))
    found = rows.select(*KEY, F.explode(F.array(forward, backward)).alias("w")).select(*KEY, "w.*")
    return found.filter((F.col("length") >= k) & (F.col("length") < 2 * k) & (F.col("r1") > 0) & (F.col("r2") > 0))


def _goes_on(ranks: DataFrame, k: int) -> bool:
    """Whether a run of 2k lines or more, from a line on or up to one, may occur twice: its first or last two k-line heads both do.

    A run up to a line counts whatever follows that line.
    """
    by_doc = Window.partitionBy(*KEY).orderBy("i")
    rows = ranks.select("lf", "lb", "rank", F.lead("rank", k).over(by_doc).alias("next"),
                        F.lag("rank", k - 1).over(by_doc).alias("last"), F.lag("rank", 2 * k - 1).over(by_doc).alias("first"))
    ahead = f"lf >= {2 * k} AND rank > 0 AND next > 0"
    return not rows.filter(f"{ahead} OR lb >= {2 * k} AND last > 0 AND first > 0").isEmpty()


def suffix_ranks(docs: DataFrame, min_chars: int = 50) -> list[tuple[int, DataFrame]]:
    """[(k, ranks by the first k lines)] for k = 1, 2, 4, ... up to the depth that a run of `min_chars` can have.

    Each table is written: key columns, i (line), lf, lb, rank (negative: the head occurs once). Sorting the
    last one by abs(rank) gives the suffix array to that depth.
    """
    lines = materialize(_line_table(docs, min_chars))
    levels = [(1, materialize(_first_ranks(lines)))]
    total = lines.count()
    while True:
        k, ranks = levels[-1]
        if not _goes_on(ranks, k):
            return levels
        levels.append((2 * k, materialize(_doubled(ranks, k, total))))


def repeated_runs(docs: DataFrame, min_chars: int = 50) -> DataFrame:
    """Later copies to delete, one row per maximal run of lines: key columns, begin (line), n_lines."""
    windows = None
    for k, ranks in suffix_ranks(docs, min_chars):
        found = _windows(ranks, k)
        windows = found if windows is None else windows.union(found)
    windows = materialize(windows.distinct())
    place = F.struct(*KEY, "p")
    # Counted in one job and joined in the next, so that adaptive execution can split a hot name.
    interval = windows.groupBy("length", "r1", "r2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    interval = materialize(interval)
    later = windows.join(interval, ["length", "r1", "r2"]).filter(place > F.col("first"))
    # Overlapping windows of a document merge into maximal runs.
    by_doc = Window.partitionBy(*KEY).orderBy("p", "stop")
    spans = later.groupBy(*KEY, "p").agg(F.max(F.col("p") + F.col("length")).alias("stop"))
    reached = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.col("p") <= reached, 0).otherwise(1))
    spans = spans.withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(*KEY, "run").agg(F.min("p").alias("begin"), F.max("stop").alias("stop")).select(
        *KEY, "begin", (F.col("stop") - F.col("begin")).alias("n_lines"))


def delete_copies(docs: DataFrame, min_chars: int = 50) -> DataFrame:
    """The documents without the later copies of repeated runs, plus n_lines and n_deleted."""
    runs = repeated_runs(docs, min_chars).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("begin", "n_lines"))).alias("__tw_runs"))
    runs = runs.select(F.col("__tw_id").alias("__tw_id2"), F.col("__tw_hash").alias("__tw_hash2"), "__tw_runs")
    joined = docs.withColumns(_keyed(docs)).join(runs, F.col("__tw_id").eqNullSafe(F.col("__tw_id2")) & (F.col("__tw_hash") == F.col("__tw_hash2")), "left")
    lines = F.split("text", "\n")
    # The stretches between deleted runs, each cut out of the lines once.
    ends = F.transform("__tw_runs", lambda r: r["begin"] + r["n_lines"])
    begins = F.concat(F.array(F.lit(0)), ends)
    stops = F.concat(F.transform("__tw_runs", lambda r: r["begin"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, stops, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    text = F.when(F.col("__tw_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    deleted = F.aggregate(F.col("__tw_runs"), F.lit(0), lambda n, r: n + r["n_lines"])
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"))
