"""Ordered lines of records: the long form of per-record texts.

A record's text is its utterances in order, joined by newlines and stripped.
Here it stays a table of lines (record, segment, line, text): segments are range
pieces of (record, order) and line numbers carry on from one piece to the next,
so a record that holds most of the rows is spread over as many tasks as its size
needs, and no cell, array or window ever holds a whole record. `assemble` makes
the one-cell form, as an optional last step.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..runtime import materialize
from . import skew
from .turns import KEYS, conform_utterances, restrict_pairs, turn_order


@dataclass
class LineStore:
    lines: DataFrame  # KEYS, segment, line (from 0), text
    records: DataFrame  # KEYS, n_utt, n_chars, n_lines


def pieces_of(df: DataFrame, rows_per_task: int = skew.ROWS_PER_TASK) -> int:
    """Range pieces for a written table: one a shuffle partition, more where they would be too big."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_task))


def line_store(utterances: DataFrame, pairs: DataFrame | None = None, rows_per_task: int = skew.ROWS_PER_TASK) -> LineStore:
    """Number the lines of every record. The utterances are read once; both tables are written.

    Blank lines before the first and after the last word of a record are left
    out, as stripping the joined text would; a record without any word has one
    empty line. NULL texts are empty utterances.
    """
    utt = conform_utterances(utterances)
    utt = utt if pairs is None else restrict_pairs(utt, pairs)
    rows = materialize(utt.select("*", F.posexplode(F.split("text", "\n")).alias("sub", "line_text")).drop("text"))
    order = [*turn_order(), F.col("sub")]
    numbered = skew.carried_sums(rows, KEYS, order, {"line": F.lit(1)}, pieces_of(rows, rows_per_task))
    numbered = materialize(numbered.select(*KEYS, F.col("chunk").alias("segment"), "line", "sub", F.col("line_text").alias("text")))
    word = F.btrim("text", F.lit(tx.WHITESPACE)) != ""
    records = materialize(numbered.groupBy(*KEYS).agg(
        F.count_if(F.col("sub") == 0).alias("n_utt"), F.sum(tx.length_without_blank(F.col("text")) + (F.col("sub") > 0).cast("int")).alias("n_chars"),  # a line break inside an utterance counts
        F.coalesce(F.min(F.when(word, F.col("line"))), F.lit(0)).alias("first"), F.coalesce(F.max(F.when(word, F.col("line"))), F.lit(0)).alias("last")))
    kept = numbered.join(records.select(*KEYS, "first", "last"), KEYS).filter("line BETWEEN first AND last")
    blanks = F.lit(tx.WHITESPACE)
    text = F.when(F.col("line") == F.col("first"), F.ltrim("text", blanks)).otherwise(F.col("text"))
    text = F.when(F.col("line") == F.col("last"), F.rtrim(text, blanks)).otherwise(text)
    lines = kept.select(*KEYS, "segment", (F.col("line") - F.col("first")).cast("long").alias("line"), text.alias("text"))
    return LineStore(materialize(lines), records.select(*KEYS, "n_utt", "n_chars", (F.col("last") - F.col("first") + 1).alias("n_lines")))


def assemble(lines: DataFrame, by: list[str] = KEYS, text: str = "text") -> DataFrame:
    """One cell per record, for records known to fit one (2 GB)."""
    parts = F.array_sort(F.collect_list(F.struct("line", text)))
    return lines.groupBy(*by).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("text"))


def write_ordered(lines: DataFrame, folder: str) -> None:
    """Write the lines so that the files, by name, hold every record's segments in order."""
    n = (lines.agg(F.max("segment")).first()[0] or 0) + 1
    dealt = lines.repartitionById(n, F.col("segment").cast("int"))
    dealt.sortWithinPartitions("segment", *KEYS, "line").write.parquet(folder)


def line_heads(lines: DataFrame, chars: int = 200, by: list[str] = KEYS) -> DataFrame:
    """The first `chars` characters of every record on one line: only lines that can reach them are gathered."""
    near = lines.filter(F.col("line") < chars)  # every line counts at least its newline
    parts = F.array_sort(F.collect_list(F.struct("line", F.substring("text", 1, chars).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda x: x["t"]), " ")
    return near.groupBy(*by).agg(F.substring(joined, 1, chars).alias("head200"))


def counts(lines: DataFrame, columns: dict[str, Column], by: list[str] = KEYS) -> DataFrame:
    """Sums of per-line counts, combined map-side."""
    return lines.groupBy(*by).agg(*[F.sum(c).cast("long").alias(n) for n, c in columns.items()])
