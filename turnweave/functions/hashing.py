"""Engine-independent random numbers: md5 of 'seed:replicate:id'.

The same key gives the same number in any SQL engine, on any partitioning and
after any task retry, which no stateful generator can promise.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash_uint32(*parts) -> Column:
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("bigint")


def draw_index(n: int | Column, *parts) -> Column:
    """A with-replacement draw from 0..n-1."""
    return hash_uint32(*parts) % (n if isinstance(n, Column) else F.lit(int(n)))


def table_digest(df):
    """Row count and order-insensitive content digest of a table.

    Of each row the first 15 hex digits of md5 over its columns in name order,
    as text between bars, NULL as \\N; their sum in decimal neither overflows
    nor depends on row order or partitioning.
    """
    row = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in sorted(df.columns)])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10)
    return df.select(h.cast("decimal(38,0)").alias("h")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"),
    )
