"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours
and the order does not depend on how the table was written. The wanted splitter
j of P pieces is the first key with at least j/P of all bytes below it. Each
round sends probe keys to the tasks, which count the exact bytes and rows below
every probe over a narrow table (hash, id, size); the bracket around each
wanted splitter shrinks to the two probes beside it, and further to the keys
really present, until its byte count is within `tolerance` of the wanted one or
no row is left between. Then the documents are exchanged once, each row
straight to its piece, and sorted there.

A shard consists of several pieces of about `piece_bytes`, so no task holds a
whole shard of a large corpus; the pieces' exact row counts make the slots
gapless. A hot text is split by doc_id like any other range of keys. The
driver holds at most `probes` counts per open splitter.

Defined results: a NULL text has the size of an empty one, 1. Rows equal in text
and doc_id share one key and stay in one piece. A NULL doc_id sorts first. An
empty table gives an empty one. Extra columns travel along (a column named like
one of the added ones is replaced).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

NULL_ID = -(1 << 63)
Key = tuple[int, int]


@dataclass(frozen=True)
class HistogramSort:
    shards: int = 16
    probes: int = 32
    tolerance: int = 0  # bytes a splitter may miss its target by
    piece_bytes: int = 128 << 20


def key_columns(text: str = "text") -> dict:
    """The sort key and the size of a row: UTF-8 bytes of the text plus 1."""
    return {
        "__tw_sort_hash": F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"),
        "__tw_sort_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)),
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
    }


def bucket_of(h: np.ndarray, d: np.ndarray, probes: list[Key]) -> np.ndarray:
    """Number of probes at or below each key."""
    ph, pd_ = np.array([p[0] for p in probes], np.int64), np.array([p[1] for p in probes], np.int64)
    low, high = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    tied = np.flatnonzero(high > low)
    out = low.astype(np.int64)
    for a in np.unique(low[tied]):
        at = tied[low[tied] == a]
        out[at] += np.searchsorted(pd_[a:high[at[0]]], d[at], "right")
    return out


def _histogram(rows: DataFrame, probes: list[Key]) -> list:
    """Per interval between probes: bytes, rows, smallest and largest key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, d = b.column("__tw_sort_hash").to_numpy(), b.column("__tw_sort_id").to_numpy()
            frame = pd.DataFrame({"bucket": bucket_of(h, d, probes), "h": h, "d": d, "size": b.column("size").to_numpy()})
            frame = frame.sort_values(["bucket", "h", "d"], kind="stable")
            out = frame.groupby("bucket").agg(
                bytes=("size", "sum"), rows=("size", "size"), h0=("h", "first"), d0=("d", "first"), h1=("h", "last"), d1=("d", "last"))
            yield pa.RecordBatch.from_pandas(out.reset_index(), preserve_index=False)

    return (
        rows.mapInArrow(run, "bucket long, bytes long, rows long, h0 long, d0 long, h1 long, d1 long").groupBy("bucket")
        .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min(F.struct("h0", "d0")).alias("first"), F.max(F.struct("h1", "d1")).alias("last"))
        .orderBy("bucket").collect()
    )


def _spread(low: Key, high: Key, n: int) -> list[Key]:
    """Up to n keys strictly above `low` and at most `high`, evenly spaced."""
    if low[0] == high[0]:
        gap = high[1] - low[1]
        return sorted({(low[0], low[1] + gap * i // n) for i in range(1, n + 1)} - {low})
    gap = high[0] - low[0]
    keys = {(low[0] + gap * i // n, NULL_ID) for i in range(1, n + 1)}
    return sorted(k for k in keys | {high} if low < k <= high)


@dataclass
class Splitters:
    pieces: int
    keys: list[Key]  # piece = number of splitters at or below a key
    rows: list[int]  # rows of each piece
    rounds: int


def splitters(rows: DataFrame, pieces: int, spec: HistogramSort) -> Splitters:
    """Exact (or tolerated) splitters of a narrow table sort_hash, sort_id, size."""
    whole = _histogram(rows, [(NULL_ID, NULL_ID)])
    if not whole:
        return Splitters(pieces, [], [0] * pieces, 0)
    total = sum(r.bytes for r in whole)
    smallest, largest = (whole[0].first.h0, whole[0].first.d0), (whole[-1].last.h1, whole[-1].last.d1)
    above = (largest[0], largest[1] + 1)
    # A bracket: no row between `low` and the target's left side, bytes below `high` reach the target.
    open_ = {j: (smallest, above) for j in range(1, pieces)}
    found: dict[int, Key] = {}
    rounds = 0
    while open_:
        rounds += 1
        probes = sorted({p for low, high in set(open_.values()) for p in _spread(low, high, spec.probes)})
        counts = {r.bucket: r for r in _histogram(rows, probes)}
        below, n = [], 0
        for i in range(len(probes)):
            n += counts[i].bytes if i in counts else 0
            below.append(n)
        for j, (low, high) in list(open_.items()):
            target = total * j // pieces
            at = int(np.searchsorted(below, target, "left"))  # first probe with enough below
            probe, here = probes[at], counts.get(at)
            if below[at] - target <= spec.tolerance or here.rows == 1 or (here.first.h0, here.first.d0) == (here.last.h1, here.last.d1):
                found[j] = probe
                del open_[j]
            else:
                # Only keys that are present: the splitter lies above the first and not above the last plus one.
                first, last = (here.first.h0, here.first.d0), (here.last.h1, here.last.d1 + 1)
                open_[j] = (first, min(probe, last))
    keys = [found[j] for j in range(1, pieces)]
    rows_of = {r.bucket: r.rows for r in _histogram(rows, keys)} if keys else {0: sum(r.rows for r in whole)}
    return Splitters(pieces, keys, [rows_of.get(i, 0) for i in range(pieces)], rounds)


def shard(docs: DataFrame, spec: HistogramSort = HistogramSort()) -> DataFrame:
    """The documents with size, shard and slot (position in the shard's key order)."""
    columns = key_columns()
    narrow = materialize(docs.select(*[c.alias(n) for n, c in columns.items()]))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    per_shard = max(1, -(-total // (spec.shards * spec.piece_bytes)))
    pieces = spec.shards * per_shard
    cut = splitters(narrow, pieces, spec)
    keys = cut.keys

    @F.pandas_udf("int")
    def piece_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(h.to_numpy(), d.to_numpy(), keys)) if keys else pd.Series(np.zeros(len(h)))

    before = []
    for i in range(pieces):
        before.append(0 if i % per_shard == 0 else before[-1] + cut.rows[i - 1])
    offsets = docs.sparkSession.createDataFrame(list(enumerate(before)), "__tw_piece int, __tw_before long")
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = (
        docs.withColumns(columns).withColumn("__tw_piece", piece_of("__tw_sort_hash", "__tw_sort_id"))
        .repartitionById(pieces, "__tw_piece").sortWithinPartitions("__tw_sort_hash", "__tw_sort_id")
        .withColumn("__tw_inside", inside).join(F.broadcast(offsets), "__tw_piece")  # one row per piece
    )
    return placed.select(
        *[F.col(c) for c in docs.columns if c not in ("size", "shard", "slot")], "size",
        F.expr(f"cast(__tw_piece div {per_shard} AS int)").alias("shard"), (F.col("__tw_inside") + F.col("__tw_before")).alias("slot"))
