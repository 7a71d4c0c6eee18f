"""Benchmark decontamination by winnowing.

Both sides are reduced to fingerprints: of every `window - k + 1` consecutive
k-word hashes the smallest is kept (the rightmost one of equals), so two texts
that share `window` words in a row share at least one kept fingerprint. The
document fingerprints first pass a bit filter of fixed size built from the
benchmark's, then join the benchmark's table on (k, fingerprint). Each hit
carries the words around it; the hit is extended word by word to both sides,
and counts if the equal span reaches `window` words. This also removes every
hash collision, so the result is exact.

An item shorter than `window` words is one window of its own length n: for
those lengths all n-word hashes of the documents are looked up.

Scale: the filter is `1 << filter_bits` bits whatever the input is. Only
fingerprints that pass it leave the scan. The benchmark table is broadcast when
its counted rows are at most `broadcast_rows`; beyond that the join shuffles,
with skewed fingerprints split by adaptive execution. All groups are per
document row, with interval ends instead of word pairs.

Defined results: a NULL text has no words, an item without words has no window
and is never found; a NULL item_id is not named in `items`. Items that share a
window are all found. Every document row is judged by itself, also when rows
repeat or doc_id is NULL. Extra columns of either table are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textbatch as tb


@dataclass(frozen=True)
class Winnow:
    window: int = 13
    k: int = 5
    filter_bits: int = 24
    broadcast_rows: int = 500_000


_HIT = "row long, id long, hash long, n_words long, k int, fp long, need int, left string, right string, pos int"


def _gram_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hash at each word and whether the gram lies inside its text."""
    n = len(h)
    g = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            g[:n - j] += tb.mix(h[j:] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return tb.mix(g + np.uint64(k)), left >= k


def _winnowed(g: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Positions of the smallest gram (rightmost of equals) of every `width` consecutive grams."""
    n = len(g)
    full = inside.copy()
    full[max(n - width + 1, 0):] = False
    if n >= width:
        # Grams of one text are consecutive, so the last gram of the window decides.
        last = inside[width - 1:]
        run = np.cumsum(np.concatenate([[0], ~inside]))
        full[:n - width + 1] &= last & (run[width:] == run[:n - width + 1])
    at = np.flatnonzero(full)
    best, where = g[at], at.copy()
    for j in range(1, width):
        nxt = g[at + j]
        take = nxt <= best
        best = np.where(take, nxt, best)
        where = np.where(take, at + j, where)
    return np.unique(where)


def _fingerprints(table: DataFrame, key: str, short: list[int], spec: Winnow, bits: np.ndarray | None, header: bool) -> DataFrame:
    """Kept fingerprints with the words around them; for documents one header row (k NULL) per text.

    With `short` None every text shorter than the window chooses its own length (the benchmark side).
    """
    reach = spec.window - spec.k
    benchmark = not header

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.pieces(batches, "text"):
            buf, off = tb.raw(batch.column("text"))
            buf = tb.lower_ascii(buf)
            start, end, first = tb.word_spans(buf, off, tb.ALNUM)
            h = tb.word_hashes(buf, start, end)
            count = np.diff(first)
            doc_of = np.repeat(np.arange(len(count)), count)
            found = []
            for k, need, width in [(spec.k, spec.window, reach + 1)] + [(s, s, 1) for s in short]:
                g, inside = _gram_hashes(h, first, k)
                if benchmark and need < spec.window:  # only items of just this length
                    inside &= (count == need)[doc_of]
                at = _winnowed(g, inside, width)
                if bits is not None:
                    top = g[at] >> np.uint64(64 - spec.filter_bits)
                    at = at[(bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                found += [(int(doc_of[p]), k, need, int(g[p].view(np.int64)), int(p)) for p in at]
            ids, rows, hashes = (batch.column(c).to_pylist() for c in ("id", "row", "hash"))
            data = buf.tobytes()

            def words(a: int, b: int) -> str:
                return b" ".join(data[start[i]:end[i]] for i in range(a, b)).decode("utf-8", "replace")

            out = [(rows[i], ids[i], hashes[i], int(count[i]), None, None, None, None, None, None) for i in range(len(ids))] if header else []
            for doc, k, need, fp, p in found:
                out.append((rows[doc], ids[doc], hashes[doc], int(count[doc]), k, fp, need,
                            words(max(p - (need - k), first[doc]), p), words(p, min(p + need, first[doc + 1])), p - int(first[doc])))
            columns = list(zip(*out)) if out else [[]] * 10
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _HIT.split(", ")])

    source = table.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64("text").alias("hash"), "text")
    return source.mapInArrow(run, _HIT)


def _bit_filter(items: DataFrame, bits: int) -> np.ndarray:
    """One bit per fingerprint prefix, as bytes. At most 2^bits / 64 rows reach the driver."""
    top = F.shiftrightunsigned("fp", 64 - bits)
    rows = (
        items.groupBy(F.shiftrightunsigned(top, 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 AS int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return out.view(np.uint8)


def _equal_run(mine: Column, other: Column) -> Column:
    """How many leading elements of two arrays agree."""
    same = F.zip_with(mine, other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    bad = F.array_position(same, False)
    return F.when(bad > 0, bad - 1).otherwise(F.least(F.size(mine), F.size(other)).cast("long"))


def find(docs: DataFrame, benchmark: DataFrame, spec: Winnow = Winnow()) -> tuple[DataFrame, DataFrame]:
    """(headers, spans): one header row (row, id, n_words) per document row, and one row
    (row, item_id, begin, finish) per extended hit of at least a window, in word positions."""
    lengths = benchmark.select("text").mapInArrow(_length_rows, "n int")
    short = sorted(r[0] for r in lengths.filter((F.col("n") > 0) & (F.col("n") < spec.window)).distinct().collect())
    items = materialize(_fingerprints(benchmark, "item_id", short, spec, None, header=False))
    bits = _bit_filter(items, spec.filter_bits)
    scanned = materialize(_fingerprints(docs, "doc_id", short, spec, bits, header=True))
    other = items.select("k", "fp", "need", F.col("id").alias("item_id"), F.col("left").alias("i_left"), F.col("right").alias("i_right")).distinct()
    if items.count() <= spec.broadcast_rows:
        other = F.broadcast(other)
    hits = scanned.filter("fp IS NOT NULL").join(other, ["k", "fp", "need"])

    def backwards(c: str) -> Column:
        return F.reverse(F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " ")))

    hits = hits.withColumns({
        "before": _equal_run(backwards("left"), backwards("i_left")),
        "after": _equal_run(F.split("right", " "), F.split("i_right", " ")),
    })
    spans = hits.filter((F.col("after") >= F.col("k")) & (F.col("before") + F.col("after") >= F.col("need"))).select(
        "row", "item_id", (F.col("pos") - F.col("before")).alias("begin"), (F.col("pos") + F.col("after")).alias("finish"))
    return scanned.filter("fp IS NULL").select("row", "id", "hash", "n_words"), spans


def _length_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tb.raw(batch.column("text"))
        first = tb.word_spans(tb.lower_ascii(buf), off, tb.ALNUM)[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(first), pa.int32())], names=["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, spec: Winnow = Winnow(), share: int = 20) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (ids as sorted strings), contaminated.

    A document is contaminated when hit words are at least one in `share`.
    """
    headers, spans = find(docs, benchmark, spec)
    order = Window.partitionBy("row").orderBy("begin", "finish")
    reached = F.coalesce(F.max("finish").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = (
        spans.groupBy("row", "begin", "finish").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
        .withColumn("fresh", F.greatest(F.lit(0), F.col("finish") - F.greatest(F.col("begin"), reached)))
        .groupBy("row").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return headers.join(hit, "row", "left").select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "row", "hash",
    )


def clean(docs: DataFrame, benchmark: DataFrame, spec: Winnow = Winnow(), share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    lowest = F.lit(-(1 << 63)).cast("long")
    bad = contamination(docs, benchmark, spec, share).filter("contaminated").select(F.coalesce("doc_id", lowest).alias("__tw_key"), F.col("hash").alias("__tw_hash")).distinct()
    keyed = docs.withColumns({"__tw_key": F.coalesce(F.col("doc_id").cast("long"), lowest), "__tw_hash": F.xxhash64("text")})
    return keyed.join(bad, ["__tw_key", "__tw_hash"], "left_anti").select(docs.columns)
