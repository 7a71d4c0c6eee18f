"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits, a bit is 1 if it is set in over half of the XXH64 hashes
of the text's 3-word shingles. Two fingerprints link at `threshold` (2) or fewer
differing bits; linked documents form components.

Anchors: the codewords of a covering code over the first 46 bits, the product of
two binary Golay codes of length 23. The code is perfect: every 23-bit word lies
within radius 3 of exactly one codeword. If x and y differ in at most t bits and
a is the anchor of x (radius 3 in each half), then y lies within radius 3 + e1
and 3 + e2 of the halves of a with e1 + e2 <= t. So each distinct fingerprint is
sent to every anchor within covering radius plus threshold (about 58 of 2^24)
and marked where the anchor is its own; at each anchor the owners are compared
with all that arrived. No linked pair is missed.

Skew: equal texts and equal fingerprints collapse to one row before anything is
sent. Within a task an anchor never lists its pairs: owners and arrivals are
merged by union-find and at most one edge per fingerprint leaves the task. An
anchor owned by more than `dense` fingerprints is not compared at all; its
owners take the exact linear way: every fingerprint goes to the 65 words within
one bit, and words within two bits of each other meet at a word between them,
in a group of at most 65.

Components: smallest-neighbour hooking with pointer jumping over the distinct
linked fingerprints, each round written to the shared folder.

Defined results: a NULL text is an empty one; a text without words has
fingerprint 0 and links like any other; fewer than three words are one shingle.
A NULL doc_id is never a component's smallest id unless all are NULL. Repeated
rows get equal results; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textbatch as tb

HALF = 23
RADIUS = 3
# Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GOLAY = 0b110001110101


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, `hash` (of the text, to tell rows apart) and `fp`, the 64-bit fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in tb.pieces(batches, "text"):
            buf, off = tb.raw(batch.column("text"))
            data, out = tb.lower_ascii(buf).tobytes(), []
            for i in range(len(off) - 1):
                words = data[off[i]:off[i + 1]].split()  # bytes.split: ASCII white space only
                if len(words) > 3:
                    hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:])]
                else:
                    hashes = [digest(b" ".join(words), 42)] if words else []
                out.append(_majority(np.array(hashes, np.uint64)))
            fp = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), fp], names=["doc_id", "hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("hash"), "text").mapInArrow(run, "doc_id long, hash long, fp long")


def _majority(hashes: np.ndarray) -> int:
    """The word whose bit is 1 where over half of the hashes have a 1."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    out = word.astype(np.int64).copy()
    for bit in range(HALF - 1, 10, -1):
        out = np.where((out >> bit) & 1, out ^ (GOLAY << (bit - 11)), out)
    return out


@lru_cache(maxsize=4)
def _errors(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome the error words of weight up to radius + threshold:
    flat errors, their excess over the radius, and the offsets by syndrome."""
    words = np.array([sum(1 << b for b in c) for w in range(RADIUS + threshold + 1) for c in combinations(range(HALF), w)], np.int64)
    weight = np.array([w for w in range(RADIUS + threshold + 1) for _ in combinations(range(HALF), w)])
    syndrome = _syndrome(words)
    order = np.lexsort((weight, syndrome))
    return words[order], np.maximum(weight[order] - RADIUS, 0), np.searchsorted(syndrome[order], np.arange(2049))


def _lists(syndrome: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index into the error list) for all errors of every row."""
    count = np.diff(first)[syndrome]
    row = np.repeat(np.arange(len(syndrome)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[syndrome][row]


def anchors_of(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, owned) of all anchors within covering radius plus threshold."""
    words, excess, first = _errors(threshold)
    low, high = (fp & ((1 << HALF) - 1)).astype(np.int64), ((fp >> HALF) & ((1 << HALF) - 1)).astype(np.int64)
    row, at = _lists(_syndrome(low), first)
    row2, at2 = _lists(_syndrome(high)[row], first)
    both = excess[at[row2]] + excess[at2]
    keep = both <= threshold
    row2, at2, both = row2[keep], at2[keep], both[keep]
    base = row[row2]
    anchor = (low[base] ^ words[at[row2]]) | ((high[base] ^ words[at2]) << HALF)
    return base, anchor, both == 0


def _replicate(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, dense = batch.column("fp").to_numpy(), batch.column("dense").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                fp = fps[at:at + 4096]
                row, anchor, own = anchors_of(fp, threshold)
                own = own & ~dense[at:at + 4096][row]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row]), pa.array(own)], names=["anchor", "fp", "own"])

    return run


def _home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy()
        row, anchor, own = anchors_of(fp, 0)
        home = np.zeros(len(fp), np.int64)
        home[row[own]] = anchor[own]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(home)], names=["fp", "home"])


def _compare(threshold: int):
    """Owners against arrivals, anchor by anchor, over rows sorted by (anchor, own first).

    Links within the task are merged by union-find; one (fp, root) edge leaves per linked fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        current, owners = None, np.zeros(0, np.int64)
        for batch in batches:
            anchor, fp = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
            own = batch.column("own").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(anchor)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]])
            if not len(anchor):
                continue
            # Anchors without an owner or with a single row compare nothing; the first and the last
            # anchor of a batch may go on from the batch before or into the next one.
            owned = np.add.reduceat(own, begin, dtype=np.int64)
            pick = (owned > 0) & (end - begin > 1)
            pick[[0, -1]] = True
            for a, b, n in zip(begin[pick].tolist(), end[pick].tolist(), owned[pick].tolist()):
                if anchor[a] != current:
                    current, owners = anchor[a], fp[:0]
                if n:
                    owners = np.concatenate([owners, fp[a:a + n]])
                if not len(owners) or b - a + len(owners) <= 1 + n:
                    continue
                for x in owners:
                    near = fp[a:b][np.bitwise_count((fp[a:b] ^ x).view(np.uint64)) <= threshold]
                    if len(near) > 1 or (len(near) and near[0] != x):
                        top = root(int(x))
                        for y in near:
                            y = root(int(y))
                            if y != top:
                                top, y = min(top, y), max(top, y)
                                parent[y] = top
        edges = [(x, root(x)) for x in list(parent)]
        edges = [(x, y) for x, y in edges if x != y]
        a, b = zip(*edges) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def link_edges(distinct: DataFrame, threshold: int = 2, rows_per_task: int = 2_000_000, dense: int = 20_000) -> DataFrame:
    """(a, b) edges whose components are those of the links among distinct fingerprints `fp`."""
    if threshold != 2:  # the linear way below is for two bits
        dense = 1 << 62
    homes = distinct.mapInArrow(_home, "fp long, home long")
    counted = homes.groupBy("home").count()
    hot = counted.filter(F.col("count") > dense).select("home", F.lit(True).alias("dense"))
    marked = homes.join(hot, "home", "left").select("fp", F.coalesce("dense", F.lit(False)).alias("dense"))
    marked = materialize(marked)
    n = marked.count()
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * 60 // rows_per_task)
    edges = (
        marked.mapInArrow(_replicate(threshold), "anchor long, fp long, own boolean")
        .repartition(tasks, "anchor").sortWithinPartitions("anchor", F.desc("own"))
        .mapInArrow(_compare(threshold), "a long, b long")
    )
    # The exact linear way for crowded anchors: meet at a word within one bit of both.
    near = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(
        F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(i, F.lit(0))))))
    ball = marked.filter("dense").select("fp", F.explode(near).alias("word"))
    low = ball.groupBy("word").agg(F.min("fp").alias("low"))
    crowd = ball.join(low, "word").filter("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return edges.union(crowd)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has an edge.

    Every round hooks each root to the smallest root among its neighbours' and
    then jumps pointers; the number of rounds grows with the logarithm of the
    longest chain. Both tables of a round are written and read back.
    """
    pairs = materialize(edges.select("a", "b").distinct())
    both = pairs.union(pairs.select("b", "a"))
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        joined = (
            pairs.join(label.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .filter("ra <> rb").select(F.greatest("ra", "rb").alias("high"), F.least("ra", "rb").alias("low"))
        )
        hooks = materialize(joined.groupBy("high").agg(F.min("low").alias("low")))
        if hooks.isEmpty():
            break
        # root -> smaller root (hooked), then that root's own hook: two jumps a round.
        first = hooks.select(F.col("high").alias("root"), F.col("low").alias("to"))
        second = hooks.select(F.col("high").alias("to"), F.col("low").alias("to2"))
        jump = first.join(second, "to", "left").select("root", F.coalesce("to2", "to").alias("next"))
        label = label.join(jump, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        again = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        label = materialize(label.join(again, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
    return label


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """doc_id, hash, fp, root (of the fingerprint's component) and component_id, the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    root = components(link_edges(distinct.select("fp"), threshold))
    owner = materialize(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    best = owner.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = owner.join(best, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp").select("doc_id", "hash", "fp", "root", "component_id")


def first_of_groups(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """Of every component the document with the smallest doc_id, with all its columns.

    Where that doc_id has several rows in the component, the row with the smallest text hash stays, once.
    """
    found = near_duplicates(docs, threshold).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    winners = found.groupBy("root").agg(F.min(F.struct("hash", "doc_id")).alias("w")).select(F.col("w.doc_id").alias("__tw_id"), F.col("w.hash").alias("__tw_hash"))
    keyed = docs.withColumns({"__tw_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__tw_hash": F.xxhash64("text")})
    kept = keyed.join(winners.select(F.coalesce("__tw_id", F.lit(-(1 << 63))).alias("__tw_key"), "__tw_hash"), ["__tw_key", "__tw_hash"], "left_semi")
    same = Window.partitionBy("__tw_key", "__tw_hash").orderBy("__tw_key")
    return kept.withColumn("__tw_n", F.row_number().over(same)).filter("__tw_n = 1").select(docs.columns)
