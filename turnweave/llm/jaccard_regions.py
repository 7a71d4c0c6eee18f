"""Exact Jaccard self-join in metric space: pivots, Voronoi regions, recursion.

A document is its set of distinct 3-word shingles; documents link at a Jaccard
similarity of `percent` (90) or more, so at a distance of at most t = 0.1, and
linked documents form components. Equal sets collapse to one before anything is
compared. The Jaccard distance is a metric, which everything below rests on.

Pivots. Sets that link share one of their first n - ceil(0.9 n) + 1 shingles in
any fixed order of all shingles (rare ones first here: frequent shingles stand
last). The smallest set that has a shingle there is the pivot of that shingle,
and its region holds all sets that have it there. Both ends of a link thus meet
in the region of one pivot. Unlike cells of a few sampled pivots, which unrelated
texts (all at distance 1 of each other) could not be told apart by, these
pivots are as many as the corpus has families.

Windows. With x and y at distances dx and dy of a pivot, |dx - dy| > t rules a
link out. Before whole sets are sent to a region, parity sketches (an eighth of
a byte a shingle) are: each bit that differs is a shingle that only one set has,
a contraction of the set difference, so a pair whose sketches differ too much
cannot link. Sets that sketches connect stay together under the smallest of them
as their pivot, whichever regions they met in; sets without a possible partner
are not sent at all.

Recursion. A region that is too big for a task is cut by pivots of its own: a
set's home is its nearest pivot's Voronoi cell, and it is replicated to every
cell whose pivot is at most 2t farther away. If y's home is q and x links to y,
then d(x, q) <= d(y, q) + t <= d(y, p) + t <= d(x, p) + 2t for x's own nearest
pivot p, so the pair meets in q's cell. Cells are cut again until they fit. A
region that pivots do not thin out is dealt into blocks that are compared two
by two: as many comparisons, but over many tasks, and still exact. No pair list
is made: a task merges its links and returns one edge per linked set.

Defined results: A-Z are lower-cased; fewer than three words are one shingle, a
NULL text or one without words has the empty set and links with nothing. A NULL
doc_id is never a component's smallest id unless all are NULL. Repeated rows get
equal results. Extra columns are not read; an empty table gives an empty one.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textbatch as tb
from .simhash import components
from .winnowing import _bit_filter
from .wordblocks import gather

FILTER_BITS = 24


@dataclass(frozen=True)
class Regions:
    percent: int = 90
    region_sets: int = 2_000  # sets of a region that one task compares
    region_shingles: int = 4_000_000  # and their shingles
    pivots: int = 16  # pivots wanted for a region that is cut again
    region_sketches: int = 10_000  # sets of a region whose sketches one task compares
    frequent: int = 200  # a shingle in more prefixes than this stands behind the others

    def prefix(self, n: int) -> int:
        return n - (self.percent * n + 99) // 100 + 1


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (64 bits) of each text."""
    buf = tb.lower_ascii(buf)
    start, end, first = tb.word_spans(buf, off, tb.NOT_SPACE)
    h = tb.word_hashes(buf, start, end)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        w = h[a:b]
        with np.errstate(over="ignore"):
            if len(w) >= 3:
                g = tb.mix(w[:-2]) * np.uint64(3) + tb.mix(w[1:-1] + np.uint64(1)) * np.uint64(5) + w[2:]
            elif len(w):
                g = np.array([int(w[0]) + (int(tb.mix(w[1:2])[0]) if len(w) > 1 else 0) + len(w)], object) % (1 << 64)
                g = g.astype(np.uint64)
            else:
                g = w
        yield np.unique(tb.mix(g))


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of m cells, m the power of two from half the set's size on (64 at least)."""
    m = max(64, 1 << max((len(s) // 2 - 1).bit_length(), 0))
    odd = np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


PRINTS = "doc_id long, th binary, n int, sa long, sb long, sketch binary, pre array<long>"


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash's first FILTER_BITS bits is set."""
    top = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[top >> 3] >> (top & 7).astype(np.uint8)) & 1 == 1


def _prints(docs: DataFrame, spec: Regions, frequent: np.ndarray | None) -> DataFrame:
    """Per document: the text's digest, set size, the set's 128-bit digest, its sketch and its prefix."""
    share = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = share.value
        for batch in tb.pieces(batches, "text"):
            n, sa, sb, sketches, prefixes = [], [], [], [], []
            for s in shingle_sets(*tb.raw(batch.column("text"))):
                digest = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                sa.append(int.from_bytes(digest[:8], "little", signed=True))
                sb.append(int.from_bytes(digest[8:], "little", signed=True))
                sketches.append(sketch(s))
                if bits is not None:
                    behind = _marked(bits, s)
                    s = np.concatenate([s[~behind], s[behind]])
                prefixes.append(s[:spec.prefix(len(s))].view(np.int64) if len(s) else s.view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            pre = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(prefixes)))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()),
                pa.array(sketches, pa.binary()), pre], names=[c.split()[0] for c in PRINTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("th"), "text").mapInArrow(run, PRINTS)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def _frequent(docs: DataFrame, spec: Regions) -> np.ndarray:
    """The shingles to put last, as a bit filter of fixed size. What shares a bit with one goes last too: any order will do."""
    counts = _prints(docs, spec, None).select(F.explode("pre").alias("fp")).groupBy("fp").count()
    return _bit_filter(counts.filter(F.col("count") > spec.frequent).select("fp"), FILTER_BITS)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after another, from rows sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(k)) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != int(k[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _folded(words: np.ndarray, bits: int) -> np.ndarray:
    """Sketches of twice the bits (rows of 64-bit words) brought to `bits`."""
    half = bits // 64
    return words[:, :half] ^ words[:, half:]


def possible(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """A group number per set: sets that sizes and sketches allow to link have the same one."""
    label = np.arange(len(n))
    bits = np.array([8 * len(s) for s in sketches])
    rows = {m: np.flatnonzero(bits == m) for m in np.unique(bits).tolist()}
    words = {m: np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(len(at), -1) for m, at in rows.items()}
    for m, at in rows.items():
        sides = [(at, words[m])]
        if 2 * m in rows:
            sides.append((rows[2 * m], _folded(words[2 * m], m)))
        for other, theirs in sides:
            for i, mine in zip(at.tolist(), words[m]):
                fit = (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])) & (label[other] != label[i])
                near = np.flatnonzero(fit)
                if len(near):
                    apart = np.bitwise_count(theirs[near] ^ mine).sum(1, dtype=np.int64)
                    near = near[(100 + percent) * apart <= (100 - percent) * (n[other[near]] + n[i])]
                    for group in np.unique(label[other[near]]):
                        label[label == group] = label[i]
    return label


def _wanted(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "p"):
            node = rows["node"].to_numpy()
            order = np.argsort(node)
            rows, node = rows.take(pa.array(order)), node[order]
            _, first, group, size = np.unique(
                possible(rows["n"].to_numpy().astype(np.int64), rows["sketch"].to_pylist(), percent), return_index=True, return_inverse=True, return_counts=True)
            at = np.flatnonzero(size[group] > 1)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[first[group[at]]]), pa.array(node[at])], names=["p", "node"])

    return run


def links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges (node, smaller node) that connect what the links among the sets connect.

    The first set by size is the local pivot whose distances give the windows.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    nodes, n, sets = nodes[order], n[order], [sets[i] for i in order]
    off = np.concatenate([[0], np.cumsum(n)])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    owners = (np.searchsorted(off, by, side="right") - 1)
    starts = np.searchsorted(inverse[by], np.arange(int(inverse.max()) + 2))

    def shared(i: int) -> np.ndarray:
        return np.bincount(gather(owners, starts, inverse[off[i]:off[i + 1]]), minlength=len(n))

    pivot = len(n) // 2
    inter = shared(pivot)
    distance = 1 - inter / (n + n[pivot] - inter)
    t = 1 - percent / 100 + 1e-9
    label = np.arange(len(n))
    last = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(n)):
        later = slice(i + 1, last[i])
        if not ((label[later] != label[i]) & (np.abs(distance[later] - distance[i]) <= t)).any():
            continue
        inter = shared(i)[later]
        hit = np.flatnonzero(100 * inter >= percent * (n[i] + n[later] - inter)) + i + 1
        for other in np.unique(label[hit]):
            label[label == other] = label[i]
    low: dict[int, int] = {}
    for node, group in zip(nodes.tolist(), label.tolist()):
        low[group] = min(low.get(group, node), node)
    return [(node, low[group]) for node, group in zip(nodes.tolist(), label.tolist()) if node != low[group]]


def _set(data: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in data.to_pylist()]


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "region"):
            node, first = np.unique(rows["node"].to_numpy(), return_index=True)
            if len(node) > 1:
                edges = links(node, _set(rows["set"].take(pa.array(first))), percent)
                if edges:
                    a, b = zip(*edges)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        tb.release()

    return run


CELLS = "parent long, region long, node long, n int, set binary"


def _voronoi(percent: int):
    """Members of a piece of a region against the region's pivots: home cell and windows."""
    t = 1 - percent / 100 + 1e-9

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in CELLS.split(", ")]
        if not right.num_rows or not left.num_rows:
            return left.select(["region", "region", "node", "n", "set"]).rename_columns(names)
        right = right.sort_by("node")
        pivots, sets = right["node"].to_numpy(), _set(right["set"])
        n = np.array([len(s) for s in sets])
        universe = np.unique(np.concatenate(sets))
        has = np.zeros((len(sets), len(universe) + 1), np.int32)
        for k, s in enumerate(sets):
            has[k, np.searchsorted(universe, s)] = 1
        members, row, cell = _set(left["set"]), [], []
        for i, s in enumerate(members):
            at = np.searchsorted(universe, s)
            at = at[universe[np.minimum(at, len(universe) - 1)] == s]
            inter = has[:, at].sum(1)
            d = 1 - inter / (n + len(s) - inter)
            near = np.flatnonzero(d <= d.min() + 2 * t)
            row += [i] * len(near)
            cell += near.tolist()
        parent = left["region"].to_numpy()[0]
        with np.errstate(over="ignore"):
            region = tb.mix(pivots[cell].view(np.uint64) + tb.mix(np.full(1, parent, np.int64).view(np.uint64))).view(np.int64)
        take = left.take(pa.array(row))
        return pa.table([pa.array(np.full(len(row), parent)), pa.array(region), take["node"], take["n"], take["set"]], names=names)

    return run


def _fitting(rows: DataFrame, spec: Regions) -> tuple[DataFrame, DataFrame]:
    """(rows of regions that fit a task, rows of the others with their region's `parts`: how many task sizes it is)."""
    size = rows.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    parts = F.greatest(F.ceil(F.col("rows") / spec.region_sets), F.ceil(F.col("shingles") / spec.region_shingles))
    big = materialize(size.select("region", "rows", parts.alias("parts")).filter(F.col("parts") > 1))
    if big.isEmpty():
        return rows, None
    return rows.join(big.select("region"), "region", "left_anti"), rows.join(big, "region")


def cut(rows: DataFrame, spec: Regions) -> DataFrame:
    """(region, node, n, set) with every region small enough for a task; no link between members of a region is lost."""
    out, rest = _fitting(rows, spec)
    while rest is not None:
        rest = materialize(rest)
        chunk = F.pmod(F.xxhash64("node"), F.col("parts"))
        # Pivots: members drawn by hash, `pivots` of them on average; a region without any goes to the blocks.
        drawn = rest.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")) < spec.pivots)
        drawn = drawn.select("region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("chunk"), "node", "set")
        members = rest.select("region", chunk.alias("chunk"), "node", "n", "set")
        cells = materialize(members.groupBy("region", "chunk").cogroup(drawn.groupBy("region", "chunk")).applyInArrow(_voronoi(spec.percent), CELLS))
        counts = cells.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("c")).groupBy("parent").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
        before = rest.select(F.col("region").alias("parent"), "rows").distinct()
        thinned = materialize(counts.join(before, "parent").filter((F.col("most") <= 0.75 * F.col("rows")) & (F.col("all") <= 3 * F.col("rows"))).select("parent"))
        stuck = rest.join(thinned.withColumnRenamed("parent", "region"), "region", "left_anti")
        # Blocks of half a task's size, two and two.
        blocks = 2 * F.col("parts")
        own = F.pmod(F.xxhash64("node", F.lit(2)), blocks)
        dealt = stuck.select("region", "node", "n", "set", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
        dealt = dealt.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "node", "n", "set")
        out = out.unionByName(dealt)
        fit, rest = _fitting(cells.join(thinned, "parent", "left_semi").select("region", "node", "n", "set"), spec)
        out = out.unionByName(fit)
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(th, set) of the texts whose digest is in `wanted` (th): texts that a bit filter of fixed size lets pass are cut again."""
    spark = docs.sparkSession
    head = F.conv(F.substring(F.hex("th"), 1, 16), 16, -10).cast("long")
    share = spark.sparkContext.broadcast(_bit_filter(wanted.select(head.alias("fp")), FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = share.value
        for batch in tb.pieces(batches, "text"):
            off = tb.offsets(batch.column("th"))
            th = np.frombuffer(tb.raw_bytes(batch.column("th")), np.uint8).reshape(len(off) - 1, -1)
            passed = batch.filter(pa.array(_marked(bits, th[:, :8].copy().view(">u8")[:, 0].astype(np.uint64))))
            if passed.num_rows:
                sets = [s.tobytes() for s in shingle_sets(*tb.raw(passed.column("text")))]
                yield pa.RecordBatch.from_arrays([passed.column("th"), pa.array(sets, pa.binary())], names=["th", "set"])

    texts = docs.filter("text IS NOT NULL").select(_digest("text").alias("th"), "text")
    return texts.mapInArrow(run, "th binary, set binary").groupBy("th").agg(F.first("set").alias("set"))


def link_edges(docs: DataFrame, nodes: DataFrame, spec: Regions) -> DataFrame:
    """(a, b): edges whose components are those of the links. `nodes`: node, th, n, sketch, pre of the distinct sets."""
    spark = docs.sparkSession
    postings = nodes.select("node", F.explode("pre").alias("s"))
    pivots = postings.groupBy("s").agg(F.min("node").alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    pairs = materialize(postings.join(pivots, "s").select("p", "node").distinct())
    size = pairs.groupBy("p").count()
    big = materialize(size.filter(F.col("count") > spec.region_sketches).select("p"))
    slim = pairs.join(big, "p", "left_anti").join(nodes.select("node", "n", "sketch"), "node")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, -(-pairs.count() // 200_000))
    wanted = slim.repartition(tasks, "p").sortWithinPartitions("p").mapInArrow(_wanted(spec.percent), "p long, node long")
    wanted = materialize(wanted.distinct().union(pairs.join(big, "p", "left_semi").select("p", "node")))
    rows = wanted.select("node").distinct().join(nodes.select("node", "th", "n"), "node")
    rows = materialize(rows)
    sets = rows.join(_sets_of(docs, rows), "th").select("node", "n", "set")
    regions = materialize(wanted.join(sets, "node").select(F.col("p").alias("region"), "node", "n", "set"))
    small = cut(regions, spec)
    return small.repartition(tasks, "region").sortWithinPartitions("region").mapInArrow(_compare(spec.percent), "a long, b long")


def join(docs: DataFrame, spec: Regions = Regions()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    docs = docs.select("doc_id", "text")
    prints = materialize(_prints(docs, spec, _frequent(docs, spec)))
    nodes = prints.filter("n > 0").groupBy("sa", "sb").agg(
        F.min("doc_id").alias("low"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("pre").alias("pre"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    root = components(link_edges(docs, nodes, spec))
    owner = nodes.select("sa", "sb", "low", "node").join(root, "node", "left").select("sa", "sb", "low", F.coalesce("root", "node").alias("root"))
    owner = materialize(owner)
    best = owner.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = owner.join(best, "root").select("sa", "sb", "component_id")
    found = prints.filter("n > 0").join(classes, ["sa", "sb"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return found.union(prints.filter("n = 0").select("doc_id", F.lit(0).cast("long"), "doc_id"))
