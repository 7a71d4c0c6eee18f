"""Merkle manifest of a dataset in blocks of van Emde Boas layout.

Every row is a leaf: SHA-256 over its fields. The leaves of a group ascend by
the key; two neighbours (the last one may be alone) become the hash of their
digests until one is left, the group's root. The groups' roots, in order of the
group, give the dataset's root in the same way.

A tree is cut into aligned blocks of `height` levels. A block is stored as one
array of 32-byte digests in van Emde Boas order: the subtree is split at half
its height, the upper half comes first, then the lower subtrees from left to
right, each laid out likewise. The place of a node is arithmetic on its depth
and index (`address`), so construction and the retrieval of siblings touch few
neighbourhoods whatever the memory's block size. The block roots are the leaves
of the next level of blocks, and so on to the root: a handful of levels for any
number of rows.

Texts never move: digests are made in the scan. Rows are numbered by a range
exchange on (group, key) with offsets per piece, so a group that holds most of
the rows is spread like any other; a task sees one block at a time. Paths run
top-down: the path above a block is joined to it once, one row per block, and
its rows add the siblings inside it.

Defined results: a NULL field is written as "-". Rows with a NULL key come
first; rows equal in key ascend by digest. A NULL group is the first group.
Repeated rows are leaves of their own. Other columns of the input do not count
unless listed in `fields`. An empty table gives an empty manifest.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Numbered rows of a group: at most so many pieces are sent to every task.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Merkle:
    height: int = 10  # levels of a block above its leaves: 1,024 leaves a block
    rows_per_task: int = 500_000


def sha(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def address(depth: np.ndarray, index: np.ndarray, levels: int) -> np.ndarray:
    """Place of the nodes (depth from the root, index from the left) of a complete tree of `levels` levels."""
    depth, index = np.array(depth, np.int64), np.array(index, np.int64)
    left = np.full(depth.shape, levels, np.int64)
    out = np.zeros(depth.shape, np.int64)
    while (left > 1).any():
        upper = left // 2
        lower = left - upper
        below = (left > 1) & (depth >= upper)
        down = np.where(below, depth - upper, 0)
        subtree = np.where(below, index >> down, 0)
        out += np.where(below, ((1 << upper) - 1) + subtree * ((1 << lower) - 1), 0)
        index = np.where(below, index & ((1 << down) - 1), index)
        depth = np.where(below, down, depth)
        left = np.where(left > 1, np.where(below, lower, upper), left)
    return out


def build_block(digests: list[str], lift: int) -> tuple[bytes, str]:
    """(nodes in van Emde Boas order, root). A block that is not a tree's last has its root `lift` levels above its leaves."""
    levels = [digests]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha(*row[i:i + 2]) for i in range(0, len(row), 2)])
    top = len(levels) - 1
    cells = np.zeros(((1 << (top + 1)) - 1, 32), np.uint8)
    for level, row in enumerate(levels):
        place = address(np.full(len(row), top - level), np.arange(len(row)), top + 1)
        cells[place] = np.frombuffer(bytes.fromhex("".join(row)), np.uint8).reshape(-1, 32)
    root = levels[-1][0]
    for _ in range(lift - top):
        root = sha(root)
    return cells.tobytes(), root


def block_paths(nodes: bytes, size: int, at: list[int], lift: int) -> Iterator[tuple[str, str]]:
    """(siblings, turns) of the leaves `at` of a block, from the leaf up to the block's root.

    A turn is l or r (the sibling's side) or - (no sibling).
    """
    top = (size - 1).bit_length()
    leaf = np.array(at, np.int64)[:, None]
    level = np.arange(top)[None, :]
    sibling = (leaf >> level) ^ 1
    exists = sibling < -(-size // (1 << level))
    place = address(np.broadcast_to(top - level, sibling.shape), sibling, top + 1) if top else sibling
    side = np.where(exists, np.where((leaf >> level) & 1, "l", "r"), "-")
    for i in range(len(at)):
        text = "".join(nodes[32 * p:32 * p + 32].hex() for p in place[i][exists[i]].tolist())
        yield text, "".join(side[i].tolist()) + "-" * (lift - top)


def fold(start: str, siblings: str, turns: str) -> str:
    """The root recomputed from a leaf and its siblings."""
    at = 0
    for turn in turns:
        other = siblings[at:at + 64] if turn != "-" else ""
        at += len(other)
        start = sha(other, start) if turn == "l" else sha(start, other)
    return start


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 over the fields: `-` for NULL, else UTF-8 length, colon, value."""
    def one(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields.values())).cast("binary"), 256)


def leaves(docs: DataFrame, presented: dict[str, Column] | None = None, fields=FIELDS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """doc_id, tree, leaf and claim: the digest of the row as presented for verification (NULL: as it is).

    `presented` maps fields to their changed values. `tree` is the group, empty for NULL and after a + otherwise.
    """
    own = {f: F.col(f) for f in fields}
    leaf = leaf_digest(own)
    claim = leaf_digest(own | presented) if presented else leaf
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"), leaf.alias("leaf"), claim.alias("claim"))
    return rows.withColumn("claim", F.when(F.col("claim") != F.col("leaf"), F.col("claim")))


def _numbered(rows: DataFrame, order: list[str], spec: Merkle) -> DataFrame:
    """`rows` with pos, from 0 within the tree, and n, the rows of the tree. Nothing is gathered by tree."""
    spark = rows.sparkSession
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()))
    total = rows.count()
    pieces = max(-(-total // spec.rows_per_task), min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000 + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column("tree")
            code = tree.dictionary_encode().indices.to_numpy()
            start = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
            at = np.arange(len(code)) - np.repeat(start, np.diff(np.concatenate([start, [len(code)]])))
            if tree[0].as_py() == last:
                at[:start[1] if len(start) > 1 else None] += count
            last, count = tree[-1].as_py(), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), piece)), pa.array(at)], names=[*batch.schema.names, "piece", "at"])

    keys = ["tree", *order, "tie"]
    ranged = rows.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys)
    schema = rows.withColumns({"piece": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}).schema
    placed = materialize(ranged.mapInArrow(run, schema))
    sizes = materialize(placed.groupBy("tree", "piece").agg(F.count(F.lit(1)).alias("rows")))
    small = sizes.count() <= BROADCAST_ROWS
    offsets = sizes.alias("s").selectExpr(
        "tree", "piece", "coalesce(sum(rows) OVER (PARTITION BY tree ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before",
        "sum(rows) OVER (PARTITION BY tree) AS n")
    joined = placed.join(F.broadcast(offsets) if small else offsets, ["tree", "piece"])
    return joined.withColumn("pos", (F.col("at") + F.col("before")).cast("long")).drop("piece", "at", "before", "tie")


BLOCKS = "tree string, block long, n long, size int, nodes binary, root string"


def _levels(nodes: DataFrame, spec: Merkle) -> list[DataFrame]:
    """Block tables (`BLOCKS`) from the leaves up; `nodes` has tree, pos, n (nodes of the tree) and digest."""
    height, full = spec.height, 1 << spec.height

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, block = rows["n"][0].as_py(), rows["block"][0].as_py()
        cells, root = build_block(rows["digest"].to_pylist(), height if n > full else 0)
        return pa.table({"tree": [rows["tree"][0].as_py()], "block": [block], "n": [n], "size": pa.array([rows.num_rows], pa.int32()), "nodes": [cells], "root": [root]})

    out = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        keyed = nodes.select("tree", F.shiftright("pos", height).alias("block"), "pos", "n", "digest")
        blocks = materialize(keyed.groupBy("tree", "block").applyInArrow(run, BLOCKS))
        out.append(blocks)
        if most <= full:
            return out
        most = -(-most // full)
        nodes = blocks.filter(F.col("n") > full).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / full).alias("n"), F.col("root").alias("digest"))


def _roots(levels: list[DataFrame], spec: Merkle) -> DataFrame:
    """(tree, root) of every tree: its only block of the last level it has."""
    out = None
    for blocks in levels:
        last = blocks.filter(F.col("n") <= (1 << spec.height)).select("tree", "root")
        out = last if out is None else out.union(last)
    return out


def _paths_down(levels: list[DataFrame], above: DataFrame, spec: Merkle) -> DataFrame:
    """(tree, block, siblings, turns): the path from every block of the lowest level to the root.

    `above` has (tree, siblings, turns), the path of every tree's root.
    """
    height, full = spec.height, 1 << spec.height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                inner = list(block_paths(row["nodes"], row["size"], range(row["size"]), height if row["n"] > full else 0))
                first = row["block"] << height
                yield pa.RecordBatch.from_pydict({
                    "tree": [row["tree"]] * len(inner), "block": list(range(first, first + len(inner))),
                    "siblings": [s + row["siblings"] for s, _ in inner], "turns": [t + row["turns"] for _, t in inner]})

    known = None
    for blocks in reversed(levels):
        here = blocks.filter(F.col("n") <= full).select("tree", "block").join(above, "tree")
        if known is not None:
            here = here.unionByName(known)
        if blocks is levels[0]:
            return here
        joined = blocks.select("tree", "block", "n", "size", "nodes").join(here, ["tree", "block"])
        known = materialize(joined.mapInArrow(run, "tree string, block long, siblings string, turns string"))


@dataclass
class Manifest:
    rows: DataFrame  # doc_id, tree, leaf, claim, pos, n
    levels: list[DataFrame]  # blocks of the groups' trees
    top: list[DataFrame]  # blocks of the tree over the groups' roots
    subroots: DataFrame  # tree, root, member (place among the groups)
    root: str | None
    spec: Merkle


def manifest(rows: DataFrame, spec: Merkle = Merkle()) -> Manifest:
    """Number the leaves, build all blocks, and write every table."""
    rows = materialize(_numbered(rows, ["doc_id", "leaf"], spec))
    levels = _levels(rows.select("tree", "pos", "n", F.col("leaf").alias("digest")), spec)
    groups = _roots(levels, spec).select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    subroots = materialize(_numbered(groups, ["group"], spec))
    top = _levels(subroots.select("tree", "pos", "n", "digest"), spec)
    found = _roots(top, spec).first()
    return Manifest(rows, levels, top, subroots, found["root"] if found else None, spec)


PROOFS = "doc_id long, leaf string, subroot string, siblings string, turns string, folded_root string"


def prove(made: Manifest) -> DataFrame:
    """Every row with its path (`PROOFS`), the root folded from its claim, root and verified."""
    spec, full = made.spec, 1 << made.spec.height
    start = made.subroots.select("tree").distinct().select("tree", F.lit("").alias("siblings"), F.lit("").alias("turns"))
    own = _leaf_paths(
        made.subroots.select(F.shiftright("pos", spec.height).alias("block"), "pos", "tree", F.col("group").alias("name"), F.col("digest").alias("leaf")),
        made.top, start, spec, "name string, leaf string, siblings string, turns string", False)
    above = materialize(own.select(F.col("name").alias("tree"), "siblings", "turns", F.col("leaf").alias("subroot")))
    lower = _leaf_paths(
        made.rows.select(F.shiftright("pos", spec.height).alias("block"), "pos", "tree", "doc_id", "leaf", "claim"),
        made.levels, above.select("tree", "siblings", "turns"), spec, "tree string, doc_id long, leaf string, siblings string, turns string, folded_root string", True)
    out = lower.join(F.broadcast(above.select("tree", "subroot")) if above.count() <= BROADCAST_ROWS else above.select("tree", "subroot"), "tree")
    root = F.lit(made.root).cast("string")
    return out.select("doc_id", "leaf", "subroot", "siblings", "turns", "folded_root", root.alias("root"), (F.col("folded_root") == root).alias("verified"))


def _leaf_paths(rows: DataFrame, levels: list[DataFrame], above: DataFrame, spec: Merkle, result: str, folded: bool) -> DataFrame:
    """The rows of the lowest level with their whole paths, block by block."""
    height, full = spec.height, 1 << spec.height
    names = [c.split()[0] for c in result.split(", ")]
    blocks = levels[0].join(_paths_down(levels, above, spec), ["tree", "block"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0]
        lift = height if block["n"] > full else 0
        at = [p & (full - 1) for p in left["pos"].to_pylist()]
        paths = [(s + block["siblings"], t + block["turns"]) for s, t in block_paths(block["nodes"], block["size"], at, lift)]
        more = {"siblings": pa.array([s for s, _ in paths], pa.string()), "turns": pa.array([t for _, t in paths], pa.string())}
        if folded:
            starts = [c or x for c, x in zip(left["claim"].to_pylist(), left["leaf"].to_pylist())]
            more["folded_root"] = pa.array([fold(x, s, t) for x, (s, t) in zip(starts, paths)], pa.string())
        return pa.table({c: more[c] if c in more else left[c] for c in names})

    return rows.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, result)
