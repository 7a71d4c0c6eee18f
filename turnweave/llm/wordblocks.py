"""Positions of words without moving the texts: blocks with their own dictionaries.

A task cuts its documents into blocks of a few megabytes. A block keeps its
distinct words once and every text as a sequence of indices into them. What has
to be looked up in a table over the whole corpus (an encoding, a count) is then
asked once per (block, distinct word): the pair (block, index) is the position
at which the answer is joined back. Moved are the index sequences, a fraction of
the text, and the distinct words; memory is bounded by one block.

The same blocks are read twice, as words and as sequences, so the input must be
a plan that gives each task the same rows again: tables read from files do, and
`join_back` raises if an answer is missing.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

BLOCK_BYTES = 8 << 20
SEQUENCES = "block long, ids array<long>, sizes array<int>, seq binary"

# (bytes, offsets) of a batch of texts -> (all words in order, n + 1 word offsets of the texts)
Splitter = Callable[[np.ndarray, np.ndarray], tuple[pa.Array, np.ndarray]]


def _blocks(batches: Iterator[pa.RecordBatch], splitter: Splitter, block_bytes: int) -> Iterator[tuple]:
    """(number, ids, words per text, indices, dictionary, extra columns) of one block after another."""
    base, number = TaskContext.get().partitionId() << 32, 0
    held: list[tuple] = []
    size = 0

    def close() -> tuple:
        words = pa.chunked_array([w for _, w, _, _ in held], pa.string()).dictionary_encode().combine_chunks()
        if isinstance(words, pa.ChunkedArray):
            words = words.chunk(0)
        index = words.indices.to_numpy(zero_copy_only=False)
        # Frequent words get small indices, which pack better.
        order = np.argsort(-np.bincount(index, minlength=len(words.dictionary)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return (
            base + number, np.concatenate([i for i, _, _, _ in held]), np.concatenate([n for _, _, n, _ in held]),
            rank[index], words.dictionary.take(pa.array(order)), np.concatenate([f for _, _, _, f in held]),
        )

    for batch in tb.pieces(batches, "text"):
        buf, off = tb.raw(batch.column("text"))
        words, first = splitter(buf, off)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        flag = batch.column("flag").to_numpy(zero_copy_only=False)
        held.append((np.asarray(ids, np.int64), words, np.diff(first).astype(np.int32), flag))
        size += len(buf)
        if size >= block_bytes:
            yield close()
            held, size, number = [], 0, number + 1
            tb.release()
    if held:
        yield close()
    tb.release()


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as byte planes, lowest first, each compressed; the number of planes leads."""
    values = np.ascontiguousarray(values, "<u4")
    top = int(values.max()) if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 4)[:, :max((top.bit_length() + 7) // 8, 1)].T
    packer = zstandard.ZstdCompressor(level=1)
    out = [packer.compress(p.tobytes()) for p in planes]
    return bytes([len(out)]) + b"".join(len(x).to_bytes(4, "little") + x for x in out)


def unpack(data: bytes) -> np.ndarray:
    """The numbers of `pack`, as int32."""
    opener, at, out = zstandard.ZstdDecompressor(), 1, None
    for shift in range(data[0]):
        n = int.from_bytes(data[at:at + 4], "little")
        plane = np.frombuffer(opener.decompress(data[at + 4:at + 4 + n]), np.uint8)
        at += 4 + n
        out = plane.astype(np.int32) if out is None else out | (plane.astype(np.int32) << (8 * shift))
    return out


def pack_words(words: pa.Array) -> bytes:
    data, off = tb.raw(words)
    sizes = pack(np.diff(off))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(data.tobytes())


def unpack_words(packed: bytes) -> pa.Array:
    n = int.from_bytes(packed[:4], "little")
    sizes = unpack(packed[4:4 + n])
    off = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=off[1:])
    data = zstandard.ZstdDecompressor().decompress(packed[4 + n:])
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(data)])


def _source(docs: DataFrame, flag) -> DataFrame:
    """id (a NULL id is carried as the smallest long), flag and text."""
    lowest = F.lit(-(1 << 63)).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("id"), (F.lit(False) if flag is None else flag).alias("flag"), "text")


def requests_of(docs: DataFrame, splitter: Splitter, tasks: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Distinct words of the blocks, dealt by word: part, block, idx and words (packed), one row per block and part.

    All occurrences of a word in requests have the same part, the hash of the word modulo `tasks`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, _, words, _ in _blocks(batches, splitter, block_bytes):
            data, off = tb.raw(words)
            part = (tb.word_hashes(data, off[:-1], off[1:]) % np.uint64(tasks)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(tasks + 1))
            rows = [(p, order[cut[p]:cut[p + 1]]) for p in range(tasks) if cut[p + 1] > cut[p]]
            yield pa.RecordBatch.from_arrays([
                pa.array([p for p, _ in rows], pa.int32()), pa.array(np.full(len(rows), block)),
                pa.array([pack(np.diff(at, prepend=0)) for _, at in rows], pa.binary()),
                pa.array([pack_words(words.take(pa.array(at))) for _, at in rows], pa.binary()),
            ], names=["part", "block", "idx", "words"])

    return _source(docs, None).mapInArrow(run, "part int, block long, idx binary, words binary")


def lookup(requests: DataFrame, tasks: int, answer: Callable[[pa.Array], pa.ListArray], step: int = 5_000,
           done: Callable[[], None] | None = None) -> DataFrame:
    """Answer every distinct word once: block, idx, sizes and numbers (packed), one row per block and part.

    `answer` maps distinct words to lists of whole numbers. A task holds the distinct words of its part;
    with `tasks` at least the number of scan tasks, that is about as many as a block has. `done` is called
    when a task has its answers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(b, i, unpack_words(w)) for batch in batches
                 for b, i, w in zip(*[batch.column(c).to_pylist() for c in ("block", "idx", "words")])]
        if not asked:
            return
        table = pa.chunked_array([w for _, _, w in asked], pa.string()).dictionary_encode().combine_chunks()
        if isinstance(table, pa.ChunkedArray):
            table = table.chunk(0)
        place, words = table.indices.to_numpy(zero_copy_only=False), table.dictionary
        lists = [answer(words.slice(at, step)) for at in range(0, len(words), step)]
        size = np.concatenate([np.diff(tb.offsets(x)) for x in lists])
        flat = np.concatenate([np.asarray(x.flatten()) for x in lists])
        off = np.concatenate([[0], np.cumsum(size)])
        at = 0
        if done:
            done()
        del lists, words, table
        tb.release()
        for block, idx, w in asked:
            here = place[at:at + len(w)]
            at += len(w)
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([idx], pa.binary()), pa.array([pack(size[here])], pa.binary()), pa.array([pack(gather(flat, off, here))], pa.binary()),
            ], names=["block", "idx", "sizes", "numbers"])

    return requests.repartitionById(tasks, "part").mapInArrow(run, "block long, idx binary, sizes binary, numbers binary")


def gather(flat: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The lists flat[off[i]:off[i + 1]] for i in `at`, one after another."""
    size = (off[1:] - off[:-1])[at]
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(off[:-1][at] - ends + size, size) + np.arange(ends[-1])]


def sequences_of(docs: DataFrame, splitter: Splitter, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block: document ids, words per document and the packed indices (`SEQUENCES`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, index, words, _ in _blocks(batches, splitter, block_bytes):
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([pack(index)], pa.binary()),
            ], names=["block", "ids", "sizes", "seq"])

    return _source(docs, None).mapInArrow(run, SEQUENCES)


BLOCKS = "block long, ids array<long>, sizes array<int>, flags array<boolean>, seq binary, words array<string>, n_flagged array<long>"


def blocks_of(docs: DataFrame, splitter: Splitter, flag, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole blocks, one row each (`BLOCKS`): to be written once where they are read several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, sizes, index, words, flags in _blocks(batches, splitter, block_bytes):
            flags = flags.astype(bool)
            flagged = np.bincount(index[np.repeat(flags, sizes)], minlength=len(words))
            one = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                pa.array([flags], pa.list_(pa.bool_())), pa.array([pack(index)], pa.binary()),
                pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(flagged)),
            ], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return _source(docs, flag).mapInArrow(run, BLOCKS)


Fold = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def join_back(answers: DataFrame, sequences: DataFrame, result: str, fold: Fold, order: str | None = None) -> DataFrame:
    """Answers meet the sequences of their block.

    `fold(answers of the block, ids, words per text, indices)` returns the rows of a block; answers
    of one row per word come in the order of the column `order`.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            raise RuntimeError("answers for a block that the second reading did not make: the input plan is not deterministic")
        row = right.slice(0, 1).to_pydict()
        index = unpack(row["seq"][0])
        if order:
            left = left.sort_by(order)
        tb.release()
        return fold(left, np.array(row["ids"][0], np.int64), np.array(row["sizes"][0], np.int64), index)

    return answers.groupBy("block").cogroup(sequences.groupBy("block")).applyInArrow(run, result)


def check_places(index: np.ndarray, answers: int) -> None:
    if (int(index.max()) + 1 if len(index) else 0) != answers:
        raise RuntimeError("a block lacks answers: the input plan is not deterministic")


def real_id(column: str = "doc_id"):
    return F.when(F.col(column) > -(1 << 63), F.col(column))
