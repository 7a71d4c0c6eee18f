"""Whole-batch text work on Arrow buffers, shared by the operators that split words in Python.

An Arrow string column is one byte buffer plus offsets, so a batch of documents
is split, hashed and counted with a few numpy passes, without a Python object
per word. NULL texts count as empty ones. Batches are cut so that one piece
holds about `MAX_BYTES` of text (a longer single text is a piece of its own,
and is never shortened).
"""
from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MAX_BYTES = 2 << 20

_SPACE = [0x20, *range(0x09, 0x0E)]
# Bytes of words for the pattern [^\x20\x09-\x0D]+ ; UTF-8 continuation bytes are all word bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[_SPACE] = False
# Bytes of words for the pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def pieces(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `max_bytes` of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off = offsets(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
    release()


def release() -> None:
    """Give freed buffers back to the system; a worker that waits for its next task keeps none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def offsets(column: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buf = column.buffers()[1]
    if buf is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(buf, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets from 0). A NULL text is empty."""
    if column.null_count:
        column = column.fill_null("")
    off, data = offsets(column), column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def raw_bytes(column: pa.Array) -> bytes:
    """The bytes of a binary array without NULLs, one value after another."""
    off, data = offsets(column), column.buffers()[2]
    return b"" if data is None else memoryview(data)[off[0]:off[-1]].tobytes()


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte kept."""
    return _LOWER[buf]


def word_spans(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) bytes of all words and the n + 1 word offsets of the texts."""
    mask = np.zeros(len(buf) + 2, bool)
    mask[1:-1] = is_word[buf]
    # A word begins after a non-word byte or at the start of its text, and ends likewise.
    begin, finish = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    edge = off[(off > 0) & (off < len(buf))]
    begin[edge] = mask[1:-1][edge]
    finish[edge - 1] = mask[1:-1][edge - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(start, off)


def word_array(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as one Arrow string array (the bytes between words are dropped)."""
    length = end - start
    keep = np.zeros(len(buf) + 1, np.int8)
    np.add.at(keep, start, 1)
    np.add.at(keep, end, -1)
    data = buf[np.cumsum(keep[:-1]).astype(bool)]
    off = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=off[1:])
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data)])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: polynomial prefix sums, then `mix`."""
    base = int(_BASE) | 1
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power_table(base, len(buf)), out=sums[1:])
        poly = (sums[end] - sums[start]) * _power_table(inverse, len(buf) + 1)[start]
    return mix(poly + mix((end - start).astype(np.uint64)))
