"""Quality rules: compression bands.

A text that repeats itself compresses far better than prose of its length, and
one without structure (random strings, encoded data) far worse. Each document is
compressed with zstandard as a whole and in fixed chunks; the ratio of
compressed to raw bytes must stay inside a band that depends on the length,
because short inputs always compress worse. One bad whole-text ratio, or bad
chunks holding more than `max_bad_share` of the bytes, rejects the document.

The work is one map over the rows: no shuffle, and memory bounded by one piece
of a batch.

Defined results: a NULL or empty text has no words and fails the base rules; a
text of only white space likewise. Rows are judged one by one, so repeated rows
get equal verdicts; extra columns are dropped, an empty table stays empty.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits by length: the first row whose `upto` is at least the byte length holds.

    `limits` rows are (upto, lowest ratio, highest ratio), in rising order of
    `upto`; texts longer than the last `upto` use the last row. Texts under `judge_from` bytes are
    not judged by ratio: the frame of the format is too large a share of them.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (256, 0.42, 1.02), (512, 0.40, 0.86), (1024, 0.38, 0.80), (2048, 0.36, 0.74),
        (4096, 0.34, 0.70), (16384, 0.31, 0.66), (1 << 62, 0.27, 0.64),
    )
    chunk_bytes: int = 4096
    max_bad_share: float = 0.34
    judge_from: int = 128
    level: int = 3


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_bytes long, ratio double, n_chunks int, bad_share double, reason string"
)


def _repeat_words(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: words inside 5-word windows that occur at least twice in it."""
    n, docs = len(codes), len(first) - 1
    doc = np.repeat(np.arange(docs), np.diff(first))
    out = np.zeros(docs, np.int64)
    if n < 6:
        return out
    m = n - 4
    inside = doc[:m] == doc[4:]
    with np.errstate(over="ignore"):
        key = doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(5):
            key = tb.mix(key + codes[j:m + j].astype(np.uint64) + np.uint64(j + 1))
    at = np.flatnonzero(inside)
    at = at[np.argsort(key[at], kind="stable")]
    # Neighbours in hash order are the same window only if the text and all five words agree.
    same = (key[at][1:] == key[at][:-1]) & (doc[at][1:] == doc[at][:-1])
    for j in range(5):
        same &= codes[at[1:] + j] == codes[at[:-1] + j]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    for j in range(5):
        hit[at[twice] + j] = True
    np.add.at(out, doc[hit], 1)
    return out


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) < 2:
        return 0
    lines = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _ratios(text: bytes, bands: Bands, packer) -> tuple[float, int, float, str | None]:
    def verdict(n: int, ratio: float) -> str | None:
        if n < bands.judge_from:
            return None
        low, high = next(((a, b) for upto, a, b in bands.limits if n <= upto), bands.limits[-1][1:])
        return "repetitive" if ratio < low else "incompressible" if ratio > high else None

    n = len(text)
    whole = len(packer.compress(text)) / n
    reason = verdict(n, whole)
    chunks = range(0, n, bands.chunk_bytes)
    if len(chunks) < 2:
        return whole, len(chunks), float(reason is not None), reason
    bad = 0
    for at in chunks:
        part = text[at:at + bands.chunk_bytes]
        if verdict(len(part), len(packer.compress(part)) / len(part)):
            bad += len(part)
    share = bad / n
    return whole, len(chunks), share, reason or ("bad chunks" if share > bands.max_bad_share else None)


def _judged(batch: pa.RecordBatch, bands: Bands, packer, symbol: np.ndarray) -> list[pa.Array]:
    """All columns of `RESULT` after doc_id."""
    buf, off = tb.raw(batch.column("text"))
    start, end, first = tb.word_spans(buf, off, tb.NOT_SPACE)
    words = tb.word_array(buf, start, end).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    n_words, repeat = np.diff(first), _repeat_words(codes, first)
    chars = count(((buf & 0xC0) != 0x80) & tb.NOT_SPACE[buf])
    symbols = count(symbol[buf])
    data, rows = buf.tobytes(), []
    for i in range(len(off) - 1):
        text = data[off[i]:off[i + 1]]
        rows.append((len(text), *_ratios(text, bands, packer), _dup_lines(text)) if text else (0, None, 0, 0.0, None, 0))
    n_bytes, ratio, n_chunks, share, reason, dup = map(list, zip(*rows))
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    good = ~failed & np.array([r is None for r in reason])
    why = ["base rules" if f else r for f, r in zip(failed, reason)]
    return [
        pa.array(n_words), pa.array(chars), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(repeat), pa.array(failed), pa.array(good),
        pa.array(n_bytes, pa.int64()), pa.array(ratio, pa.float64()), pa.array(n_chunks, pa.int32()), pa.array(share, pa.float64()), pa.array(why, pa.string()),
    ]


def _tools(bands: Bands) -> tuple:
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return zstandard.ZstdCompressor(level=bands.level), symbol


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: base counts, compression figures and the verdict (`RESULT`)."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(bands)
        for batch in tb.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_judged(batch, bands, *tools)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def keep(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    at = RESULT.split(", ").index("kept boolean") - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = _tools(bands)
        for batch in tb.pieces(batches, "text"):
            yield batch.filter(_judged(batch, bands, *tools)[at])

    return docs.mapInArrow(run, docs.schema)
