"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into the words of the byte-level pre-tokenizer (contractions,
runs of letters, digits or other signs with one leading space, white space).
Each distinct word of the corpus is encoded once, by the tokenizers library; the
ids are joined back by position (see `wordblocks`). Decoding looks every id up
in the id-to-piece table, whose size is the vocabulary's, and joins the pieces.

The split works on code points of a whole batch: word borders are where the
character class changes. A special token in a text is one word of its own, as
in the library with its default settings.

Defined results: a NULL text is an empty one: no ids, decoded empty. Repeated
rows give repeated rows. Extra columns are dropped, an empty table stays empty.
"""
from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from . import wordblocks as wb

BLOCK_BYTES = 4 << 20
SPACE, LETTER, DIGIT, OTHER = range(4)
# White_Space property of Unicode (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions of the pre-tokenizer, after the apostrophe (fixed values).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = DIGIT
    table[WHITE_SPACE] = SPACE
    return table


def word_splitter(special: tuple[str, ...] = ()) -> wb.Splitter:
    """A splitter giving the pre-tokenizer's words; every byte belongs to exactly one word."""
    marks = [s.encode() for s in special if s]

    def split(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        data = buf.tobytes()
        cp = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(cp)
        at_byte = np.flatnonzero((buf & 0xC0) != 0x80)  # byte of each code point
        edges = np.searchsorted(at_byte, off)  # code point at which each text begins
        stops = [edges]
        inner: list[tuple[int, int]] = []
        for mark in marks:
            p = data.find(mark)
            while p >= 0:
                if off[np.searchsorted(off, p, side="right")] >= p + len(mark):  # within one text
                    a, b = np.searchsorted(at_byte, [p, p + len(mark)])
                    inner.append((int(a), int(b)))
                    stops.append(np.array([a, b]))
                p = data.find(mark, p + len(mark))
        fresh = np.zeros(n + 1, bool)  # a text, or a part beside a special token, begins here
        fresh[np.concatenate(stops)] = True
        kind = _classes()[cp]
        prev = np.concatenate([[255], kind[:-1]]).astype(np.uint8)
        prev[fresh[:n]] = 255
        blank = np.concatenate([[False], cp[:-1] == 0x20]) & ~fresh[:n]  # the character before is a plain space
        run = kind != prev
        start = run & ~(blank & (kind != SPACE))
        # The last white space before a word stands alone or leads it.
        nxt = np.concatenate([kind[1:], [SPACE]])
        nxt[np.flatnonzero(fresh[1:])] = SPACE
        start |= (kind == SPACE) & (nxt != SPACE)
        # Contractions: an apostrophe that is a run by itself, without a space that leads it.
        quote = np.flatnonzero((cp == 0x27) & run & ~blank & (nxt == LETTER))
        if len(quote):
            padded = np.concatenate([cp, np.zeros(3, np.uint32)])
            for q in quote:
                tail = "".join(map(chr, padded[q + 1:q + 3]))
                hit = next((c for c in CONTRACTIONS if tail.startswith(c) and (len(c) == 1 or not fresh[q + 2])), None)
                if hit:
                    start[q + 1] = False
                    end = q + 1 + len(hit)
                    if end < n and not fresh[end] and kind[end] == LETTER:
                        start[end] = True
        start |= fresh[:n]
        for a, b in inner:
            start[a + 1:b] = False
        begin = np.flatnonzero(start)
        cut = np.concatenate([at_byte[begin], [len(buf)]]).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(cut), pa.py_buffer(data)])
        return words, np.searchsorted(begin, edges)

    return split


@lru_cache(maxsize=2)
def _load(spec: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _special(spec: str) -> tuple[str, ...]:
    return tuple(t["content"] for t in json.loads(spec)["added_tokens"])


def read_spec(path: str) -> str:
    """The tokenizer's file as text; it travels with the plan (a few megabytes, by its vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _answers(docs: DataFrame, spec: str, splitter: wb.Splitter, block_bytes: int) -> DataFrame:
    """The ids of every distinct word, by block and index."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast(spec)
    tasks = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def answer(words: pa.Array) -> pa.ListArray:
        ids = [e.ids for e in _load(share.value).encode_batch(words.to_pylist(), add_special_tokens=False)]
        return pa.array(ids, pa.list_(pa.int32()))

    # A worker that waits for its next task keeps no tokenizer.
    return wb.lookup(wb.requests_of(docs, splitter, tasks, block_bytes), tasks, answer, done=_load.cache_clear)


def _texts(answers: pa.Table, sizes: np.ndarray, index: np.ndarray, words: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, ids per text) of a block, for texts of about `words` words at a time."""
    place, size, flat = ([wb.unpack(x) for x in answers.column(c).to_pylist()] for c in ("idx", "sizes", "numbers"))
    place = np.concatenate([np.cumsum(x, dtype=np.int32) for x in place] or [np.zeros(0, np.int32)])
    wb.check_places(index, len(place))
    size = np.concatenate(size or [place])
    flat = np.concatenate(flat or [place])
    off = np.concatenate([[0], np.cumsum(size)])
    # Into index order: the list of index i is number at[i].
    at = np.empty(len(place), np.int32)
    at[place] = np.arange(len(place), dtype=np.int32)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(sizes):
        last = max(int(np.searchsorted(ends, ends[first] + words, side="right")) - 1, first + 1)
        here = at[index[ends[first]:ends[last]]]
        n = np.concatenate([[0], np.cumsum(size[here])])
        yield wb.gather(flat, off, here), np.diff(n[ends[first:last + 1] - ends[first]])
        first = last


def encode(docs: DataFrame, spec: str, block_bytes: int = BLOCK_BYTES, packed: bool = False) -> DataFrame:
    """doc_id and `tokens`, the ids of the whole text, one row per document row.

    Tokens are an array of ints or, `packed`, the ids as little-endian unsigned 32-bit integers.
    """
    splitter = word_splitter(_special(spec))

    def fold(answers: pa.Table, ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> pa.Table:
        tokens, counts = zip(*_texts(answers, sizes, index))
        cut = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        flat = np.concatenate(tokens).astype("<u4" if packed else np.int32)
        if packed:
            tokens = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((4 * cut).astype(np.int32)), pa.py_buffer(flat)])
        else:
            tokens = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat))
        return pa.table({"doc_id": pa.array(ids), "tokens": tokens})

    answers = _answers(docs, spec, splitter, block_bytes)
    joined = wb.join_back(answers, wb.sequences_of(docs, splitter, block_bytes), f"doc_id long, tokens {'binary' if packed else 'array<int>'}", fold)
    return joined.select(wb.real_id().alias("doc_id"), "tokens")


def pieces(spec: str) -> pa.Array:
    """The id-to-piece table: bytes of every id."""
    # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    content = json.loads(spec)
    tokens = {i: t for t, i in content["model"]["vocab"].items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
    found = []
    for i in range(max(tokens, default=-1) + 1):
        token = tokens.get(i, "")
        known = all(c in byte_of for c in token)
        found.append(bytes(byte_of[c] for c in token) if known else token.encode())
    return pa.array(found, pa.binary())


def _piece_texts(table: pa.Array, flat: np.ndarray, off: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
    """The joined pieces of the lists flat[off[i]:off[i + 1]], rows of about `step` ids at a time."""
    first = 0
    while first < len(off) - 1:
        last = max(int(np.searchsorted(off, off[first] + step, side="right")) - 1, first + 1)
        found = table.take(pa.array(flat[off[first]:off[last]]))
        ends = tb.offsets(found)
        data, cut = tb.raw_bytes(found), ends[off[first:last + 1] - off[first]] - ends[0]
        for a, b in zip(cut[:-1], cut[1:]):
            yield data[a:b]
        first = last


def decode(encoded: DataFrame, spec: str, tokens: str = "tokens") -> DataFrame:
    """The same rows with `decoded`: the pieces of the ids (an array or packed), joined; invalid UTF-8 becomes U+FFFD."""
    share = encoded.sparkSession.sparkContext.broadcast(pieces(spec))
    names = encoded.columns
    schema = encoded.withColumn("decoded", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names.index(tokens))
            off = tb.offsets(lists)
            if pa.types.is_binary(lists.type):
                flat, off = np.frombuffer(tb.raw_bytes(lists), "<u4"), (off - off[0]) // 4
            else:
                flat = np.asarray(lists.values)
            texts = [x.decode("utf-8", "replace") for x in _piece_texts(share.value, flat, off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def tokenizer_path() -> str:
    """The public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """Encode with the byte-level vocabulary and decode again: doc_id, n_tokens and the digests of ids and decoded text.

    The task that joins the ids back looks up their pieces too, so ids and decoded texts stay in one worker.
    """
    spec = read_spec(tokenizer_path())
    splitter = word_splitter(_special(spec))
    share = docs.sparkSession.sparkContext.broadcast(pieces(spec))

    def fold(answers: pa.Table, ids: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> pa.Table:
        counts, coded, plain = [], [], []
        for flat, n in _texts(answers, sizes, index):
            off = np.concatenate([[0], np.cumsum(n)])
            raw = memoryview(flat.astype("<u4")).cast("B")
            counts.append(n)
            coded += [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            plain += [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in _piece_texts(share.value, flat, off)]
        return pa.table({"doc_id": pa.array(ids), "n_tokens": pa.array(np.concatenate(counts).astype(np.int64)), "ids_sha256": coded, "decoded_sha256": plain})

    joined = wb.join_back(_answers(docs, spec, splitter, BLOCK_BYTES), wb.sequences_of(docs, splitter, BLOCK_BYTES), DIGESTS, fold)
    return joined.withColumn("doc_id", wb.real_id())
