"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut further into pieces of at most `span`
words, so nothing is dropped). A sentence's probability is logistic in its
hashed words; the document's is the noisy-or, 1 - prod(1 - p). Only documents
have labels: the noisy-or likelihood passes each document's gradient to the
sentences that explain it, and the trained sentence scores then locate the
offending ones.

The classifier is fitted on at most `max_docs` labelled rows, taken in the order
of a hash of doc_id; their hashed features go to one task, the weights (of fixed
size) to the driver. Scoring is one map over all rows.

Defined results: a NULL text is an empty one; without words the bag is empty
and the score 0. A doc_id with several labels counts as toxic if any is 1; a
NULL label or doc_id teaches nothing. Without training rows, or with one class
only, every sentence gets the bias alone (about the class's rate). Repeated rows
get equal scores; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb


@dataclass(frozen=True)
class Mil:
    bits: int = 17
    prefixes: tuple[int, ...] = (4, 5)  # a word's first bytes, as features beside the word
    span: int = 32
    max_docs: int = 12_000
    epochs: int = 20
    min_steps: int = 900
    batch: int = 256
    rate: float = 0.05
    l1: float = 0.2
    min_docs: int = 5  # features of fewer sampled documents are not used
    seed: int = 7


@dataclass
class Model:
    weights: np.ndarray
    bias: float


_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


def _sentences(buf: np.ndarray, off: np.ndarray, spec: Mil) -> tuple[np.ndarray, ...]:
    """Feature and sentence of every word and prefix; the text, first and last byte of every sentence."""
    low = tb.lower_ascii(buf)
    start, end, first = tb.word_spans(low, off, tb.ALNUM)
    length = end - start
    forms = [tb.word_hashes(low, start, end)]
    for n in spec.prefixes:  # inflected and disguised forms share their beginnings
        forms.append(np.where(length > n, tb.mix(tb.word_hashes(low, start, np.minimum(end, start + n)) + np.uint64(n)), forms[0]))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    mark = np.cumsum(_BREAK[buf])[start] if len(start) else np.zeros(0, np.int64)
    fresh = np.ones(len(start), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (mark[1:] != mark[:-1])
    heads = np.flatnonzero(fresh)
    within = np.arange(len(start)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(start)]])))
    fresh |= within % spec.span == 0
    heads = np.flatnonzero(fresh)
    last = np.concatenate([heads[1:], [len(start)]]) - 1
    feature = (np.concatenate(forms) >> np.uint64(64 - spec.bits)).astype(np.int64)
    return feature, np.tile(np.cumsum(fresh) - 1, len(forms)), text[heads], start[heads], end[last] if len(heads) else end


def _once(feature: np.ndarray, sentence: np.ndarray, spec: Mil) -> tuple[np.ndarray, np.ndarray]:
    """The pairs without repeats: a word counts once in a sentence."""
    pair = np.unique((sentence << spec.bits) + feature)
    return pair & ((1 << spec.bits) - 1), pair >> spec.bits


def _bags(spec: Mil):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.pieces(batches, "text"):
            buf, off = tb.raw(batch.column("text"))
            feature, sentence, text, _, _ = _sentences(buf, off, spec)
            feature, sentence = _once(feature, sentence, spec)
            word_text = text[sentence]
            first = np.searchsorted(text, np.arange(batch.num_rows))
            cut = np.searchsorted(word_text, np.arange(batch.num_rows + 1)).astype(np.int32)
            local = sentence - first[word_text]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("toxic"),
                pa.ListArray.from_arrays(cut, pa.array(feature, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(local, pa.int32())),
            ], names=["doc_id", "toxic", "features", "sentences"])

    return run


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], spec: Mil) -> Model:
    """Noisy-or likelihood by Adam with soft-thresholded weights. bags: (label, features, sentence numbers)."""
    n = 1 << spec.bits
    w, b = np.zeros(n), -4.0
    m, v, mb, vb, step = np.zeros(n), np.zeros(n), 0.0, 0.0, 0
    order = np.random.default_rng(spec.seed)
    if len({y for y, _, _ in bags}) < 2:
        return Model(w, -12.0 if not any(y for y, _, _ in bags) else 12.0)
    seen = np.zeros(n, np.int64)
    for _, f, _ in bags:
        seen[np.unique(f)] += 1
    common = seen >= spec.min_docs
    bags = [(y, f[common[f]], s[common[f]]) for y, f, s in bags]
    # A small sample is gone through more often.
    for _ in range(max(spec.epochs, spec.min_steps * spec.batch // len(bags))):
        shuffled = order.permutation(len(bags))
        for at in range(0, len(bags), spec.batch):
            part = [bags[i] for i in shuffled[at:at + spec.batch] if len(bags[i][1])]
            if not part:
                continue
            sizes = [int(s[-1]) + 1 for _, _, s in part]
            base = np.cumsum([0] + sizes)
            feature = np.concatenate([f for _, f, _ in part])
            sentence = np.concatenate([s + o for (_, _, s), o in zip(part, base)])
            bag = np.repeat(np.arange(len(part)), sizes)
            label = np.array([y for y, _, _ in part], float)
            z = np.bincount(sentence, w[feature], base[-1]) + b
            total = np.maximum(np.bincount(bag, np.logaddexp(0, z), len(part)), 1e-9)
            slope = np.where(label > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0)
            dz = np.maximum(slope[bag] / (1 + np.exp(-z)), -5.0) / len(part)
            g, gb = np.bincount(feature, dz[sentence], n), dz.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
            w -= spec.rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
            w = np.sign(w) * np.maximum(np.abs(w) - spec.rate * spec.l1, 0)
            b -= spec.rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return Model(w, float(b))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, spec: Mil = Mil()) -> Model:
    """Fit on the labelled rows for which `usable` (a condition on doc_id) holds."""
    sample = (
        labels.filter(usable).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.max_docs)
    )
    bags = (
        docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")
        .mapInArrow(_bags(spec), "doc_id long, toxic int, features array<int>, sentences array<int>")
        .groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("features").alias("features"), F.first("sentences").alias("sentences"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, toxic = batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist()
            for i, (doc, y) in enumerate(zip(ids, toxic)):
                rows.append((doc, y, batch.column("features")[i].values.to_numpy(), batch.column("sentences")[i].values.to_numpy()))
        rows.sort(key=lambda r: r[0])  # the order of arrival is not fixed
        model = train([r[1:] for r in rows], spec)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.bias])], names=["weights", "bias"])

    row = bags.repartition(1).mapInArrow(run, "weights binary, bias double").collect()
    if not row:
        return Model(np.zeros(1 << spec.bits), -12.0)
    return Model(np.frombuffer(row[0].weights, "<f4").astype(float), row[0].bias)


def score(docs: DataFrame, model: Model, spec: Mil = Mil(), offending: float = 0.5) -> DataFrame:
    """doc_id, score, and `sentences`: text and probability of every sentence at or above `offending`."""
    share = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = share.value
        for batch in tb.pieces(batches, "text"):
            buf, off = tb.raw(batch.column("text"))
            feature, sentence, text, start, end = _sentences(buf, off, spec)
            feature, sentence = _once(feature, sentence, spec)
            z = np.bincount(sentence, w[feature], len(text)) + b if len(text) else np.zeros(0)
            total = np.bincount(text, np.logaddexp(0, z), batch.num_rows) if len(text) else np.zeros(batch.num_rows)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            data, p = buf.tobytes(), 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            for i in np.flatnonzero(p >= offending):
                found[text[i]].append({"sentence": data[start[i]:end[i]].decode("utf-8", "replace"), "p": float(p[i])})
            kind = pa.list_(pa.struct([("sentence", pa.string()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(-np.expm1(-total)), pa.array(found, kind)], names=["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, sentences array<struct<sentence:string,p:double>>")
