"""Filter interaction audit by incremental retraction streaming.

What would each filter remove, and in which order? All files of a table are
processed as available-now micro-batches. A document fails any of five filters,
a mask of five bits: A few words, B few distinct words, C many capitals, D odd
symbols, E a text that a smaller doc_id has too. A to D depend on the text
alone; E depends on the whole table, so it is only known as far as the stream
has come. The state, keyed by text, holds the smallest id met so far and its
rows. When a smaller id arrives, the masks of the earlier owner are taken back
from the part counters (-1 without E) and entered anew (+1 with E). Every batch
writes its changes under its own number; a batch that is run again overwrites
them, and their sum is right after any number of batches in any order.

A state key is a group of some hundred texts (`texts_per_key`), so that the cost
of a call is shared; each text in it has its own minimum. Within a task copies
are combined first: only the smallest id of a text travels on, all others fail
E whatever comes and go to the counters as sums. A text that holds a third of
all rows is thus one row per task. The counters have at most 32 masks x 4 labels
per part, and the 120 orders are sums over them: five filters in any order need
no second look at a document.

Defined results: a NULL text is empty (and equal to other empty texts). A NULL
doc_id neither fails E nor makes another row fail. Rows equal in doc_id and text
fail E together or not at all. Several label rows of a doc_id count as their
maximum. A NULL part is the empty string. Extra columns are not read. An empty
table gives no rows.
"""
from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..runtime import materialize, run_dir

FILTERS = "ABCDE"
SAME = 1 << FILTERS.index("E")


@dataclass(frozen=True)
class Audit:
    few_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 3
    symbols: str = "[#$%&*|]"
    batches: int = 4  # micro-batches wanted; a file is never divided between two
    texts_per_key: int = 512


def text_masks(text: Column, spec: Audit) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < spec.few_words, 100 * distinct < spec.distinct_percent * n, 100 * capitals > spec.capital_percent * F.length(text), text.rlike(spec.symbols)]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def _slim(docs: DataFrame, labels: DataFrame, spec: Audit) -> DataFrame:
    """id, part, digest of the text, bits (A to D) and label (1: good, 2: toxic)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_masks(text, spec).alias("bits"))
    # A row without id takes a key of its own (repeatable: a fixed seed over the file order), so that such rows spread.
    rows = rows.withColumn("k", F.coalesce("id", F.xxhash64("digest", F.rand(7))))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("k")).agg(
        (F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)) + 2 * F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0))).alias("label"))
    label = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("label", F.lit(0)))
    return rows.join(marks, "k", "left").select("id", "part", "digest", "bits", label.alias("label"))


ARRIVALS = "key long, digest binary, id long, part string, bits int, label int, n long, settled boolean"


def _combine(keys: int, limit: int = 100_000):
    """Per task: the rows with the smallest id of each text, and sums of the rows whose mask is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, Counter]] = {}
        settled: Counter = Counter()

        def flush() -> pa.RecordBatch:
            here = TaskContext.get().partitionId() % keys
            rows = [(int.from_bytes(d[:7], "big") % keys, d, i, part, bits, label, n, False)
                    for d, (i, bits, own) in held.items() for (part, label), n in own.items()]
            rows += [(here, b"", 0, part, bits, label, n, True) for (part, bits, label), n in settled.items()]
            held.clear()
            settled.clear()
            types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in ARRIVALS.split(", ")])

        for batch in batches:
            for i, part, digest, bits, label in zip(*[batch.column(c).to_pylist() for c in ("id", "part", "digest", "bits", "label")]):
                if i is None:
                    settled[part, bits, label] += 1
                    continue
                first = held.get(digest)
                if first is not None and i > first[0]:
                    settled[part, bits | SAME, label] += 1
                    continue
                if first is None or i < first[0]:
                    if first is not None:
                        for (p, l), n in first[2].items():
                            settled[p, bits | SAME, l] += n
                    first = held[digest] = (i, bits, Counter())
                first[2][part, label] += 1
            if len(held) >= limit:
                yield flush()
        yield flush()

    return run


DELTAS = "part string, mask int, label int, delta long"


def _update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Changes of the part counters from the arrivals of one key; the state has (smallest id, its rows) per text."""
    held = pickle.loads(state.get[0]) if state.exists else {}
    delta: Counter = Counter()
    for frame in frames:
        for _, digest, i, part, bits, label, n, settled in frame.itertuples(index=False):
            if settled:
                delta[part, bits, label] += n
                continue
            digest = bytes(digest)
            first, own = held.get(digest, (None, {}))
            if first is not None and i > first:
                delta[part, bits | SAME, label] += n
                continue
            if first is None or i < first:
                for (p, l), m in own.items():  # a smaller id: the earlier masks are retracted
                    delta[p, bits, l] -= m
                    delta[p, bits | SAME, l] += m
                own = {}
                held[digest] = (i, own)
            own[part, label] = own.get((part, label), 0) + n
            delta[part, bits, label] += n
    state.update((pickle.dumps(held),))
    changed = [(*k, n) for k, n in delta.items() if n]
    yield pd.DataFrame(changed, columns=["part", "mask", "label", "delta"]).astype({"mask": "int32", "label": "int32", "delta": "int64"})


def _source(spark: SparkSession, path: str) -> tuple[str, int]:
    """(path for the stream, bytes). A stream reads folders or globs, so a single file is written as a glob."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(place).isFile():
        path = f"{place.getParent()}/{{{place.getName()}}}"
    return path, files.getContentSummary(place).getLength()


def counters(spark: SparkSession, path: str, labels: DataFrame, spec: Audit = Audit()) -> DataFrame:
    """Run the stream over the files at `path`: part, mask, label, n, as a written table."""
    given = spark.read.parquet(path)
    keys = max(given.count() // spec.texts_per_key, 1)
    files, size = _source(spark, path)
    stream = spark.readStream.schema(given.schema).option("maxBytesPerTrigger", max(size // spec.batches, 1)).parquet(files)
    folder = f"{run_dir(spark)}/audit-{uuid.uuid4().hex}"
    marks = materialize(labels.select("doc_id", "quality", "toxic"))
    arrivals = _slim(stream, marks, spec).mapInArrow(_combine(keys), ARRIVALS)
    changes = arrivals.groupBy("key").applyInPandasWithState(_update, DELTAS, "texts binary", "update", GroupStateTimeout.NoTimeout)

    def fold(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "mask", "label").agg(F.sum("delta").alias("delta")).write.mode("overwrite").parquet(f"{folder}/changes/{number}")

    query = changes.writeStream.outputMode("update").foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress and not given.isEmpty():
        raise RuntimeError("the stream made no batch although the table has rows")
    if given.isEmpty():
        return spark.createDataFrame([], "part string, mask int, label int, n long")
    changed = spark.read.schema(DELTAS).parquet(f"{folder}/changes/*")
    return changed.groupBy("part", "mask", "label").agg(F.sum("delta").alias("n")).filter("n <> 0")


REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def _orders() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """(orders, filter number of each of the 600 rows, row x mask selectors)."""
    masks = np.arange(1 << len(FILTERS))
    names, which, rows = [], [], {"removed": [], "redundant": [], "kept": [], "unique": []}
    for order in permutations(range(len(FILTERS))):
        names.append("".join(FILTERS[f] for f in order))
        before = 0
        for f in order:
            fails, earlier = (masks >> f) & 1 > 0, masks & before > 0
            rows["removed"].append(fails & ~earlier)
            rows["redundant"].append(fails & earlier)
            rows["kept"].append(~fails & ~earlier)
            rows["unique"].append(masks == 1 << f)
            which.append(f)
            before |= 1 << f
    return names, np.array(which), {k: np.array(v, np.int64) for k, v in rows.items()}


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, which, select = _orders()
    for batch in batches:
        for row in batch.to_pylist():
            n = np.zeros((3, 1 << len(FILTERS)), np.int64)  # all, good, toxic
            for c in row["counts"]:
                n[0, c["mask"]] += c["n"]
                n[1, c["mask"]] += c["n"] * (c["label"] & 1)
                n[2, c["mask"]] += c["n"] * (c["label"] >> 1)
            removed, good, toxic = select["removed"] @ n.T[:, 0], select["removed"] @ n.T[:, 1], select["removed"] @ n.T[:, 2]
            shapley = np.array([removed[which == f].sum() for f in range(len(FILTERS))])
            yield pa.RecordBatch.from_pydict({
                "part": [row["part"]] * len(which), "filter_order": [x for x in names for _ in FILTERS],
                "step": pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(names))), "kept": select["kept"] @ n[0], "removed": removed,
                "redundant": select["redundant"] @ n[0], "unique_fails": select["unique"] @ n[0], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[which]})


def audit(spark: SparkSession, path: str, labels: DataFrame, spec: Audit = Audit()) -> DataFrame:
    """One row per part, order of the filters and step (`REPORT`)."""
    counts = counters(spark, path, labels, spec)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "label", "n")).alias("counts"))  # at most 128
    return by_part.mapInArrow(_report, REPORT)
