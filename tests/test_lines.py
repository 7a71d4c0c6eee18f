"""Line stores, carried sums, selection by threshold and long-form doses, with a hot record cut into pieces."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from turnweave.operators import linestore as ls
from turnweave.operators import skew
from turnweave.operators.monologue import build_monologues
from turnweave.operators.turns import KEYS
from turnweave.plans import conditions as co
from turnweave.plans import dose as do
from turnweave.plans import line_doses as ld

SCHEMA = "conversation_id string, speaker_id string, utt_seq long, text string, start_time double, end_time double"
TEXTS = ["えっと、今日は寒い(L)ので帰ろうと思います", "うん、そう", "なるほど", "へえ、そう", "", " ", "あの、えー\nそれで\n", "はい", "ああ", None, "えっと", "明日(F えっと)も、寒い"]


@pytest.fixture(scope="module")
def utterances(spark):
    """One record holds most of the rows; others are blank, empty or a single line. Times repeat."""
    rng = random.Random(5)
    rows = [("c0", "A", i, rng.choice(TEXTS), float(i // 7) if i % 5 else None, None) for i in range(90)]
    rows += [("c0", "B", 200 + i, rng.choice(TEXTS), 1.0, float(i)) for i in range(6)]
    rows += [("c1", "A", 1, " ", 0.0, None), ("c1", "A", 2, None, 0.0, None), ("c2", "A", 1, "\n寒い\n\n", 0.0, None), ("c3", "B", 1, "あの、寒い", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def pairs_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_hot_record_is_cut_and_equals_the_cell(spark, utterances):
    store = ls.line_store(utterances, rows_per_task=10)
    cells = build_monologues(utterances)
    assert store.lines.filter("conversation_id = 'c0' AND speaker_id = 'A'").select("segment").distinct().count() >= 4
    assert pairs_of(ls.assemble(store.lines), *KEYS, "text") == pairs_of(cells, *KEYS, "text")
    assert pairs_of(store.records, *KEYS, "n_utt", "n_chars") == pairs_of(cells, *KEYS, "n_utt", "n_chars")
    sizes = cells.select(*KEYS, F.size(F.split("text", "\n")).alias("n"))
    assert pairs_of(store.records, *KEYS, "n_lines") == pairs_of(sizes, *KEYS, "n")
    heads = cells.select(*KEYS, F.substring(F.translate("text", "\n", " "), 1, 20).alias("h"))
    assert pairs_of(ls.line_heads(store.lines, 20), *KEYS, "head200") == pairs_of(heads, *KEYS, "h")


def test_restriction_to_pairs_and_an_empty_table(spark, utterances):
    pairs = spark.createDataFrame([("c2", "A"), ("c9", "Z")], "conversation_id string, speaker_id string")
    assert pairs_of(ls.line_store(utterances, pairs).lines, *KEYS, "line", "text") == [("c2", "A", 0, "寒い")]
    empty = ls.line_store(utterances.filter("false"))
    assert empty.lines.count() == empty.records.count() == 0
    assert ld.filler_levels(empty.lines).count() == ld.line_levels(empty.lines, do.YESNO).count() == 0


def test_written_files_hold_segments_in_order(spark, utterances, tmp_path):
    store = ls.line_store(utterances, rows_per_task=10)
    ls.write_ordered(store.lines, str(tmp_path / "lines"))
    lines = []
    for file in sorted(tmp_path.glob("lines/part-*.parquet")):
        rows = spark.read.parquet(str(file)).filter("conversation_id = 'c0' AND speaker_id = 'A'").orderBy(F.monotonically_increasing_id()).collect()
        lines += [r.line for r in rows]
    assert lines == sorted(lines) and len(lines) > 40


@pytest.mark.parametrize("feature", ["FILL", "YESNO", "OIR"])
def test_long_doses_equal_the_cell_form(spark, utterances, feature):
    lines = ls.line_store(utterances, rows_per_task=10).lines
    rule = do.RULES[feature]
    long = ld.filler_levels(lines, rule, rows_per_task=10) if feature == "FILL" else ld.line_levels(lines, rule, rows_per_task=2)
    cell = do.dose_table(build_monologues(utterances), feature)
    assert pairs_of(ls.assemble(long, [*KEYS, "dose_level"]), *KEYS, "dose_level", "text") == pairs_of(cell, *KEYS, "dose_level", "text")


def test_long_counts_and_shuffle_equal_the_cell_form(spark, utterances):
    store, cells = ls.line_store(utterances, rows_per_task=10), build_monologues(utterances)
    want = cells.select(*KEYS, *[c.cast("long").alias(n) for n, c in do.text_counts(F.col("text")).items()])
    assert pairs_of(ld.text_counts(store.lines), *KEYS, *do.COUNTERS) == pairs_of(want, *KEYS, *do.COUNTERS)
    assert pairs_of(ls.assemble(ld.shuffle_lines(store)), *KEYS, "text") == pairs_of(co.shuffle_texts(cells), *KEYS, "text")


def test_no_window_or_array_spans_a_record(spark, utterances):
    lines = ls.line_store(utterances).lines
    plan = ld.line_levels(lines, do.YESNO)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"windowspecdefinition\([^)]*", plan)
    assert windows and all("_b#" in w for w in windows) and "collect_list" not in plan


def test_carried_sums_of_arbitrary_weights(spark):
    rows = [("k", i, (i * 37) % 11) for i in range(500)] + [("j", i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i long, w long").repartition(7)
    got = skew.carried_sums(df, ["k"], [F.desc("i")], {"before": F.col("w"), "n": F.lit(1)}, 6)
    assert got.filter("k = 'k'").select("chunk").distinct().count() >= 4
    want = {(k, i): (sum(w for a, b, w in rows if a == k and b > i), sum(a == k and b > i for a, b, _ in rows)) for k, i, _ in rows}
    assert {(r.k, r.i): (r.before, r.n) for r in got.collect()} == want


@pytest.mark.parametrize("prefix", ["", "0000", "00000000abcd"])
def test_smallest_refines_only_the_bucket_that_holds_the_rank(spark, prefix):
    rows = [(k, i, (prefix + hashlib.md5(f"{k}{i}".encode()).hexdigest())[:32]) for k, n in (("hot", 400), ("cold", 3), ("none", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, h string").repartition(4)
    wanted = spark.createDataFrame([("hot", 57), ("cold", 10), ("none", 0), ("absent", 4)], "k string, n int")
    got = {(r.k, r.i): r["rank"] for r in skew.smallest(df, ["k"], "h", wanted, rows_per_task=5).collect()}
    want = {}
    for key, n in (("hot", 57), ("cold", 10)):
        want |= {(key, i): at + 1 for at, (_, i) in enumerate(sorted((h, i) for k, i, h in rows if k == key)[:n])}
    assert got == want
