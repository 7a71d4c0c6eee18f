"""Feature table: golden conversation, both physical paths, edge cases."""
import random

import pytest
from pyspark.sql import functions as F

from turnweave.functions.lexicon import JA, WORDS
from turnweave.operators import features as ft
from turnweave.operators import skew, turns

SCHEMA = "conversation_id string, speaker_id string, utt_seq long, text string, start_time double, end_time double"
GOLDEN = [
    ("c", "A", 1, "今日は寒いね", 0.0, 1.0), ("c", "B", 2, "うん、寒いね", 1.5, 2.0), ("c", "A", 3, "明日は行くの？", 2.02, 3.0),
    ("c", "B", 4, "え？", 2.9, 4.0), ("c", "B", 5, "えっと、行くよ", 4.5, 5.0), ("c", "A", 6, "なるほど", 6.0, 7.0),
    ("c", "B", 7, "あの、そうだよね。", 9.0, 10.0),
]
WANT = {
    "A": dict(n_pairs_total=2, n_pairs_after_NE=1, n_pairs_after_YO=1, IX_n_pairs_after_question=0, RESP_NE_AIZUCHI_RATE=0,
              RESP_NE_ENTROPY=0, RESP_YO_ENTROPY=0, IX_oirmarker_rate=0, IX_oirmarker_after_question_rate=None, IX_yesno_rate=0,
              IX_lex_overlap_mean=0, IX_topic_drift_mean=1, PG_total_time=10, PG_speech_ratio=0.298, PG_pause_mean=2.01,
              PG_pause_p50=2.01, PG_pause_p90=2.802, PG_pause_variability=0.696553, PG_resp_gap_mean=1, PG_resp_gap_p90=1,
              PG_overlap_rate=0, FILL_text_len=17, FILL_cnt_total=0, FILL_rate_per_100chars=0, FILL_has_any=0),
    "B": dict(n_pairs_total=3, n_pairs_after_NE=1, n_pairs_after_YO=0, IX_n_pairs_after_question=1, RESP_NE_AIZUCHI_RATE=1,
              RESP_NE_ENTROPY=0, RESP_YO_ENTROPY=None, IX_oirmarker_rate=0.333333, IX_oirmarker_after_question_rate=1,
              IX_yesno_rate=0.333333, IX_yesno_after_question_rate=0, IX_lex_overlap_mean=0.083333, IX_topic_drift_mean=0.916667,
              PG_speech_ratio=0.31, PG_pause_mean=1.8, PG_pause_p50=0.9, PG_pause_p90=3.38, PG_pause_variability=1.064291,
              PG_resp_gap_mean=1.25, PG_resp_gap_p50=1.25, PG_resp_gap_p90=1.85, PG_overlap_rate=0.333333, FILL_text_len=24,
              FILL_cnt_total=2, FILL_cnt_eto=1, FILL_cnt_e=0, FILL_cnt_ano=1, FILL_rate_per_100chars=8.333333, FILL_has_any=0.5),
}


def rows(df):
    return {(r.conversation_id, r.speaker_id): r.asDict() for r in df.collect()}


def close(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-6


@pytest.mark.parametrize("rows_per_task", [10**6, 2])
def test_golden_conversation(spark, rows_per_task):
    got = rows(ft.extract_features(spark.createDataFrame(GOLDEN, SCHEMA), rows_per_task=rows_per_task))
    assert set(got) == {("c", "A"), ("c", "B")}
    for spk, want in WANT.items():
        for k, v in want.items():
            assert close(got["c", spk][k], v), (spk, k, got["c", spk][k], v)
    assert len(got["c", "A"]) == 34
    assert set(ft.PREDICTORS + ft.CONTROLS) == set(got["c", "A"]) - set(turns.KEYS)


def test_skewed_conversation_equals_whole(spark):
    """One conversation with most rows, ties and missing times: the split path
    gives the same table as the plain one."""
    rnd = random.Random(5)
    words = ["view", "signup", "purchase", "error", "click", "err click ic", ""]
    data = []
    for i in range(900):
        conv = "hot" if i % 3 else f"c{i % 7}"
        t = None if i % 50 == 0 else float(rnd.randint(0, 300))
        data.append((conv, f"s{rnd.randint(0, 3)}", i, rnd.choice(words), t, None if t is None or i % 17 == 0 else t + rnd.random()))
    df = spark.createDataFrame(data, SCHEMA)
    a = rows(ft.extract_features(df, lex=WORDS))
    b = rows(ft.extract_features(df, lex=WORDS, rows_per_task=200))
    assert a.keys() == b.keys()
    for k in a:
        for c in a[k]:
            if not isinstance(a[k][c], str):
                assert close(a[k][c], b[k][c]), (k, c, a[k][c], b[k][c])


def test_untimed_hot_conversation_keeps_order(spark):
    data = [("hot", "AB"[i % 2], i, f"t{i}", None, None) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    got = turns.turn_pairs(df, rows_per_task=50).orderBy("utt_seq").collect()
    assert [(r.prev_text, r.resp_text) for r in got] == [(f"t{i - 1}", f"t{i}") for i in range(1, 600)]


def test_hot_conversation_of_equal_times_is_cut(spark):
    """Equal start and end times are cut at the sequence number."""
    data = [("hot", "AB"[i % 2], i, f"t{i}", 5.0, 6.0) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    cut = skew.order_chunks(turns.conform_utterances(df), ["conversation_id"], turns.turn_order(), 12)
    assert cut.groupBy("chunk").count().agg(F.max("count")).first()[0] < 200
    got = turns.turn_pairs(df, rows_per_task=50).orderBy("utt_seq").collect()
    assert [(r.prev_text, r.resp_text) for r in got] == [(f"t{i - 1}", f"t{i}") for i in range(1, 600)]


def test_many_pieces_need_no_task_each(spark, monkeypatch):
    """More pieces than ranges: runs of the sorted order inside a bounded number of partitions."""
    monkeypatch.setattr(skew, "RANGES", 4)
    data = [(f"c{i % 3}", "AB"[i % 2], i, f"t{i}", 5.0, 6.0) for i in range(900)]
    df = spark.createDataFrame(data, SCHEMA)
    cut = skew.order_chunks(turns.conform_utterances(df), ["conversation_id"], turns.turn_order(), 90)
    assert len({r.f for r in cut.select(F.input_file_name().alias("f")).collect()}) <= 4
    rows_ = cut.orderBy("conversation_id", "utt_seq").select("chunk").collect()
    chunks = [r.chunk for r in rows_]
    assert chunks == sorted(chunks) and max(map(chunks.count, set(chunks))) <= 10 and len(set(chunks)) >= 90
    split, whole = turns.turn_pairs(df, rows_per_task=10), turns.turn_pairs(df)
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    a, b = (rows(ft.extract_features(df, lex=WORDS, rows_per_task=n)) for n in (10, 10**6))
    assert a.keys() == b.keys() and all(isinstance(v, str) or close(v, b[k][c]) for k in a for c, v in a[k].items())


def test_target_filter_keeps_partner_turns(spark):
    pairs = spark.createDataFrame([("c", "B")], "conversation_id string, speaker_id string")
    got = rows(ft.extract_features(spark.createDataFrame(GOLDEN, SCHEMA), pairs))
    assert set(got) == {("c", "B")} and got["c", "B"]["n_pairs_total"] == 3


def test_unknown_target_and_empty_input(spark):
    pairs = spark.createDataFrame([("x", "B")], "conversation_id string, speaker_id string")
    assert ft.extract_features(spark.createDataFrame(GOLDEN, SCHEMA), pairs).count() == 0
    assert ft.extract_features(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_speaker_change_gives_no_row(spark):
    data = [("c", "A", i, "はい", float(i), i + 0.5) for i in range(3)]
    assert ft.extract_features(spark.createDataFrame(data, SCHEMA)).count() == 0


@pytest.mark.parametrize("starts,want", [([0, 2, 4], 0.0), ([0, 2, 6], 0.707107), ([0, 2], None)])
def test_pause_variability(spark, starts, want):
    data = [("c", "A", i, "はい", float(s), s + 1.0) for i, s in enumerate(starts)]
    data.append(("c", "B", 90, "うん", 50.0, 51.0))
    data.append(("c", "A", 91, "うん", 50.5, 49.0))
    base = rows(ft.extract_features(spark.createDataFrame(data, SCHEMA)))["c", "A"]
    data = [d for d in data if d[2] < 90] + [("c", "B", 89, "うん", -1.0, -0.5)]
    got = rows(ft.extract_features(spark.createDataFrame(data, SCHEMA)))["c", "A"]
    assert close(got["PG_pause_variability"], want) and base["n_pairs_total"] == 1


def test_missing_times_are_not_zero(spark):
    data = [("c", "AB"[i % 2], i, "うん", None, None) for i in range(4)]
    got = rows(ft.extract_features(spark.createDataFrame(data, SCHEMA)))["c", "B"]
    assert got["PG_speech_ratio"] is None and got["PG_pause_mean"] is None and got["PG_total_time"] is None
    assert got["PG_overlap_rate"] == 0.0 and got["n_pairs_total"] == 2


def test_variants_share_one_pass(spark):
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    v = ft.extract_feature_variants(df, gap_tols=[0.05, 1.0], lexicons={"all": JA, "few": JA.with_(yesno=("はい",))})
    got = {(r.gap_tol, r.lexicon, r.speaker_id): r for r in v.collect()}
    assert len(got) == 8
    assert got[0.05, "few", "B"].IX_yesno_rate == 0 and close(got[0.05, "all", "B"].IX_yesno_rate, 1 / 3)
    assert close(got[1.0, "all", "A"].PG_pause_p50, 2.01 + 0.99) or got[1.0, "all", "A"].PG_pause_p50 is not None
    for r in (got[1.0, "all", "B"], got[0.05, "all", "B"]):
        assert r.n_pairs_total == 3


def test_one_exchange(spark):
    """All windows and the aggregate share the partitioning by conversation."""
    df = spark.createDataFrame(GOLDEN, SCHEMA)
    plan = ft.extract_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1, plan


def test_scan_is_pruned(spark):
    from turnweave.catalog.views import utt_timed

    plan = ft.extract_features(utt_timed(spark, "/root/testdata/sf0.001"), lex=WORDS)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_hot_keys(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k")).union(spark.range(5000).select(F.lit(99).alias("k")))
    assert [(r.k, r.n) for r in skew.hot_keys(df, ["k"], 500).collect()] == [(99, 5000)]
    assert skew.hot_keys(df, ["k"], 10**6).isEmpty()


def test_every_hot_conversation_is_cut(spark, monkeypatch):
    """1,200 conversations above the limit, and some below it: as if none were hot."""
    from turnweave.operators import turns as tu

    rows = [(f"c{c}", "AB"[(c + i) % 3 == 0], i, float(i), i + 0.5, f"t{i}") for c in range(1300) for i in range(5 if c < 1200 else 2)]
    df = spark.createDataFrame(rows, "conversation_id string, speaker_id string, utt_seq long, start_time double, end_time double, text string")
    pieces = []
    cut = skew.order_chunks
    monkeypatch.setattr(skew, "order_chunks", lambda d, k, o, n: pieces.append((d.select("conversation_id").distinct().count(), n)) or cut(d, k, o, n))
    split = tu.turn_pairs(df, rows_per_task=4)
    assert pieces == [(1200, 1500)]
    whole = tu.turn_pairs(df)
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and whole.count() > 3000


def test_exact_quantiles_match_percentile(spark):
    rnd = random.Random(1)
    data = [(k, float(rnd.choice([0, 0, 1, rnd.random() * 100]))) for k in "ab" for _ in range(2000)] + [("c", 3.0), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: [r[f"q{i}"] for i in range(5)] for r in skew.exact_quantiles(df, ["k"], "v", qs, [f"q{i}" for i in range(5)]).collect()}
    want = {r.k: list(r.p) for r in df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in qs])).alias("p")).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert all(close(a, b) for a, b in zip(got[k], want[k])), (k, got[k], want[k])


def test_positions_are_consecutive(spark):
    from turnweave.functions.hashing import hash_key

    df = spark.range(3000)
    pos = skew.hash_positions(df, hash_key(1, F.col("id")), ["id"]).select("id", "pos", F.md5(F.concat(F.lit("1:"), "id")).alias("h"))
    got = [r.h for r in pos.orderBy("pos").collect()]
    assert got == sorted(got)
    assert [r.pos for r in pos.orderBy("pos").collect()] == list(range(1, 3001))
