"""Selection, monologues, metadata and raters on small Japanese tables."""
import pytest
from pyspark.sql import functions as F

from turnweave.operators import columns as cl
from turnweave.operators import metadata as md
from turnweave.operators import monologue as mo
from turnweave.operators import raters as ra
from turnweave.operators import selection as se
from turnweave.plans import audit as au

UTT = "conversation_id string, speaker_id string, utt_seq long, text string, start_time double, end_time double"


def test_sampling_frame(spark):
    d = spark.createDataFrame([("a", "自宅", "2人"), ("b", "自宅（居間）", " 2 "), ("c", "職場", "2名"), ("d", "自宅", "3人"), ("e", None, "2")],
                              "`会話ID` string, `場所` string, `話者数` string")
    assert {r[0] for r in se.sampling_frame(d).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        se.sampling_frame(d.drop("場所"))


def test_candidate_score(spark):
    cols = ["会話ID", "会話概要", "形式", "場所", "活動", "話者間の関係性", "話者数"]
    d = spark.createDataFrame([("K1", "家族で夕食", "雑談", "自宅", "食事", "家族", "1"), ("W2", "会議", "会議", "職場", "", "", "8人")], cols)
    got = {r["会話ID"]: (r.diary_score, r.method, r.speaker_n) for r in se.candidate_scores(d).collect()}
    assert got["K1"] == (5 + 2 + 4, "personal_follow", 1) and got["W2"] == (-4 - 2, "specific_scene", 8)


def test_modelling_filter_needs_rows(spark):
    d = spark.createDataFrame([(30, 900)] * 4, "n_pairs_total int, FILL_text_len int")
    with pytest.raises(ValueError):
        se.modelling_rows(d)


def test_monologue_order_and_strip(spark):
    d = spark.createDataFrame([
        ("c", "A", 3, "三 ", None, None), ("c", "A", 2, "二", 1.0, 2.0), ("c", "A", 1, " 一", 1.0, 1.5), ("c", "B", 4, "x", 0.0, 1.0),
        ("c", "A", 5, None, 0.0, 1.0)], UTT)
    pairs = spark.createDataFrame([("c", "A"), ("c", "A")], "conversation_id string, speaker_id string")
    r = mo.build_monologues(d, pairs).collect()
    assert len(r) == 1 and (r[0].n_utt, r[0].n_chars, r[0].text) == (4, 3, "一\n二\n三")


def test_sorted_positions_over_many_partitions(spark):
    d = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("k"))
    got = [r.k for r in mo.sorted_positions(d, ["k"]).orderBy("pos").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_speaker_meta(spark):
    rec = spark.createDataFrame([("T1", "IC01"), ("T1", "IC02A"), ("T2", "IC09")], "conversation_id string, speaker_id string")
    mapping = spark.createDataFrame([("T1", "p1", "IC01_玲子"), ("T1", "p2", "IC02A_太郎"), ("T2", "p3", "玲子")], ["会話ID", "話者ID", "話者ラベル"])
    person = spark.createDataFrame([("p1", "女性", "40-44歳", "東京", "東京", "会社員", "友人"), ("p2", "男性", "不明", None, "", "", "")],
                                   ["話者ID", "性別", "年齢", "出身地", "居住地", "職業", "協力者からみた関係性"])
    got = {r.speaker_id: r for r in md.build_speaker_meta(rec, mapping, person).collect()}
    assert (got["IC01"].gender, got["IC01"].age_mid, got["IC02A"].gender, got["IC02A"].age_mid) == ("F", 42.0, "M", None)
    assert got["IC09"].person_id is None
    a = md.match_audit(spark.createDataFrame(list(got.values()), md.build_speaker_meta(rec, mapping, person).schema)).first()
    assert tuple(a) == (3, 1, 1)


def test_confounds_skip_empty_columns(spark):
    xy = spark.createDataFrame([("c", "A", 1.0)], "conversation_id string, speaker_id string, y double")
    meta = spark.createDataFrame([("c", "A", "p", "F", None)], "conversation_id string, speaker_id string, person_id string, gender string, age string")
    d, cols = md.confounds(xy, meta)
    assert cols == ["confound_gender"] and d.first().confound_gender == 1.0
    with pytest.raises(KeyError):
        md.confounds(xy, meta.drop("conversation_id"))


def test_overlap_identities(spark):
    d = spark.createDataFrame([("p1", "c2", "F"), ("p1", "c1", "F"), ("p2", "c3", "M"), ("p3", "c4", None), ("p1", "c1", "F")],
                              "person_id string, conversation_id string, gender string")
    s = md.overlap_summary(d).first()
    assert (s.total_records, s.unique_speakers, s.duplicate_speakers, s.duplicate_records, s.gender_F, s.gender_M) == (5, 3, 1, 3, 1, 1)
    r = md.overlap_detail(d).collect()
    assert [(x.person_id, x.n_records, x.conversation_ids, x.gender) for x in r] == [("p1", 3, "c1,c2", "F")]


@pytest.mark.parametrize("raw,want", [
    ('"Very Accurate"\nbecause', "Very Accurate"), ("4", "Very Accurate"), ("  neither   accurate NOR inaccurate? ", "Neither Accurate nor Inaccurate"),
    ("banana", "banana"), (None, ""), ("5", "5"), ("''", ""), ("neither accurate nor inaccurate (neither)", "Neither Accurate nor Inaccurate"),
])
def test_choice_normaliser(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(ra.normalise_choice(F.col("r"))).first()[0] == want


@pytest.mark.parametrize("raw,want", [("I am Very Accurate.", "Very Accurate"), ("neither accurate nor inaccurate", "Neither Accurate Nor Inaccurate"), ("4", None)])
def test_choice_normaliser_v1(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(ra.normalise_choice_v1(F.col("r"))).first()[0] == want


def test_resolve_attempts_policies(spark):
    att = spark.createDataFrame([("c", "A", 1, 1, "eh"), ("c", "A", 1, 2, "3"), ("c", "A", 1, 3, "0"), ("c", "A", 2, 1, "no")],
                                "conversation_id string, speaker_id string, item_id int, attempt_i int, choice_raw string")
    grid = spark.createDataFrame([("c", "A", i, "C", r) for i, r in ((1, 1), (2, 0), (3, 1))],
                                 "conversation_id string, speaker_id string, item_id int, trait string, reverse int")
    n = {r.item_id: (r.score, r.choice_raw) for r in ra.resolve_attempts(att, grid).collect()}
    assert n == {1: (1.0, "3"), 2: (2.0, "NEUTRAL_FALLBACK"), 3: (2.0, "NEUTRAL_FALLBACK")}
    m = {r.item_id: r.score for r in ra.resolve_attempts(att, grid, "nan").collect()}
    assert m == {1: 1.0, 2: None, 3: None}
    with pytest.raises(ValueError):
        ra.resolve_attempts(att, grid, "drop")


def test_cronbach_edge_cases(spark):
    def alpha(rows, **kw):
        df = spark.createDataFrame([("c", s, "C", i, float(v)) for s, i, v in rows],
                                   "conversation_id string, speaker_id string, trait string, item_id int, score double")
        return ra.cronbach_alpha(df, **kw).first()

    same = [(s, i, v) for s, v in (("a", 1), ("b", 2), ("c", 4)) for i in (1, 2)]
    assert abs(alpha(same).alpha - 1.0) < 1e-12
    assert alpha([(s, 1, v) for s, v in (("a", 1), ("b", 2))]).alpha is None
    assert alpha([(s, i, 2) for s in "abc" for i in (1, 2)]).alpha is None
    assert alpha(same[:4], min_subjects=3).alpha is None and alpha(same[:4]).alpha is not None
    short = alpha(same + [("d", 1, 3)])
    assert (short.n_subjects, short.n_complete, short.k_items) == (4, 3, 2)


def test_merge_check(spark):
    d = spark.createDataFrame([("c", "A", "C"), ("c", "A", "C"), ("c", "B", "C")], "conversation_id string, speaker_id string, trait string")
    r = ra.merge_check(d, 2).first()
    assert (r.n_rows, r.n_records, r.n_duplicated, r.ok) == (3, 2, 2, False)
    assert ra.merge_check(d.distinct(), 2).first().ok and not ra.merge_check(d.distinct(), 3).first().ok


def test_feature_set_check(spark):
    s = spark.createDataFrame([("C", "m", 3, 21), ("O", "m", 3, 21), ("E", "m", 3, 21)], "trait string, teacher string, stage int, n_features int")
    good = [("C", "m", f) for f in au.PREDICTORS]
    old = [("O", "m", f) for f in au.PREDICTORS if f != "PG_pause_variability"] + [("O", "m", "IX_topic_drift_mean"), ("A", "m", "x")]
    got = {r.trait: r for r in au.feature_set_check(s, spark.createDataFrame(good + old, "trait string, teacher string, feature string")).collect()}
    assert got["C"].consistent and got["C"].diagnosis == "feature sets agree"
    assert got["O"].missing == "PG_pause_variability" and "older" in got["O"].diagnosis
    assert got["E"].found == "stages only" and got["A"].found == "coefficients only"


def test_required_columns_and_predictors(spark):
    d = spark.createDataFrame([(1, 2, 3)], ["a", "b", "n_pairs_total"])
    assert cl.predictors(d, {"n_pairs_total"}, " b ,, ") == ["a"]
    with pytest.raises(KeyError):
        cl.require_columns(d, ["zzz"])


def test_top_features(spark):
    d = spark.createDataFrame([("a", .1), ("b", .9), ("c", .5), ("d", .7)], "feature string, topk_rate double")
    assert [r.feature for r in au.top_features(d).collect()] == ["b", "d", "c"]
