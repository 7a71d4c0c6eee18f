"""Japanese rewrites: masks, counts, levels, logs."""
import pytest
from pyspark.sql import functions as F

from turnweave.plans import conditions as co
from turnweave.plans import dose as do

SCHEMA = "conversation_id string, speaker_id string, n_utt long, text string"


def table(spark, *texts):
    return spark.createDataFrame([(f"c{i}", "A", t.count("\n") + 1, t) for i, t in enumerate(texts)], SCHEMA)


def run(spark, feature, *texts, **kw):
    rows = do.dose_table(table(spark, *texts), feature, **kw).collect()
    return {(int(r.conversation_id[1:]), r.dose_level): r for r in rows}


def test_counts_ignore_annotations(spark):
    t = "えっと(F えっと)、あの\nはい(0.983)そう\nえー？(L)"
    c = do.text_counts(F.col("text"))
    row = table(spark, t).select(*[v.alias(k) for k, v in c.items()]).first()
    assert (row.FILL_count, row.YESNO_count, row.OIR_count, row.n_lines) == (3, 1, 1, 3)  # a line that starts with えっ counts as repair
    assert table(spark, "").select(c["n_lines"].alias("n")).first().n == 0


def test_fillers_removed_keep_length_and_annotations(spark):
    t = "えっと、えとー(F えっと)あの人\nえーーと(W あの|えー)えぇ"
    got = run(spark, "FILL", t)
    r = got[0, 0]
    assert r.text == "それで、それー(F えっと)その人\nでーーと(W あの|えー)でぇ"
    assert len(r.text) == len(t) and r.new_count == 0 and r.deleted == r.original_count == 5
    assert got[0, 1].text == t and got[0, 1].new_count == 5


def test_fillers_tripled(spark):
    line = "今日は、とても寒いので家に帰ろうと思います(L)それから買い物に行きました"
    t = "\n".join(["えっと" + line, "", "あの、" + line, line])
    got = run(spark, "FILL", t)[0, 3]
    assert got.original_count == 2 and got.inserted == 4 and got.new_count >= 6
    assert got.original_chars == got.new_chars and got.char_change_pct == 0 and got.warning == ""
    assert got.text.count("\n") == 3 and got.text.count("(L)") == 3 and got.text.split("\n")[1] == ""
    again = run(spark, "FILL", t)[0, 3].text
    assert again == got.text and run(spark, "FILL", t, seed=7)[0, 3].text != got.text


def test_fillers_inserted_when_there_are_none(spark):
    got = run(spark, "FILL", "今日は寒い\n\n明日も寒い\n雨が降る\n風が吹く", "", "寒い")
    r = got[0, 3]
    assert r.original_count == 0 and r.new_count >= 3 and r.inserted == r.new_count
    starts = [l for l in r.text.split("\n") if l.startswith(("えっと", "えー", "あの"))]
    assert len(starts) == 3
    assert got[1, 3].text == "" and got[1, 3].inserted == 0
    assert "exceeds" in got[2, 3].warning


def test_yesno_levels(spark):
    t = "そうですね\n  うん、寒い\nなるほど\nへえ、そう\nああ\n明日"
    got = run(spark, "YESNO", t)
    assert got[0, 0].text == "なるほどね\nふーん、寒い\nなるほど\nへえ、そう\nああ\n明日"
    assert (got[0, 0].original_count, got[0, 0].deleted, got[0, 0].new_count) == (2, 2, 0)
    r = got[0, 3]
    assert (r.inserted, r.new_count) == (3, 5)
    assert r.text == "そうですね\n  うん、寒い\nはい\nええ、そう\nうん\n明日"


def test_yesno_without_any_converts_up_to_three(spark):
    r = run(spark, "YESNO", "\n".join(["なるほど"] * 5))[0, 3]
    assert (r.original_count, r.inserted, r.new_count) == (0, 3, 3)


def test_longest_prefix_wins(spark):
    r = run(spark, "YESNO", "そうじゃないよ")[0, 0]
    assert r.text == "なるほどねよ"


def test_repair_levels(spark):
    t = "え？なに\nわからない\nへえ\nそっか\nうーん\nはい"
    got = run(spark, "OIR", t)
    assert got[0, 0].text.split("\n")[:2] == ["ふむなに", "なるほない"]
    assert got[0, 3].text == "え？なに\nわからない\nえ？\nえ？\nん？\nはい" and got[0, 3].inserted == 3


def test_log_rounds_the_stored_number(spark):
    pairs = [(n, d) for n in (2000, 1000, 320, 77) for d in range(1, 2 * n, 3)] + [(2000, 561), (2000, 107), (8, 1), (20000, 201)]
    pct = [abs(d) * 100.0 / n for n, d in pairs]
    df = spark.createDataFrame([(p,) for p in pct if p >= 5], "p double")
    for r in df.select("p", do.one_digit(F.col("p")).alias("s")).collect():
        assert r.s == f"{r.p:.1f}", r.p  # 28.05 -> 28.1, 5.35 -> 5.3, 12.25 -> 12.2
    rules = do.RULES | {"YESNO": do.LineRules.of(("はい",), {"はい": "ほ" * 563}, {"あー": "はい"}, ("あー",))}
    got = run(spark, "YESNO", "はい" + "x" * 1998, rules=rules)[0, 0]
    assert (got.char_change_pct, got.warning) == (28.05, "char_change 28.1% exceeds ±5% limit")
    got = run(spark, "YESNO", "はい" + "x" * 19998, rules=rules | {"YESNO": do.LineRules.of(("はい",), {"はい": "ほ" * 203}, {"あー": "はい"}, ("あー",))})[0, 0]
    assert got.char_change_pct == 1.0  # 1.005 is stored as a little less


def test_unknown_feature_and_level(spark):
    with pytest.raises(ValueError):
        do.dose_table(table(spark, "x"), "NOPE")
    with pytest.raises(ValueError):
        do.dose_table(table(spark, "x"), "FILL", [2])


def test_verify_and_side_effects(spark):
    base = table(spark, "えっと、はい\nなるほど", "あの\nうん")
    rep = do.verify_doses(base, do.dose_table(base, "FILL"), "FILL")
    got = {(r.dose_level, r.feature_name): r for r in rep.collect()}
    assert got[0, "FILL_count"].mean_manipulated == 0 and got[0, "FILL_count"].is_target
    assert got[1, "YESNO_count"].delta == 0
    assert do.monotonic(rep.filter("is_target"), ["feature_name"], "dose_level", "mean_manipulated").first().monotonic


def test_derangement_has_no_fixed_point(spark):
    d = table(spark, *[f"t{i}" for i in range(23)])
    m = co.shuffle_mapping(d, 3).collect()
    assert len({r.assigned_conversation_id for r in m}) == 23
    assert all(r.conversation_id != r.assigned_conversation_id for r in m)
    texts = {r.conversation_id: r.text for r in co.shuffle_texts(d, 3).collect()}
    assert sorted(texts.values()) == sorted(f"t{i}" for i in range(23)) and all(f"t{k[1:]}" != v for k, v in texts.items())
    with pytest.raises(ValueError):
        co.shuffle_mapping(table(spark, "only"))


@pytest.mark.parametrize("r,want", [
    ((.4, .1, .2), co.CONTENT), ((.4, .35, .1), co.SURFACE), ((.4, .2, .35), "N/A"),
    ((.4, .25, .31), co.CONTRIBUTES), ((None, .1, .1), "N/A"),
])
def test_condition_label(spark, r, want):
    cols = [F.lit(v).cast("double") for v in r]
    assert spark.range(1).select(co.condition_label(*cols)).first()[0] == want


def test_dose_report_small_families(spark):
    rows = [("FILL", d, t, 0.1 * i + 0.01 * d * (i + 1), 0.5, 0.5) for d in (0, 1, 3) for i, t in enumerate("OCEAN")]
    df = spark.createDataFrame(rows, "target_feature string, dose_level int, trait string, r_obs double, p_value double, p_corrected double")
    got = {(r.dose_level, r.trait): r for r in do.dose_report(df).collect()}
    assert got[1, "O"].delta_r_vs_baseline == 0 and got[1, "O"].wilcoxon_p is None
    assert abs(got[3, "O"].wilcoxon_p - 0.0625) < 1e-12 and abs(got[0, "N"].delta_r_vs_baseline + 0.05) < 1e-12
    two = do.dose_report(df.filter("trait IN ('O', 'C')")).filter("wilcoxon_p IS NOT NULL").count()
    assert two == 0
