"""Japanese text predicates: hand-derived cases."""
import pytest
from pyspark.sql import functions as F

from turnweave.functions import hashing, text as tx
from turnweave.functions.lexicon import JA, NE_YO_RULES, OIR_PREFIXES, YESNO_PREFIXES

CASES = [
    ("いいね？", True, "OTHER"), ("え？そうだね", True, "NE_Q"), ("いいかね", True, "NE_Q"),
    ("そうだよね。", False, "NE"), ("するんだよ！", False, "YO"), ("行くの", True, "OTHER"),
    ("なのよ", False, "YO"), ("だよな", False, "NE"), ("そうですか。」", True, "OTHER"),
    ("", False, "NONE"), ("　\n", False, "NONE"), (None, False, "NONE"), ("寒い", False, "OTHER"),
]


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


@pytest.mark.parametrize("text,question,sfp", CASES)
def test_question_and_particle(spark, text, question, sfp):
    row = one(spark, text, tx.is_question(F.col("t")), tx.sfp_group(F.col("t")))
    assert tuple(row) == (question, sfp)


@pytest.mark.parametrize("text,token", [
    ("えー、はい", "え"), ("えっと、ええっとー", "えっと"), ("", ""), ("「OK」です", "OK"), ("…", ""), ("（笑）はい", "笑"),
])
def test_first_token(spark, text, token):
    assert one(spark, text, tx.first_token(F.col("t")))[0] == token


@pytest.mark.parametrize("text,eto,e,ano", [
    ("えっと、ええっとー", 2, 1, 0), ("えー、はい", 0, 1, 0), ("あのえとえぇ", 1, 1, 1), ("", 0, 0, 0), (None, 0, 0, 0),
])
def test_fillers(spark, text, eto, e, ano):
    c = tx.filler_counts(F.col("t"))
    assert tuple(one(spark, text, c["eto"], c["e"], c["ano"], c["total"])) == (eto, e, ano, eto + e + ano)


def test_prefixes(spark):
    row = one(spark, "えっと、行くよ", tx.is_oir(F.col("t")), tx.is_yesno(F.col("t")))
    assert tuple(row) == (True, False)
    assert not one(spark, "え?", tx.is_oir(F.col("t")))[0]
    assert one(spark, "　うん、寒いね", tx.is_yesno(F.col("t")))[0]


def test_lengths_differ_on_white_space(spark):
    row = one(spark, "あ　い\nう え ", tx.length_without_space(F.col("t")), tx.length_without_blank(F.col("t")))
    assert tuple(row) == (4, 6)


def test_bigrams_step_by_code_point(spark):
    row = one(spark, "a😀 b😀", tx.char_bigrams(F.col("t")))
    assert row[0] == ["a😀", "😀b", "b😀"]


@pytest.mark.parametrize("a,b,want", [("", "x", None), ("寒いね", "寒いよ", 1 / 3), ("寒い", "あ", 0.0), ("あいう", "あいう", 1.0)])
def test_jaccard(spark, a, b, want):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(tx.lex_overlap(F.col("a"), F.col("b"))).first()[0]
    assert got == want if want is None else abs(got - want) < 1e-12


def test_summary_sentence(spark):
    got = spark.range(1).select(tx.summary_sentence(F.lit(12), F.lit(12.25), F.lit(100.5), F.lit(3))).first()[0]
    assert got == "この話者は合計12回発話し、平均発話長は12.2文字、会話全体の長さは100秒、フィラーは3回使用しました。"


def test_hash_numbers(spark):
    row = spark.range(1).select(hashing.hash_key(42, 7, "x"), hashing.hash_uint32(42, 7, "x")).first()
    assert tuple(row) == ("23f70c97005827006807a8c4e08bb1f1", 603393175)


def test_word_list_sizes():
    assert (len(JA.aizuchi), len(YESNO_PREFIXES), len(OIR_PREFIXES), len(NE_YO_RULES)) == (16, 17, 15, 3)


def test_digest_ignores_order(spark):
    d = spark.range(50).withColumn("x", F.md5(F.col("id").cast("string")))
    a, b = hashing.table_digest(d).first(), hashing.table_digest(d.orderBy(F.desc("x")).repartition(3)).first()
    assert a == b and a != hashing.table_digest(d.limit(49)).first()


def test_published_conditions(spark):
    from turnweave.functions import text as tx
    from turnweave.functions.lexicon import PARTICLE_CONDITIONS, YESNO_CONDITIONS

    assert list(YESNO_CONDITIONS) == ["wide", "narrow"] and list(PARTICLE_CONDITIONS) == ["regex", "1char", "2char"]
    d = spark.createDataFrame([("だよな",), ("するよ",), ("いいですね",)], "t string")
    got = {n: [r[0] for r in d.select(tx.sfp_group("t", lex)).collect()] for n, lex in PARTICLE_CONDITIONS.items()}
    assert got["regex"] == ["NE", "YO", "NE"] and got["1char"] == ["OTHER", "YO", "NE"]
    assert len(YESNO_CONDITIONS["narrow"].yesno) == 5 < len(YESNO_CONDITIONS["wide"].yesno)


def test_default_exclusions_are_the_controls(spark):
    from turnweave.operators import columns as cl
    from turnweave.operators.features import CONTROLS

    d = spark.createDataFrame([tuple(range(len(CONTROLS) + 2))], ["a", *CONTROLS, "b"])
    assert cl.exclude_columns(d).columns == ["a", "b"] and cl.exclude_columns(d, extra="b").columns == ["a"]
