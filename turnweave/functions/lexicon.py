"""Word lists and tail rules that parameterise the text predicates.

A `Lexicon` is plain data: every text operator takes one, so a sensitivity
study is two Lexicon values in one job rather than two runs.
"""
from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values -----------------------------------------------------------
QUESTION_MARKS = ("?", "？")
QUESTION_TAILS = ("か", "かな", "かね", "でしょう", "でしょ", "だろう", "だろ", "の")
NE_TAILS = ("よね", "だよね", "ですよね", "だよな", "ね")
YO_TAILS = ("だよ", "ですよ", "よ")
TAIL_PUNCTUATION = "。．.！!、,「」\"'"
HEAD_PUNCTUATION = "、。,.!?！？「」（）()[]{}\"'-"
HEAD_TOKEN = "[A-Za-z0-9]+|[ぁ-んァ-ヶ一-龠]+"
AIZUCHI_PREFIXES = (
    "はい", "うん", "ええ", "そう", "そうそう", "そっか", "なるほど", "へえ", "了解",
    "わかった", "わかりました", "OK", "オーケー", "あー", "ああ", "うーん",
)
YESNO_PREFIXES = (
    "はい", "うん", "ええ", "そう", "そうです", "もちろん", "了解", "OK", "オーケー",
    "いいえ", "いや", "ううん", "違う", "ちがう", "だめ", "無理", "そうじゃない",
)
YESNO_NARROW = ("はい", "うん", "ええ", "いいえ", "いや")
OIR_PREFIXES = (
    "え？", "えっ", "えっ？", "ん？", "は？", "なに？", "何？", "もう一回", "もう一度",
    "どういうこと", "どういう意味", "聞こえ", "聞き取", "わから", "分から",
)
FILLER_ETO = "えっと|えと"
FILLER_E = "えー+|えぇ+|え〜+"
FILLER_ANO = "あの"
FILLER_SIMPLE = "えっと|えー|あの"
NE_YO_RULES = {
    "regex": (NE_TAILS, YO_TAILS),
    "1char": (("ね",), ("よ",)),
    "2char": (("よね", "だね", "ですね", "ね"), YO_TAILS),
}
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Lexicon:
    name: str = "ja"
    question_marks: tuple[str, ...] = QUESTION_MARKS
    question_tails: tuple[str, ...] = QUESTION_TAILS
    ne_tails: tuple[str, ...] = NE_TAILS
    yo_tails: tuple[str, ...] = YO_TAILS
    aizuchi: tuple[str, ...] = AIZUCHI_PREFIXES
    yesno: tuple[str, ...] = YESNO_PREFIXES
    oir: tuple[str, ...] = OIR_PREFIXES
    filler_eto: str = FILLER_ETO
    filler_e: str = FILLER_E
    filler_ano: str = FILLER_ANO
    filler_simple: str = FILLER_SIMPLE
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **changes) -> "Lexicon":
        return replace(self, **changes)


JA = Lexicon()

# The published conditions of the yes/no-list and particle-rule studies.
YESNO_CONDITIONS = {"wide": JA, "narrow": JA.with_(name="narrow", yesno=YESNO_NARROW)}
PARTICLE_CONDITIONS = {
    rule: JA.with_(name=rule, ne_tails=ne, yo_tails=yo) for rule, (ne, yo) in NE_YO_RULES.items()
}

# The same operators over the five words of `events.event_type`, which reach
# every branch; the driver tables hold no Japanese text.
WORDS = Lexicon(
    name="words",
    question_tails=("view",),
    ne_tails=("signup",),
    yo_tails=("purchase",),
    aizuchi=("click", "view"),
    yesno=("click",),
    oir=("error",),
    filler_eto="er",
    filler_e="r+",
    filler_ano="ic",
    filler_simple="er|cl",
)

# For the prose of `conversations`.
PROSE = Lexicon(
    name="prose",
    question_tails=("on", "es"),
    ne_tails=("en", "er"),
    yo_tails=("an", "le"),
    aizuchi=("Th", "In", "On", "É"),
    yesno=("The", "In"),
    oir=("On", "Re"),
    filler_eto="the",
    filler_e="on+",
    filler_ano="er",
    filler_simple="the|on",
)
