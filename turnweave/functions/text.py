"""Text predicates as Column -> Column functions; nothing leaves the JVM.

Prefix and tail tests are chains of startswith / endswith and trimming uses
explicit character sets, so most predicates need no regular expression.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .lexicon import JA, Lexicon

# Unicode white space, as a plain character list for btrim / translate.
WHITESPACE = "".join(
    chr(c)
    for c in (
        0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
IDEOGRAPHIC_SPACE = chr(0x3000)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def norm_text(text: Column) -> Column:
    """NULL -> '', ideographic space -> space, outer white space removed."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit(IDEOGRAPHIC_SPACE), F.lit(" "))
    return F.btrim(plain, F.lit(WHITESPACE))


def strip_tail(norm: Column) -> Column:
    return F.rtrim(norm, F.lit(lx.TAIL_PUNCTUATION + WHITESPACE))


def _has_mark(s: Column, lex: Lexicon) -> Column:
    return _any([F.contains(s, F.lit(m)) for m in lex.question_marks])


def ends_with_any(s: Column, tails) -> Column:
    return _any([F.endswith(s, F.lit(t)) for t in tails])


def prefix_any(norm: Column, prefixes) -> Column:
    return _any([F.startswith(norm, F.lit(p)) for p in prefixes])


def starts_with_any(text: Column, prefixes) -> Column:
    """True when the normalised text starts with one of the prefixes."""
    return prefix_any(norm_text(text), prefixes)


class Normalised:
    """Predicates over text that `norm_text` already cleaned, so that a job
    normalises each utterance once."""

    @staticmethod
    def asks(norm: Column, tail: Column, lex: Lexicon) -> Column:
        return _has_mark(norm, lex) | ends_with_any(tail, lex.question_tails)

    @staticmethod
    def particle(norm: Column, tail: Column, lex: Lexicon) -> Column:
        asks = Normalised.asks(tail, tail, lex)
        return (
            F.when(norm == "", "NONE")
            .when(ends_with_any(tail, lex.ne_tails), F.when(asks, "NE_Q").otherwise("NE"))
            .when(ends_with_any(tail, lex.yo_tails), "YO")
            .otherwise("OTHER")
        )

    @staticmethod
    def head_token(norm: Column) -> Column:
        head = F.ltrim(norm, F.lit(lx.HEAD_PUNCTUATION + WHITESPACE))
        return F.regexp_extract(head, f"^({lx.HEAD_TOKEN})", 1)

    @staticmethod
    def fillers(norm: Column, lex: Lexicon) -> dict[str, Column]:
        eto = F.regexp_count(norm, F.lit(lex.filler_eto))
        e = F.regexp_count(F.regexp_replace(norm, lex.filler_eto, ""), F.lit(lex.filler_e))
        ano = F.regexp_count(norm, F.lit(lex.filler_ano))
        return {"eto": eto, "e": e, "ano": ano, "total": eto + e + ano}


def is_question(text: Column, lex: Lexicon = JA) -> Column:
    t = norm_text(text)
    return Normalised.asks(t, strip_tail(t), lex)


def sfp_group(text: Column, lex: Lexicon = JA) -> Column:
    """Sentence-final particle class: NONE / NE / NE_Q / YO / OTHER."""
    t = norm_text(text)
    return Normalised.particle(t, strip_tail(t), lex)


def first_token(text: Column) -> Column:
    return Normalised.head_token(norm_text(text))


def is_aizuchi(text: Column, lex: Lexicon = JA) -> Column:
    return starts_with_any(text, lex.aizuchi)


def is_yesno(text: Column, lex: Lexicon = JA) -> Column:
    return starts_with_any(text, lex.yesno)


def is_oir(text: Column, lex: Lexicon = JA) -> Column:
    return starts_with_any(text, lex.oir)


def without_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def length_without_space(text: Column) -> Column:
    return F.length(without_space(text))


def length_without_blank(text: Column) -> Column:
    """Only U+0020 and U+3000 are removed: the sampling-frame length rule."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), " " + IDEOGRAPHIC_SPACE, ""))


def char_bigrams(text: Column) -> Column:
    """Character 2-grams of the text without white space (duplicates kept)."""
    return bigrams_of(without_space(text))


def bigrams_of(solid: Column) -> Column:
    """The lookahead takes the pair and the dot steps one code point: one
    linear pass, where a substring per position is quadratic in UTF-8."""
    return F.regexp_extract_all(solid, F.lit("(?s)(?=(..))."), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; NULL when both are empty, 0 when one is."""
    both = F.size(F.array_union(a, b))
    return F.when(
        both > 0, F.size(F.array_intersect(a, b)).cast("double") / both
    )


def lex_overlap(prev_text: Column, text: Column) -> Column:
    return jaccard(char_bigrams(prev_text), char_bigrams(text))


def filler_counts(text: Column, lex: Lexicon = JA) -> dict[str, Column]:
    """eto / e / ano counts; e is counted after the eto matches are removed."""
    return Normalised.fillers(norm_text(text), lex)


def filler_count_simple(text: Column, lex: Lexicon = JA) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(lex.filler_simple))


def summary_sentence(n_utt: Column, mean_chars: Column, duration: Column, fillers: Column) -> Column:
    """Summary-only text. bround keeps the half-even display rounding."""
    return F.concat(
        F.lit("この話者は合計"), n_utt.cast("long").cast("string"),
        F.lit("回発話し、平均発話長は"),
        F.format_string("%.1f", F.bround(mean_chars, 1)),
        F.lit("文字、会話全体の長さは"),
        F.format_string("%.0f", F.bround(duration, 0)),
        F.lit("秒、フィラーは"), fillers.cast("long").cast("string"),
        F.lit("回使用しました。"),
    )
