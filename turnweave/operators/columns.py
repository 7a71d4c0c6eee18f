"""Column-level cleaning: alias resolution, required columns, missing values."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: accepted spellings ------------------------------------------
CONVERSATION_ID_NAMES = ("会話ID", "conversation_id")
PLACE_NAMES = ("場所", "place")
SPEAKER_COUNT_NAMES = ("話者数", "speaker_n")
SCORE_NAMES = ("trait_score", "score", "value")
TRAIT_NAMES = ("trait", "Trait", "TRAIT")
# ----------------------------------------------------------------------------


def first_present(df: DataFrame, candidates, label: str) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"no {label} column; tried {list(candidates)}, have {df.columns}")


def require_columns(df: DataFrame, needed) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}; have {df.columns}")
    return df


def string_keys(df: DataFrame, keys) -> DataFrame:
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def finite(c: Column) -> Column:
    """NaN and +-infinity become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(name: str) -> Column:
    """Numeric coercion: values that do not parse, NaN and infinity -> NULL."""
    return finite(F.expr(f"try_cast(`{name}` AS double)")).alias(name)


def numeric_columns(df: DataFrame, names) -> DataFrame:
    names = set(names)
    return df.select(*[to_number(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def with_outcome(df: DataFrame, y: str) -> DataFrame:
    return df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y)))


def predictors(df: DataFrame, default_exclude=None, extra: str = "", keep_out=()) -> list[str]:
    """Predictor columns: all but the default exclusions (the control columns
    of the feature table), a comma-separated extra list and the key / outcome
    columns."""
    from .features import CONTROLS

    out = set(CONTROLS if default_exclude is None else default_exclude) | set(keep_out) | {c.strip() for c in extra.split(",") if c.strip()}
    return [c for c in df.columns if c not in out]


def exclude_columns(df: DataFrame, default_exclude=None, extra: str = "") -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in predictors(df, default_exclude, extra)])


def leading_int(c: Column) -> Column:
    """First run of digits: '2人' / ' 2 ' / '2名' -> 2, none -> NULL."""
    return _as_int(F.regexp_extract(c.cast("string"), "([0-9]+)", 1))


def all_digits(c: Column) -> Column:
    """All digits of the text joined: 'a1b2' -> 12."""
    return _as_int(F.regexp_replace(c.cast("string"), "[^0-9]", ""))


def _as_int(digits: Column) -> Column:
    return F.when(digits != "", digits.cast("long"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
