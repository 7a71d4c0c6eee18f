"""Speaker metadata: recodes, joins with loss counts, person overlap."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as cl
from .turns import CONV, KEYS, SPK

# --- fixed values -----------------------------------------------------------
LABEL_PREFIX = "^([A-Z]+[0-9]+[A-Z]?)"
AGE_BAND = "([0-9]+)-([0-9]+)"
GENDER_WORDS = {"女性": "F", "男性": "M"}
GENDER_CODES = {"F": 1.0, "M": 0.0}
PERSON_COLUMNS = {
    "話者ID": "person_id", "性別": "gender", "年齢": "age_band", "出身地": "birthplace",
    "居住地": "residence", "職業": "occupation", "協力者からみた関係性": "relationship",
}
MAPPING_COLUMNS = {"会話ID": CONV, "話者ID": "person_id", "話者ラベル": "label"}
# ----------------------------------------------------------------------------


def age_band_midpoint(band: Column) -> Column:
    lo = F.regexp_extract(band, AGE_BAND, 1)
    hi = F.regexp_extract(band, AGE_BAND, 2)
    return F.when(lo != "", (F.expr("0D") + lo.cast("double") + hi.cast("double")) / 2)


def recode(c: Column, mapping: dict) -> Column:
    """Mapped value; anything else is NULL."""
    out = None
    for k, v in mapping.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def label_prefix(label: Column) -> Column:
    p = F.regexp_extract(label, LABEL_PREFIX, 1)
    return F.when(p != "", p)


def build_speaker_meta(
    records: DataFrame, mapping: DataFrame, persons: DataFrame, genders: dict = GENDER_WORDS
) -> DataFrame:
    """records -> person id (by conversation and label prefix) -> attributes.

    Both joins are left joins; records without a match keep NULLs.
    """
    for src, names in ((mapping, MAPPING_COLUMNS), (persons, PERSON_COLUMNS)):
        if not set(names.values()) <= set(src.columns):
            cl.require_columns(src, names)
    m = _english(mapping, MAPPING_COLUMNS).select(
        F.col(CONV).cast("string").alias(CONV), "person_id", label_prefix(F.col("label")).alias(SPK)
    )
    p = _english(persons, PERSON_COLUMNS)
    joined = records.select(*KEYS).join(m, KEYS, "left").join(p, "person_id", "left")
    mid = age_band_midpoint(F.col("age_band"))
    return joined.select(
        *KEYS, "person_id", recode(F.col("gender"), genders).alias("gender"), "age_band",
        mid.alias("age_mid"), "birthplace", "residence", "occupation", "relationship", mid.alias("age"),
    )


def _english(df: DataFrame, names: dict) -> DataFrame:
    if set(names.values()) <= set(df.columns):
        return df.select(*names.values())
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])


def match_audit(meta: DataFrame) -> DataFrame:
    """Rows, and rows unmatched at the mapping and at the attribute join."""
    return meta.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("person_id").isNull()).alias("unmatched_mapping"),
        F.count_if(F.col("gender").isNull()).alias("unmatched_person"),
    )


def demographics_summary(meta: DataFrame) -> DataFrame:
    return meta.agg(
        F.count_if(F.col("gender") == "F").alias("n_F"),
        F.count_if(F.col("gender") == "M").alias("n_M"),
        F.min("age_mid").alias("age_min"),
        F.max("age_mid").alias("age_max"),
        F.avg("age_mid").alias("age_mean"),
        F.count_if(F.col("birthplace").isNull()).alias("birthplace_missing"),
    )


def confounds(xy: DataFrame, meta: DataFrame, how: str = "inner") -> tuple[DataFrame, list[str]]:
    """Join person, gender and age; add the numeric confounds that exist.

    A confound whose column is absent or entirely NULL is left out.
    """
    cl.require_columns(meta, KEYS)
    cols = [c for c in ("person_id", "gender", "age") if c in meta.columns]
    m = cl.string_keys(meta.select(*KEYS, *cols), KEYS).dropDuplicates()
    out = cl.string_keys(xy, KEYS).join(m, KEYS, how)
    present = []
    if "gender" in cols:
        out = out.withColumn("confound_gender", recode(F.col("gender"), GENDER_CODES).cast("double"))
        present.append("confound_gender")
    if "age" in cols:
        out = out.withColumn("confound_age", cl.to_number("age"))
        present.append("confound_age")
    if present:
        seen = out.agg(*[F.count(c).alias(c) for c in present]).first()
        gone = [c for c in present if not seen[c]]
        out = out.drop(*gone)
        present = [c for c in present if c not in gone]
    return out, present


def join_loss(left: DataFrame, right: DataFrame, keys=KEYS) -> DataFrame:
    """Row counts of both sides, matched rows, and unmatched rows per side."""
    l = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl"))
    r = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr"))
    nl, nr = F.coalesce("nl", F.lit(0)), F.coalesce("nr", F.lit(0))
    return l.join(r, list(keys), "full_outer").agg(
        F.coalesce(F.sum(nl), F.lit(0)).alias("n_left"),
        F.coalesce(F.sum(nr), F.lit(0)).alias("n_right"),
        F.coalesce(F.sum(nl * nr), F.lit(0)).alias("n_joined"),
        F.coalesce(F.sum(F.when(nr == 0, nl)), F.lit(0)).alias("unmatched_left"),
        F.coalesce(F.sum(F.when(nl == 0, nr)), F.lit(0)).alias("unmatched_right"),
    )


def join_features(features: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """features left-joined to metadata on (conversation, speaker), or on the
    speaker alone when the metadata has no conversation column."""
    keys = KEYS if CONV in meta.columns else [SPK]
    return features.join(meta.select(*keys, *columns), keys, "left")


def person_conversations(meta: DataFrame) -> DataFrame:
    """Long form of the conversation lists: one row per person and
    conversation, whatever the number of records of a person."""
    return meta.select("person_id", F.col(CONV).cast("string").alias(CONV)).distinct()


def person_records(meta: DataFrame, order: str = CONV) -> DataFrame:
    """Records, first gender and sorted distinct conversations per person.

    The list is one cell per person by definition of the report; for persons
    with millions of records use `person_conversations`.
    """
    cl.require_columns(meta, ["person_id", CONV])
    gender = (
        F.min_by("gender", F.when(F.col("gender").isNotNull(), F.col(order)))
        if "gender" in meta.columns else F.lit(None).cast("string")
    )
    return meta.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.array_join(F.sort_array(F.collect_set(F.col(CONV).cast("string"))), ",").alias("conversation_ids"),
        gender.alias("gender"),
    )


def overlap_detail(meta: DataFrame, order: str = CONV) -> DataFrame:
    """Persons with two or more records; records without a person belong to none."""
    return person_records(meta.filter("person_id IS NOT NULL"), order).filter(F.col("n_records") >= 2)


def overlap_summary(meta: DataFrame, order: str = CONV) -> DataFrame:
    """Counts of persons and their records. Records without a person count in
    the total, but are no speaker."""
    n, known = F.col("n_records"), F.col("person_id").isNotNull()
    has_gender = "gender" in meta.columns
    gender = F.min_by("gender", F.when(F.col("gender").isNotNull(), F.col(order))) if has_gender else F.lit(None)
    per = meta.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_records"), gender.alias("gender"))
    cols = [
        F.sum(n).alias("total_records"),
        F.count_if(known).alias("unique_speakers"),
        F.count_if(known & (n >= 2)).alias("duplicate_speakers"),
        F.coalesce(F.sum(F.when(known & (n >= 2), n)), F.lit(0)).alias("duplicate_records"),
    ]
    if has_gender:
        cols += [F.count_if(known & (F.col("gender") == g)).alias(f"gender_{g}") for g in ("F", "M")]
    return per.agg(*cols)
