"""Readers with explicit schemas, encodings and provenance."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import require_columns

UTTERANCES = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("speaker_id", T.StringType()),
    T.StructField("utt_seq", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("start_time", T.DoubleType()),
    T.StructField("end_time", T.DoubleType()),
])
ITEMS = T.StructType([
    T.StructField("item_id", T.IntegerType()),
    T.StructField("trait", T.StringType()),
    T.StructField("reverse", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
RESPONSES = T.StructType([
    T.StructField("conversation_id", T.StringType()),
    T.StructField("speaker_id", T.StringType()),
    T.StructField("item_id", T.IntegerType()),
    T.StructField("attempt_i", T.IntegerType()),
    T.StructField("choice_raw", T.StringType()),
    T.StructField("model_id", T.StringType()),
])
# --- fixed values: encodings the JVM knows under another name -------------------
JAVA_ENCODINGS = {"cp932": "windows-31j", "ms932": "windows-31j"}
# ----------------------------------------------------------------------------


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, needed=()) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return require_columns(reader.parquet(path), needed)


def read_csv(spark: SparkSession, path, encoding: str = "utf-8", sep: str = ",", schema=None, needed=()) -> DataFrame:
    """Delimited text with a header. Code page 932 needs the JVM charset name
    and the session switch that admits charsets outside the short list."""
    name = JAVA_ENCODINGS.get(encoding.lower(), encoding)
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", name)
    if name not in ("utf-8", "UTF-8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return require_columns(reader.csv(path), needed)


def read_tsv(spark: SparkSession, path, schema=None, needed=()) -> DataFrame:
    return read_csv(spark, path, sep="\t", schema=schema, needed=needed)


def read_items(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, schema=ITEMS)


def read_responses(spark: SparkSession, path, schema: T.StructType = RESPONSES) -> DataFrame:
    """JSON lines; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_shards(spark: SparkSession, root: str, pattern: str = "shard=*/model=*", schema=None) -> DataFrame:
    """Union of shard files; the path parts become partition columns."""
    reader = spark.read.option("basePath", root)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{pattern}")


def read_results(spark: SparkSession, paths, schema=None) -> DataFrame:
    """Result TSVs together, each row with its file name in `_source`."""
    df = read_tsv(spark, paths, schema=schema)
    return df.withColumn("_source", F.element_at(F.split(F.input_file_name(), "/"), -1))
