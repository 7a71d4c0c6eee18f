"""Writers: partitioned tables, replace-by-key, delimited results, shards."""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.monologue import shard

SCORE_PARTITIONS = ("dataset", "trait", "teacher", "condition")


def write_scores(df: DataFrame, path: str, partitions=SCORE_PARTITIONS) -> None:
    """What was encoded in directory names becomes partition columns."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def replace_results(df: DataFrame, path: str, key: str = "analysis_type") -> None:
    """Replace the rows of the analysis types present in `df`, keep the rest."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, sep="\t")


def write_shards(monologues: DataFrame, path: str, size: int = 10) -> None:
    """Fixed-size shards in record order, one directory per shard."""
    shard(monologues, size).write.mode("overwrite").partitionBy("shard").parquet(path)
