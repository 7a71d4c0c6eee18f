"""Queries of this folder over the driver's tables, with SQL twins where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


from . import (  # noqa: E402, F401
    query_bpe, query_brown, query_compression, query_filter_audit, query_histogram_sort, query_jaccard_regions, query_merkle, query_pipeline, query_simhash, query_suffix_lines, query_surrogates, query_toxicity, query_warc, query_winnowing,
)
