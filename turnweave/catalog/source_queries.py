"""Readers and writers: each query writes a driver table in the format under
test to the shared work folder and reads it back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import table_digest
from ..operators import columns as cl
from ..runtime import work_dir
from ..sources import readers, writers
from . import query
from .views import q, r, rounded, table


def _path(spark, name):
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a1_read_parquet_pruned", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
def read_pruned(spark, sf):
    d = readers.read_parquet(spark, f"{sf}/lineitem.parquet", needed=["l_returnflag", "l_quantity"])
    return d.filter("l_quantity > 30").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("a2_read_cp932_csv", """SELECT 'IC' || c_custkey AS "会話ID", '自宅' AS "場所", c_nationkey || '人' AS "話者数" FROM customer""")
def read_cp932(spark, sf):
    p = _path(spark, "cp932")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    src = table(spark, sf, "customer").select(
        F.concat(F.lit("IC"), "c_custkey").alias("会話ID"), F.lit("自宅").alias("場所"),
        F.concat("c_nationkey", F.lit("人")).alias("話者数"))
    src.write.option("header", True).option("encoding", "windows-31j").csv(p)
    return readers.read_csv(spark, p, encoding="cp932", needed=["会話ID", "話者数"])


@query("a3_a8_result_tsv_with_source", """SELECT p_brand AS feature, round(avg(p_retailprice), 6) + 0.0 AS coef,
  'results' AS source FROM part GROUP BY 1""")
def read_results(spark, sf):
    p = _path(spark, "tsv")
    src = rounded(table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("coef")))
    writers.write_tsv(src, p)
    d = readers.read_results(spark, p, schema="feature string, coef double")
    return d.select("feature", "coef", F.when(F.endswith("_source", F.lit(".csv")), "results").alias("source"))


@query("a4_read_items_csv", """SELECT p_partkey::INTEGER AS item_id, p_type AS trait, p_size % 2 AS reverse, p_name AS text FROM part""")
def read_items(spark, sf):
    p = _path(spark, "items")
    src = table(spark, sf, "part").select(
        F.col("p_partkey").cast("int").alias("item_id"), F.col("p_type").alias("trait"),
        (F.col("p_size") % 2).alias("reverse"), F.col("p_name").alias("text"))
    writers.write_csv(src, p)
    return readers.read_items(spark, p)


@query("a5_read_jsonl_skipping_broken", """SELECT conv_id::VARCHAR AS conversation_id, role AS speaker_id, turn::INTEGER AS item_id,
  text AS choice_raw FROM conversations WHERE (conv_id + turn) % 7 > 0""")
def read_jsonl(spark, sf):
    p = _path(spark, "jsonl")
    js = F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("conversation_id"), F.col("role").alias("speaker_id"),
        F.col("turn").alias("item_id"), F.col("text").alias("choice_raw")))
    broken = (F.col("conv_id") + F.col("turn")) % 7 == 0
    table(spark, sf, "conversations").select(F.when(broken, F.concat(F.lit("{"), js)).otherwise(js)).write.text(p)
    return readers.read_responses(spark, p).select("conversation_id", "speaker_id", "item_id", "choice_raw")


@query("a6_a7_partitioned_shards", """SELECT (l_suppkey % 3)::INTEGER AS shard, 'm' || l_suppkey % 2 AS model, count(*) AS n,
  sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2""")
def shards(spark, sf):
    p = _path(spark, "shards")
    src = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 3).cast("int").alias("shard"), F.concat(F.lit("m"), F.col("l_suppkey") % 2).alias("model"), "l_quantity")
    writers.write_scores(src, p, ("shard", "model"))
    return readers.read_shards(spark, p).groupBy("shard", "model").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))


@query("a12_parquet_round_trip", "SELECT * FROM orders")
def parquet_round_trip(spark, sf):
    p = _path(spark, "parquet")
    writers.write_parquet(table(spark, sf, "orders"), p)
    return readers.read_parquet(spark, p)


@query("a14_replace_by_analysis_type", """SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'new' ELSE 'old' END AS origin,
  o_orderpriority AS analysis_type, count(*) AS n FROM orders GROUP BY 1, 2""")
def replace_results(spark, sf):
    p = _path(spark, "results")
    d = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("analysis_type"))
    writers.replace_results(d.withColumn("origin", F.lit("old")), p)
    writers.replace_results(d.filter("analysis_type LIKE '1%'").withColumn("origin", F.lit("new")), p)
    return spark.read.parquet(p).groupBy("origin", "analysis_type").agg(F.count(F.lit(1)).alias("n"))


# Prices as decimals and dates as epoch microseconds, which have one text in both engines.
_DIGEST_COLUMNS = {"o_custkey": "o_custkey", "o_orderdate": "epoch_us(o_orderdate)", "o_orderkey": "o_orderkey",
                   "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus", "o_totalprice": "CAST(o_totalprice AS DECIMAL(18, 4))"}


@query("a17_table_digest", f"""SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), chr(92) || 'N')" for c in _DIGEST_COLUMNS.values())})), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM orders""")
def digest(spark, sf):
    d = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,4)"))
    return table_digest(d.withColumn("o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp"))).select(*_DIGEST_COLUMNS))


@query("b1_alias_resolution", "SELECT c_custkey AS conversation_id, c_mktsegment AS place FROM customer")
def aliases(spark, sf):
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("会話ID"), F.col("c_mktsegment").alias("place"))
    return d.select(
        F.col(cl.first_present(d, cl.CONVERSATION_ID_NAMES, "conversation id")).alias("conversation_id"),
        F.col(cl.first_present(d, cl.PLACE_NAMES, "place")).alias("place"))
