from pyspark.sql import functions as F

from . import histogram_sort
from .queries import query, table

SQL = """
WITH tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
k AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
o AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY h, doc_id NULLS FIRST) - size AS BIGINT) AS below, CAST(sum(size) OVER () AS BIGINT) AS total FROM k),
s AS (
  SELECT *, CAST(len(list_filter(range(1, 16), lambda j: below >= total * j // 16)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard,
  CAST(xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32
FROM s, tab
"""


@query("op4_histogram_sort", SQL)
def op4(spark, sf):
    rows = histogram_sort.shard(table(spark, sf, "documents"))
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
