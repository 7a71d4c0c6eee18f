from pyspark.sql import functions as F

from . import suffix_lines
from .queries import query, table

SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, ls, i, length(ls[i]) + 1 AS c FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
e AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS stop, sum(c) OVER (PARTITION BY doc_id) AS total FROM l),
f AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id ORDER BY stop - c RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS lf,
    count(*) OVER (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS lb FROM e),
w AS (
  SELECT doc_id, i AS p, lf AS n, array_to_string(ls[i:i + lf - 1], chr(10)) AS run FROM f WHERE stop - c + 50 <= total
  UNION
  SELECT doc_id, i - lb + 1, lb, array_to_string(ls[i - lb + 1:i], chr(10)) FROM f WHERE stop >= 50),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, p) AS place FROM w) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS i FROM later),
kept AS (
  SELECT l.doc_id, string_agg(ls[i], chr(10) ORDER BY i) AS text, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(kept.n, 0) AS BIGINT) AS n_deleted,
  CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op3_line_suffix_array", SQL)
def op3(spark, sf):
    return suffix_lines.delete_copies(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_deleted", F.md5(F.col("text").cast("binary")).alias("text_md5"))
