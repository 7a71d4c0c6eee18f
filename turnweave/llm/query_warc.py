from . import warc
from .queries import query, table

SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM m
"""


@query("op6_warc_splittable", SQL)
def op6(spark, sf):
    archives = warc.write(table(spark, sf, "pages"), warc.archive_folder(spark))
    return warc.resolve(warc.read(archives))
