from pyspark.sql import functions as F

from . import merkle
from .queries import query, table

SQL = """
WITH RECURSIVE
tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
f AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 AS changed
  FROM documents, tab),
l AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS other, changed FROM f),
p AS (
  SELECT *, CASE WHEN changed THEN other ELSE leaf END AS claim,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, pos // 2, n),
s AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 2, n),
r AS (SELECT level AS height, h AS root FROM u WHERE n = 1),
steps AS (
  SELECT p.lang, p.pos, v.level AS seq, CASE WHEN t.h IS NULL THEN '-' WHEN (p.pos >> v.level) % 2 = 1 THEN 'l' || t.h ELSE 'r' || t.h END AS step
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT unnest(range(40)) AS level) v ON v.level < s.height
  LEFT JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND t.level = v.level AND t.pos = xor(p.pos >> v.level, 1)),
upper_steps AS (
  SELECT s.lang, 100 + v.level AS seq, CASE WHEN u.h IS NULL THEN '-' WHEN (s.pos >> v.level) % 2 = 1 THEN 'l' || u.h ELSE 'r' || u.h END AS step
  FROM s, r JOIN (SELECT unnest(range(40)) AS level) v ON v.level < r.height
  LEFT JOIN u ON u.level = v.level AND u.pos = xor(s.pos >> v.level, 1)),
every AS (
  SELECT lang, pos, seq, step FROM steps
  UNION ALL
  SELECT p.lang, p.pos, seq, step FROM p JOIN upper_steps x ON x.lang IS NOT DISTINCT FROM p.lang),
paths AS (SELECT lang, pos, list(step ORDER BY seq) AS steps FROM every GROUP BY lang, pos),
q AS (
  SELECT p.*, s.subroot, r.root, coalesce(w.steps, []) AS steps
  FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN r LEFT JOIN paths w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos),
z AS (
  SELECT *, list_reduce(list_prepend(claim, steps), lambda a, b: sha256(CASE b[1] WHEN 'l' THEN b[2:] || a WHEN 'r' THEN a || b[2:] ELSE a END)) AS folded_root FROM q)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""


@query("op12_veb_merkle", SQL)
def op12(spark, sf):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.col("n_chars").cast("long")
    rows = merkle.leaves(table(spark, sf, "documents"), {"n_chars": F.when(changed, n_chars + 1).otherwise(n_chars)})
    return merkle.prove(merkle.manifest(rows)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
