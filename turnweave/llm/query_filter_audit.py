from . import filter_audit
from .queries import query, table

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS mask
  FROM w LEFT JOIN g USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, step, o[step] AS f, o[1:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, o, step, f,
    sum(CASE WHEN translate(mask, earlier || f, '') = mask THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') = mask THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') <> mask THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') = mask THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(mask, f) AND translate(mask, earlier, '') = mask THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, o, step, f)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""


@query("op11_retraction_audit", SQL)
def op11(spark, sf):
    return filter_audit.audit(spark, f"{sf}/documents.parquet", table(spark, sf, "labels"))
