"""Query of the repeated-passage operator, with its check in SQL."""

from epifold.llm.registry import query, table
from epifold.llm.suffix import remove_repeats

# Bytes are pairs of hexadecimal digits here.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 399)) AS i FROM d)
), twice AS (
  SELECT m FROM w GROUP BY m HAVING count(*) > 1
), starts AS (
  SELECT r, i, i - row_number() OVER (PARTITION BY r ORDER BY i) AS island FROM w WHERE m IN (SELECT m FROM twice)
), runs AS (
  SELECT r, min(i) AS low, max(i) + 400 AS high FROM starts GROUP BY r, island
), marked AS (
  SELECT *, max(high) OVER (PARTITION BY r ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM runs
), numbered AS (
  SELECT *, sum(CASE WHEN low <= until THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY low) AS span FROM marked
), spans AS (
  SELECT r, span, min(low) AS low, max(high) AS high FROM numbered GROUP BY r, span
), gaps AS (
  SELECT r, low AS stop, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS start FROM spans
  UNION ALL SELECT r, NULL, max(high) FROM spans GROUP BY r
), kept AS (
  SELECT g.r, string_agg(CASE WHEN stop IS NULL THEN substr(h, 2 * start + 1) ELSE substr(h, 2 * start + 1, 2 * (stop - start)) END,
                         '' ORDER BY start) AS h
  FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r
), total AS (
  SELECT r, sum(high - low) AS removed, count(*) AS spans FROM spans GROUP BY r
)
SELECT doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total USING (r) LEFT JOIN kept USING (r)
"""


@query("op8_suffix", sql=SQL)
def op8_suffix(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
