"""Query of the near-duplicate operator, with its check in SQL."""

from epifold.llm.minhash import near_duplicates
from epifold.llm.registry import query, table

SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY x, y
), l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), both_ways AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT a, y FROM reach JOIN both_ways ON b = x
), component AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN component ON a = d.doc_id
"""


@query("op1_minhash", sql=SQL)
def op1_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)
