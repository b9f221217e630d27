"""Query of the near-duplicate vectors, with its check in SQL."""

from epifold.llm.neighbours import near_vectors
from epifold.llm.registry import query, table

SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT a, y FROM reach JOIN l ON b = x
), component AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN component ON a = vec_id LEFT JOIN n ON x = vec_id
"""


@query("op9_neighbours", sql=SQL)
def op9_neighbours(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
