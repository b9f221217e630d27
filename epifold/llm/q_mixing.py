"""Query of the mixture, with its check in SQL."""

from pyspark.sql import functions as F

from epifold.llm.mixing import mix
from epifold.llm.registry import query, table

SQL = r"""
WITH r AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS print,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, '')) ORDER BY source NULLS LAST) AS copy
  FROM documents
), s AS (
  SELECT source, sum(size) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM r GROUP BY source
), l AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio, sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS capped,
         sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s
), v AS (
  SELECT *, CAST(total - coalesce(capped, 0) AS DOUBLE) / open AS level FROM l
), t AS (
  SELECT source, source_size,
         CASE WHEN ratio > rise THEN rise * weight ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM v, (SELECT min_by(level, ratio) AS rise FROM v WHERE ratio > level)
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t
), b AS (
  SELECT r.*, k AS block, least(256, size - 256 * k) AS words,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || print || '|' || copy || '|' || k), 1, 13) AS BIGINT) AS place
  FROM (SELECT *, unnest(range(0, CAST(ceil(size / 256) AS BIGINT))) AS k FROM r) AS r
), c AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place, doc_id, print, copy, block) - words AS before FROM b
), k AS (
  SELECT doc_id, print, copy, c.source,
         sum(words * (passes + CASE WHEN target - passes * source_size > 0 AND before + words / 2 <= target - passes * source_size THEN 1 ELSE 0 END)) AS taken
  FROM c JOIN p ON p.source IS NOT DISTINCT FROM c.source GROUP BY ALL
)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM r JOIN p ON p.source IS NOT DISTINCT FROM r.source
LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM r.doc_id AND k.print = r.print AND k.copy = r.copy AND k.source IS NOT DISTINCT FROM r.source
"""


@query("op4_mixing", sql=SQL)
def op4_mixing(spark, sf_dir):
    rows, mixture = mix(table(spark, sf_dir, "documents"))
    taken = mixture.groupBy("doc_id", "print", "copy").agg(F.sum("words").alias("taken"))
    joined = rows.alias("r").join(
        taken.alias("t"),
        F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.print") == F.col("t.print")) & (F.col("r.copy") == F.col("t.copy")),
        "left",
    )
    return joined.select("r.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
