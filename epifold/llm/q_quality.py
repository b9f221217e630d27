"""Query of the quality rules, with its check in SQL."""

from epifold.llm.quality import judge
from epifold.llm.registry import query, table

SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), windows AS (
  SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, g HAVING count(*) >= 2
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), c AS (
  SELECT d.r, d.doc_id, d.lang, d.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
), m AS (
  SELECT r, lang, source, 'word_length' AS measure, 100 * word_chars // n_words AS v FROM b WHERE NOT base_failed
  UNION ALL SELECT r, lang, source, 'symbol_share', 1000 * n_symbols // n_words FROM b WHERE NOT base_failed
  UNION ALL SELECT r, lang, source, 'line_share', 1000 * n_dup_lines // n_words FROM b WHERE NOT base_failed
  UNION ALL SELECT r, lang, source, 'repeat_share', 1000 * n_repeat_words // n_words FROM b WHERE NOT base_failed
  UNION ALL SELECT r, lang, source, 'length', n_words FROM b WHERE NOT base_failed
), sketch AS (
  SELECT lang, source, measure, v - v % (CAST(1 AS BIGINT) << greatest(length(bin(v)) - 6, 0)) AS low, count(*) AS n
  FROM m GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, measure, low, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, measure, low, sum(n) FROM sketch GROUP BY lang, measure, low
  UNION ALL SELECT 3, NULL, NULL, measure, low, sum(n) FROM sketch GROUP BY measure, low
), running AS (
  SELECT *, sum(n) OVER (g ORDER BY low) AS until, sum(n) OVER g AS size FROM levels
  WINDOW g AS (PARTITION BY level, lang, source, measure)
), spec(measure, factor, tail, event, both_sides) AS (
  VALUES ('word_length', 100, 90, 20, true), ('symbol_share', 1000, 90, 1, false),
         ('line_share', 1000, 95, 1, false), ('repeat_share', 1000, 95, 1, false), ('length', 0, 90, 0, true)
), q AS (
  SELECT level, lang, source, measure, max(size) AS size, min(low) FILTER (100 * until >= (100 - tail) * size) AS q_low,
         min(low) FILTER (100 * until >= 50 * size) AS q_mid, min(low) FILTER (100 * until >= tail * size) AS q_high
  FROM running JOIN spec USING (measure) GROUP BY level, lang, source, measure
), chosen AS (
  SELECT a.lang, a.source, a.measure,
         CASE WHEN a.size >= 200 THEN a.q_low WHEN l.size >= 200 THEN l.q_low ELSE e.q_low END AS q_low,
         CASE WHEN a.size >= 200 THEN a.q_mid WHEN l.size >= 200 THEN l.q_mid ELSE e.q_mid END AS q_mid,
         CASE WHEN a.size >= 200 THEN a.q_high WHEN l.size >= 200 THEN l.q_high ELSE e.q_high END AS q_high
  FROM q a JOIN q l ON l.level = 2 AND l.lang IS NOT DISTINCT FROM a.lang AND l.measure = a.measure
  JOIN q e ON e.level = 3 AND e.measure = a.measure WHERE a.level = 1
), bounds AS (
  SELECT h.*, both_sides, factor * event // greatest(n.q_low, 1) AS least
  FROM chosen h JOIN spec USING (measure)
  JOIN chosen n ON n.measure = 'length' AND n.lang IS NOT DISTINCT FROM h.lang AND n.source IS NOT DISTINCT FROM h.source
  WHERE h.measure <> 'length'
), out_of AS (
  SELECT DISTINCT m.r FROM m JOIN bounds h
  ON h.lang IS NOT DISTINCT FROM m.lang AND h.source IS NOT DISTINCT FROM m.source AND h.measure = m.measure
  WHERE m.v > q_high + 6 * greatest(q_high - q_mid, least) OR both_sides AND m.v < q_low - 6 * greatest(q_mid - q_low, least)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND out_of.r IS NULL AS kept
FROM b LEFT JOIN out_of USING (r)
"""


@query("op5_quality", sql=SQL)
def op5_quality(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
