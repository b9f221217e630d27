"""Query of the conversation formatter, with its check in SQL."""

from pyspark.sql import functions as F

from epifold.llm.chat import BUDGET, CLOSE, CONTROL, MIDDLE, OPEN, masked, turns_of, windows
from epifold.llm.registry import query, table

PROBE = "</s>[INST] ok [/INST]"


def read_back(formatted):
    """Digests of the turns and of the text under the mask, per conversation."""
    turns = F.transform(turns_of(F.col("formatted"), F.col("repeated")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    texts = F.array_join(masked(F.col("formatted"), F.col("loss")), "")
    per_window = formatted.select("conv_id", "window", F.size(turns).alias("n"), F.array_join(turns, "").alias("turns"), texts.alias("loss"), F.char_length("formatted").alias("chars"))
    in_order = F.sort_array(F.collect_list(F.struct("window", "turns", "loss")))
    whole = per_window.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n_windows"), in_order.alias("w"))
    loss = F.array_join(F.transform("w", lambda w: w["loss"]), "")
    return whole.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("n").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("w", lambda w: w["turns"]), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
        "n_windows",
    )


CONTROLS_SQL = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in CONTROL)
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '{PROBE}' FROM range(2) AS r(k)
), o AS (
  SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS idx FROM t
), p AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx) - tokens AS start,
         replace(role, '\', '\\') AS r, replace(text, '\', '\\') AS b FROM o
), z AS (
  SELECT *, CAST(start // {BUDGET // 2} AS BIGINT) AS own, idx = 1 AND role = 'system' AS leading,
         {len(OPEN + MIDDLE + CLOSE)} + length(r) + length(b) + ({CONTROLS_SQL.replace("(x", "(r")})
         + ({CONTROLS_SQL.replace("(x", "(b")}) AS chars FROM p
), spans AS (
  SELECT conv_id, own, min(start) AS start, min(idx) AS first, arg_min(role, idx) AS first_role, sum(tokens) AS tokens
  FROM z GROUP BY conv_id, own
), room AS (
  SELECT s.*, {BUDGET} - s.tokens - coalesce(y.tokens, 0) AS room, first_role = 'assistant' AND first > 1 AS answers
  FROM spans s LEFT JOIN z y ON y.leading AND y.conv_id IS NOT DISTINCT FROM s.conv_id
), repeated AS (
  SELECT z.conv_id, sum(z.chars) AS chars FROM z JOIN room s ON z.conv_id IS NOT DISTINCT FROM s.conv_id AND z.idx < s.first
  WHERE z.leading OR s.start - z.start <= s.room OR s.answers AND z.idx = s.first - 1 GROUP BY 1
)
SELECT z.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(z.chars) + coalesce(max(h.chars), 0) AS BIGINT) AS formatted_chars, count(DISTINCT own) AS n_windows
FROM z LEFT JOIN repeated h ON h.conv_id IS NOT DISTINCT FROM z.conv_id GROUP BY z.conv_id
"""


@query("op10_chat", sql=SQL)
def op10_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return read_back(windows(turns.union(probe)))
