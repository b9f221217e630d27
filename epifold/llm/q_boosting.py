"""Query of the quality classifier."""

from pyspark.sql import functions as F

from epifold.llm.boosting import held_out, scored, train
from epifold.llm.registry import query, table

THRESHOLD = 0.7


@query("op11_boosting")
def op11_boosting(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    forest = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, forest).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
