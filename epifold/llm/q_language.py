"""Query of the language classifier."""

from pyspark.sql import functions as F

from epifold.llm.language import held_out, predict, train
from epifold.llm.registry import query, table


@query("op7_language")
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, *train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
