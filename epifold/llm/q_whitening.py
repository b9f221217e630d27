"""Query of the whitened embeddings."""

from epifold.llm.registry import query, table
from epifold.llm.whitening import whitened


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))
