"""Query of the training-order shards."""

from pyspark.sql import functions as F

from epifold.llm.pieces import id_bytes
from epifold.llm.q_pieces import model_path
from epifold.llm.registry import query, table
from epifold.llm.shards import read_shards, write_shards
from epifold.sources.storage import scratch_path


@query("op3_shards")
def op3_shards(spark, sf_dir):
    path, model = scratch_path(spark, "shards"), model_path()
    write_shards(table(spark, sf_dir, "documents"), path, model=model)
    return read_shards(spark, path, width=id_bytes(model)).select("doc_id", "part", "slot", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"))
