"""Query of the sub-word encoder and decoder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epifold.llm.pieces import encode
from epifold.llm.registry import query, table

MODEL = "piece_bpe_32k.model"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text, and the bytes that the spans cover."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return encode(rows, path, packed=True, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.element_at("stops", -1).cast("long").alias("n_covered"),
    )


@query("op6_pieces")
def op6_pieces(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"), model_path())
