"""The corpus pipeline: stages over documents, each written and read again.

Every stage keeps the columns of documents but the last, which returns digests
of the encoded texts. A text that is repeated by the mixture is a row each time.
What a stage adds for itself stands beside a row's columns, never among them, so
that no column of documents is overwritten, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epifold.llm import minhash, mixing, suffix, toxicity
from epifold.llm.q_pieces import model_path, round_trip
from epifold.llm.q_toxicity import THRESHOLD
from epifold.sources.storage import Scratch, scratch_path

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
#: Passages that repeat over so many bytes are cut: some forty words, so that one
#: of over fifty words is found even if its words are short.
PASSAGE_BYTES = 200

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; a NULL text stays."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = "_toxicity"
    while name in map(str.lower, docs.columns):
        name = f"_{name}"
    scored = toxicity.scored(docs, toxicity.train(docs, labels), name)
    return scored.where(F.col(name) < THRESHOLD).select(*_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; rows without ``doc_id`` stay, of rows with one id and one text one stays.

    Different texts with one id are different documents.
    """
    numbered = _numbered(spark, docs)
    known = minhash.near_duplicates(numbered.select(F.col("number").alias("doc_id"), "text"), SHINGLE_WORDS, SIMILARITY_PERCENT)
    kept = known.where("kept and doc_id is not null").select(F.col("doc_id").alias("kept")).distinct()
    chosen = numbered.join(kept, numbered["number"] == F.col("kept"))
    first = F.row_number().over(Window.partitionBy("kept").orderBy("text"))
    one = chosen.withColumn("first", first).where("first = 1").select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def _packed(docs: DataFrame) -> DataFrame:
    """(row, id, text, print): every row whole, with its id, its text and a digest of that."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*_columns(docs)).alias("row")
    return docs.select(row, F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.md5(text.cast("binary")).alias("print"))


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows that have an id, packed, with a ``number`` for each id and text, in the order of the ids."""
    rows = _packed(docs.where("doc_id is not null"))
    if rows.groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a <> b").isEmpty():
        return rows.withColumn("number", F.col("id"))
    pairs = rows.select("id", "print").distinct().orderBy("id", "print")
    # Written, so that the numbers are the same whenever they are read.
    numbers = Scratch(spark, "numbers").keep(pairs.withColumn("number", F.monotonically_increasing_id()))
    return rows.join(numbers, ["id", "print"])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages of ``PASSAGE_BYTES`` that occur elsewhere too."""
    cut = suffix.without_repeats(docs, PASSAGE_BYTES)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mixture takes it."""
    _, mixture = mixing.mix(docs, block_words=None)
    times = mixture.groupBy("doc_id", "print", "copy").count().select("doc_id", "print", F.struct("copy", "count").alias("t"))
    times = times.groupBy("doc_id", "print").agg(F.map_from_entries(F.collect_list("t")).alias("times"))
    times = times.select(F.coalesce("doc_id", F.lit(suffix.SENTINEL)).alias("id"), "print", "times")
    rows = _packed(docs).withColumn("id", F.coalesce("id", F.lit(suffix.SENTINEL)))
    copy = F.row_number().over(Window.partitionBy("id", "print").orderBy(F.col("row.source").asc_nulls_last()))
    drawn = rows.join(times, ["id", "print"]).withColumn("n", F.element_at("times", copy))
    return drawn.where("n > 0").withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row."""
    return round_trip(docs, model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix", cut_repeats),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
