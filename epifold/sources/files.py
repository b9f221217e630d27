"""CSV and Parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
#: Where a row lies in its source: file, start of the part read, row in that part.
POSITION = ("_file", "_block", "_row")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    keep_corrupt: bool = False,
    partitions: int | None = None,
    position: bool = False,
    **options: str,
) -> DataFrame:
    """The declared columns of CSV files, found by their header names; ``NA`` and empty fields are NULL.

    Columns may stand in any order and among others. A declared column that is
    missing is an error, and so is a file whose header differs from the first
    one's. ``position`` adds where each row lies, taken before its rows are
    spread. With ``keep_corrupt`` the text of a line that does not fit the schema is
    kept in ``_corrupt_record``. A gzip file is one split whatever its size, so
    ``partitions`` spreads its rows for the work that follows.
    """
    reader = (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("mode", "PERMISSIVE")
        .options(**options)
    )
    header = spark.read.option("header", True).options(**options).csv(path).columns
    missing = [c for c in schema.names if c not in header]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in the header of {path}")
    fields = [schema[c] if c in schema.names else T.StructField(c, T.StringType(), True) for c in header]
    wanted = [F.col(f"`{c}`") for c in schema.names]
    if keep_corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType(), True))
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
        wanted.append(F.col(CORRUPT))
    # Every file's header is held against the schema made from the first one.
    df = reader.option("enforceSchema", False).schema(T.StructType(fields)).csv(path)
    if position:
        wanted += [
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_row"),
        ]
    df = df.select(*wanted)
    return df.repartition(partitions) if partitions else df


def write_csv_gzip(df: DataFrame, path: str) -> None:
    """Compressed CSV with a header, one file per partition, NULL as ``NA``."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("compression", "gzip")
        .option("nullValue", "NA")
        .csv(path)
    )


def report_table(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The named columns in order, under their display names."""
    return df.select(*[F.col(c).alias(shown) for c, shown in names.items()])


def write_report(df: DataFrame, path: str, names: Mapping[str, str] | None = None) -> None:
    """Report table as Parquet; display names with blanks and signs are kept."""
    shown = report_table(df, names) if names else df
    shown.write.mode("overwrite").parquet(path)
