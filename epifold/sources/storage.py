"""Shared storage: the checkpoint folder and tables written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def names_folder(spark: SparkSession) -> str | None:
    """The folder all executors can reach, if the session names one."""
    return (
        spark.conf.get(CHECKPOINT_CONF, None)
        or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
        or spark.sparkContext.getCheckpointDir()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A session that names none is refused: a folder made here would be local to
    one machine.
    """
    folder = names_folder(spark)
    if not folder:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/epifold/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a report-sized frame that several branches read; lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table written by a finished job lies at the path."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return marker.getFileSystem(conf).exists(marker)


def materialise_once(df: DataFrame, path: str) -> DataFrame:
    """Write the frame unless a finished table is there; read the table back.

    A table left behind by a job that died has no success marker and is
    replaced, never read. A finished table with other columns or types is an
    error.
    """
    spark = df.sparkSession
    if is_complete(spark, path):
        found, wanted = spark.read.parquet(path).dtypes, df.dtypes
        if found != wanted:
            raise ValueError(f"the table at {path} has {found} instead of {wanted}")
    else:
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or folder of the shared storage."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that one job writes to the shared folder and removes when it is done.

    A result that outlives the job is written with ``keep``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.root = scratch_path(spark, name)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.root)

    def store(self, df: DataFrame, name: str, codec: str | None = None, level: int | None = None) -> DataFrame:
        """Write a table, with a codec other than the session's if one is named, zstd at a level."""
        return self._written(df, f"{self.root}/{name}", codec, level)

    def keep(self, df: DataFrame) -> DataFrame:
        return self._written(df, scratch_path(self.spark, self.name))

    def drop(self, name: str) -> None:
        """Remove a table before the job ends."""
        remove(self.spark, f"{self.root}/{name}")

    def _written(self, df: DataFrame, path: str, codec: str | None = None, level: int | None = None) -> DataFrame:
        options = {} if level is None else {"parquet.compression.codec.zstd.level": level}
        df.write.options(**options).parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)
