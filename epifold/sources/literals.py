"""Dimension tables made from Python literals of known length."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epifold import dims

# A literal table up to this many rows is sent to every executor.
BROADCAST_ROWS = 100_000

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "date": pa.date32(),
}


def literal_table(
    spark: SparkSession, rows: Iterable[Sequence], schema: Sequence[tuple[str, str]]
) -> DataFrame:
    """Table of literal rows, with a broadcast hint when its length allows it.

    ISO text is accepted for ``date`` columns. The row count is known here, so
    the hint rests on a checked size; a longer table is joined by shuffle.
    """
    rows = list(rows)
    columns = []
    for i, (_, kind) in enumerate(schema):
        values = [r[i] for r in rows]
        if kind == "date":
            values = [date.fromisoformat(v) if isinstance(v, str) else v for v in values]
        columns.append(pa.array(values, type=_ARROW[kind]))
    df = spark.createDataFrame(pa.table(columns, names=[name for name, _ in schema]))
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def cause_dimension(spark: SparkSession, ranges=dims.CAUSE_RANGES) -> DataFrame:
    """One row per coded cause: ``cause_code, cause_group, cause_group_short``.

    The ranges are literals, so the number of codes is known and checked before
    the table is sent to every executor.
    """
    n_codes = sum(high - low + 1 for _, low, high, _ in ranges)
    rows = [
        (letter, low, high, dims.CAUSE_GROUPS[g][1], dims.CAUSE_GROUPS[g][0])
        for letter, low, high, g in ranges
    ]
    schema = (
        ("letter", "string"),
        ("low", "int"),
        ("high", "int"),
        ("cause_group", "string"),
        ("cause_group_short", "string"),
    )
    codes = literal_table(spark, rows, schema).select(
        "letter",
        F.explode(F.sequence("low", "high")).alias("number"),
        "cause_group",
        "cause_group_short",
    )
    codes = codes.select(
        F.concat("letter", F.lpad(F.col("number").cast("string"), 2, "0")).alias("cause_code"),
        "cause_group",
        "cause_group_short",
    )
    return F.broadcast(codes) if n_codes <= BROADCAST_ROWS else codes


def timeline(spark: SparkSession, rows=dims.TIMELINE) -> DataFrame:
    """Intervention intervals: ``event, event_group, start, end``."""
    return literal_table(
        spark,
        rows,
        (("event", "string"), ("event_group", "string"), ("start", "date"), ("end", "date")),
    )
