"""Column types of text tables, from mergeable states.

The state of a column is a set of types, held as bits: those that every known
value so far fits, with the number of known and missing values. Two states merge
by intersection and addition, so files can be judged apart, in any order, and
their states kept with them. All columns of a table are judged in one native
pass, and every task reduces its rows to one row before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of a missing value and of truth values.
MISSING = ("", "NA")
TRUTH = ("T", "F", "TRUE", "FALSE", "true", "false")

#: Types from narrow to wide; a column has the first one that all its values fit.
TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "integer": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "text": T.StringType(),
}
ALL = (1 << len(TYPES)) - 1

# A number does not begin with a needless zero: such values are codes.
_WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
_NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def known(c: Column) -> Column:
    """The value, or NULL if it spells a missing one."""
    return F.when(~c.isin(*MISSING), c)


def fits(c: Column) -> Column:
    """The types that a known value fits, as bits; NULL for a missing one."""
    value = known(c)
    tests = {
        "boolean": value.isin(*TRUTH),
        "integer": value.rlike(_WHOLE) & value.try_cast("int").isNotNull(),
        "long": value.rlike(_WHOLE) & value.try_cast("bigint").isNotNull(),
        # A number too large for a double would be read as infinite.
        "double": value.rlike(_NUMBER) & (F.abs(value.try_cast("double")) < float("inf")),
        "date": value.rlike(_DATE) & value.try_cast("date").isNotNull(),
        "timestamp": value.rlike(_TIME) & value.try_cast("timestamp_ntz").isNotNull(),
        "text": F.lit(True),
    }
    bits = F.lit(0)
    for i, name in enumerate(TYPES):
        bits = bits.bitwiseOR(F.when(tests[name], F.lit(1 << i)).otherwise(F.lit(0)))
    return F.when(value.isNotNull(), bits)


STATE = "place int, name string, n_known long, n_missing long, fits int"


def column_states(text: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, place, name, n_known, n_missing, fits) for every text column that is not in ``by``.

    Without ``by`` an empty table has states too: nothing known, all types fit.
    """
    names = [c for c in text.columns if c not in by]
    states = []
    for c in names:
        value = F.col(f"`{c}`").cast("string")
        states += [F.count(known(value)), F.count(F.lit(1)) - F.count(known(value)), F.coalesce(F.bit_and(fits(value)), F.lit(ALL))]
    if not names:
        return text.sparkSession.createDataFrame([], STATE)
    packed = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.lit(c).alias("name"),
                F.col(f"_{3 * i}").alias("n_known"),
                F.col(f"_{3 * i + 1}").alias("n_missing"),
                F.col(f"_{3 * i + 2}").alias("fits"),
            )
            for i, c in enumerate(names)
        ]
    )
    one = text.groupBy(*by).agg(*[s.alias(f"_{i}") for i, s in enumerate(states)])
    return one.select(*by, F.inline(packed))


def merge_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States of the same columns added up; ``place`` is that of the first table."""
    merged = states.groupBy(*by, "name").agg(
        F.min("place").alias("place"),
        F.sum("n_known").alias("n_known"),
        F.sum("n_missing").alias("n_missing"),
        F.bit_and("fits").alias("fits"),
    )
    return merged.select(*by, "place", "name", "n_known", "n_missing", "fits")


def type_name(fits: Column | str, n_known: Column | str = "n_known") -> Column:
    """Name of a column's type; a column without a known value is text."""
    bits = F.col(fits) if isinstance(fits, str) else fits
    count = F.col(n_known) if isinstance(n_known, str) else n_known
    out = F.when(count == 0, "text")
    for i, name in enumerate(TYPES):
        out = out.when(bits.bitwiseAND(F.lit(1 << i)) != 0, name)
    return out


def schema_of(states: DataFrame) -> T.StructType:
    """The schema that merged states amount to; one row per column reaches the driver."""
    rows = states.select("place", "name", type_name("fits").alias("type")).orderBy("place", "name").collect()
    return T.StructType([T.StructField(r["name"], TYPES[r["type"]]) for r in rows])


def read_text(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """CSV files with a header, every column as it is written."""
    header = spark.read.option("header", True).options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.option("header", True).option("enforceSchema", False).options(**options).schema(schema).csv(path)


def read_csv_inferred(spark: SparkSession, path: str, partitions: int | None = None, **options: str) -> DataFrame:
    """CSV files with a header and types inferred from all of their rows.

    Numbers come as integers, longs or doubles, days and times in ISO form as
    dates and timestamps, T and F as booleans; codes with leading zeros stay
    text. Files are read twice: once for the types and once for the rows.
    """
    text = read_text(spark, path, **options)
    schema = schema_of(column_states(text))
    # The same casts as in the test of the values; the reader's own parser knows fewer spellings.
    typed = text.select(*[known(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in schema])
    return typed.repartition(partitions) if partitions else typed
