"""Expressions over a set of flag columns of one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from epifold.functions.bands import _col


def flag_set(c: Column | str) -> Column:
    """Whether a text flag is a number of at least one; NULL for a NULL flag."""
    c = _col(c)
    return F.when(c.isNotNull(), F.coalesce(c.try_cast("int") >= 1, F.lit(False)))


def flag_count(flags: Sequence[str]) -> Column:
    """Number of set flags; NULL when any flag is NULL."""
    return reduce(lambda a, b: a + b, [flag_set(f).cast("int") for f in flags])


def first_flag(flags: Sequence[str]) -> Column:
    """Name of the first set flag in the given order, NULL if none is set."""
    return F.coalesce(*[F.when(flag_set(f), F.lit(f)) for f in flags])
