"""Banding and relabelling of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from epifold import dims


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def recode(c: Column | str, mapping: Mapping, default: Column | None = None) -> Column:
    """Value of ``mapping`` for the column, else ``default`` (NULL if not given).

    A lookup in a literal map: unlike a ``CASE`` it evaluates the column once,
    which matters when the column is itself derived. For dictionaries of a few
    dozen entries; larger ones belong in a joined dimension.
    """
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    found = F.try_element_at(F.create_map(*pairs), _col(c))
    return found if default is None else F.coalesce(found, default)


def age_band(
    age: Column | str,
    limits: Sequence[int] = dims.AGE_LIMITS,
    labels: Sequence[str] = dims.AGE_LABELS,
    closed_top: bool = True,
) -> Column:
    """Band label of an age; ``limits`` are exclusive upper bounds.

    With ``closed_top`` ages at or over the last limit give NULL. Without it the
    last band catches every remaining age, for input already filtered by age.
    A NULL age gives NULL in both forms.
    """
    age = _col(age)
    out = F.when(age < limits[0], F.lit(labels[0]))
    for limit, label in zip(limits[1:-1], labels[1:-1]):
        out = out.when(age < limit, F.lit(label))
    if closed_top:
        return out.when(age < limits[-1], F.lit(labels[-1]))
    return out.when(age.isNotNull(), F.lit(labels[-1]))


def dose_level(first: Column | str, second: Column | str, booster: Column | str) -> Column:
    """Highest dose on record: 3 booster, 2 second, 1 first, 0 none.

    A dose counts when its text is neither NULL nor empty. An integer, so that
    de-duplication can keep it in a fixed-width aggregation buffer.
    """

    def given(c):
        c = _col(c)
        return c.isNotNull() & (c != "")

    return (
        F.when(given(booster), 3).when(given(second), 2).when(given(first), 1).otherwise(0)
    ).cast("int")


def dose_status(level: Column | str) -> Column:
    """Status text of a :func:`dose_level`."""
    return recode(level, dict(enumerate(dims.DOSE_STATUS)))


def dose_class(level: Column | str) -> Column:
    """Study class of a :func:`dose_level`: none, one dose, two or more."""
    level = _col(level)
    none, one, more = dims.DOSE_CLASSES
    return F.when(level >= 2, F.lit(more)).when(level == 1, F.lit(one)).otherwise(F.lit(none))
