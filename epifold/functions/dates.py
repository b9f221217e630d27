"""Calendar expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from epifold import dims
from epifold.functions.bands import _col, recode


def parse_dmy(c: Column | str) -> Column:
    """Date from ``dd/mm/yyyy`` text; NULL when the text is not such a date."""
    return F.try_to_date(_col(c), "dd/MM/yyyy")


def month_start(c: Column | str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(_col(c), "MM")


def year_month(c: Column | str) -> Column:
    """``yyyy-MM`` text of a date."""
    return F.date_format(_col(c), "yyyy-MM")


def month_number(name: Column | str, names: Mapping[str, int] = dims.MONTHS_ES) -> Column:
    """Month number of a month name; NULL for an unknown name."""
    return recode(name, names)


def month_from_parts(year: Column | str, month: Column | str) -> Column:
    """First day of a month given its year and number; NULL if a part is NULL."""
    return F.make_date(_col(year), _col(month), F.lit(1))
