"""Text shaping for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epifold.functions.bands import _col


def spaced_commas(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit(", "))


def without_code_suffix(c: Column | str) -> Column:
    """Label up to the blank before its first parenthesis."""
    return F.regexp_replace(_col(c), r"\s\(.*", "")


def fixed_decimals(c: Column | str, digits: int = 2) -> Column:
    """Number as text with fixed decimals, ties to even; NULL stays NULL."""
    c = F.bround(_col(c).cast("double"), digits)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))


def percent_text(c: Column | str) -> Column:
    """Whole percentage with a percent sign, ties rounded to even."""
    return F.concat(F.bround(_col(c), 0).cast("long").cast("string"), F.lit("%"))


def padded_cell(c: Column | str) -> Column:
    """Report cell: the value between blanks."""
    return F.concat(F.lit(" "), _col(c).cast("string"), F.lit(" "))


def annotate_zero(c: Column | str) -> Column:
    """Star every zero that follows a blank and is not followed by a digit."""
    return F.regexp_replace(_col(c), " 0(?![0-9])", " 0* ")
