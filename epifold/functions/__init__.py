"""Column expressions shared by the operators; all stay in generated JVM code."""

from epifold.functions.bands import (
    age_band,
    dose_class,
    dose_level,
    dose_status,
    recode,
)
from epifold.functions.dates import (
    month_from_parts,
    month_number,
    month_start,
    parse_dmy,
    year_month,
)
from epifold.functions.rates import clamp, complement, guarded, half_even, per_population, percent
from epifold.functions.rowwise import first_flag, flag_count, flag_set
from epifold.functions.text import (
    annotate_zero,
    fixed_decimals,
    padded_cell,
    percent_text,
    spaced_commas,
    without_code_suffix,
)

__all__ = [
    "age_band",
    "annotate_zero",
    "clamp",
    "complement",
    "dose_class",
    "dose_level",
    "dose_status",
    "first_flag",
    "fixed_decimals",
    "flag_count",
    "flag_set",
    "guarded",
    "half_even",
    "month_from_parts",
    "month_number",
    "month_start",
    "padded_cell",
    "parse_dmy",
    "per_population",
    "percent",
    "percent_text",
    "recode",
    "spaced_commas",
    "without_code_suffix",
    "year_month",
]
