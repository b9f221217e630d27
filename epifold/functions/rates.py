"""Rates and percentages. Division by zero gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epifold.functions.bands import _col


def per_population(count: Column | str, population: Column | str, per: float = 100_000.0) -> Column:
    return F.try_divide(F.lit(float(per)) * _col(count), _col(population))


def percent(count: Column | str, population: Column | str) -> Column:
    return per_population(count, population, 100.0)


def complement(pct: Column | str) -> Column:
    return F.lit(100.0) - _col(pct)


def clamp(c: Column | str, low: float = 0.0, high: float = 100.0) -> Column:
    """Value limited to [low, high]; NULL stays NULL."""
    c = _col(c)
    return F.when(c > high, F.lit(high)).when(c < low, F.lit(low)).otherwise(c)


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


def guarded(guard: Column, hit: Column, other: Column) -> Column:
    """``hit`` or ``other`` by the guard, NULL where the guard itself is NULL."""
    return F.when(guard, hit).when(~guard, other)
