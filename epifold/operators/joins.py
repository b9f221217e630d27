"""Joins of facts with frames that have one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_per_key(
    facts: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join facts with a frame of one row per key; NULL matches NULL.

    The null-safe condition gives the per-key side a shuffle of its own even
    where it comes straight from an aggregate on the same keys. Both sides being
    shuffles, the adaptive planner can split a hot key's facts over many tasks;
    without that it has to leave the join as it is.
    """
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = facts.alias("l").join(per_key.alias("r"), on, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select("l.*", *[f"r.{c}" for c in per_key.columns if c not in keys])
