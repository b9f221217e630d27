"""Rows counted in the pass that filters them.

A rule names a reason to reject a row; the first one that applies counts. What was
read, kept and rejected is observed while the rows flow to their destination, so
no table is read twice. The counts have to add up, or the job fails.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

READ, KEPT = "read", "kept"


class Unbalanced(RuntimeError):
    """Rows were lost or counted twice."""


@dataclass(frozen=True)
class Accounts:
    """The counts of a filter, known once its rows have been written."""

    before: Observation
    after: Observation
    rules: tuple[str, ...]

    def counts(self) -> dict[str, int]:
        """Rows read, kept and rejected by each rule; waits for the first action."""
        found = {k: int(v) for k, v in self.before.get.items()}
        found[KEPT] = int(self.after.get[KEPT])
        rejected = sum(found[f"rejected_{r}"] for r in self.rules)
        if found[READ] != found[KEPT] + rejected:
            raise Unbalanced(f"{found[READ]} rows read, {found[KEPT]} kept and {rejected} rejected")
        return found


def accounted(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, Accounts]:
    """The rows that no rule rejects, and their accounts.

    A rule that is NULL for a row does not reject it. The frame is for one action
    that comes straight after it, such as a write: behind a shuffle, tasks that
    run again would count again.
    """
    applies = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(applies.items())):
        reason = F.when(rule, F.lit(name)).otherwise(reason)
    before, after = Observation(), Observation()
    marked = df.withColumn("_reason", reason).observe(
        before,
        F.count(F.lit(1)).alias(READ),
        *[F.count(F.when(F.col("_reason") == name, 1)).alias(f"rejected_{name}") for name in rules],
    )
    kept = marked.where(F.col("_reason").isNull()).drop("_reason").observe(after, F.count(F.lit(1)).alias(KEPT))
    return kept, Accounts(before, after, tuple(rules))


def write_accounted(df: DataFrame, path: str, rules: Mapping[str, Column]) -> dict[str, int]:
    """Write the rows that no rule rejects; the counts, checked against the stored table."""
    kept, accounts = accounted(df, rules)
    kept.write.parquet(path)
    counts = accounts.counts()
    stored = df.sparkSession.read.schema(kept.schema).parquet(path).count()
    if stored != counts[KEPT]:
        raise Unbalanced(f"{counts[KEPT]} rows counted and {stored} stored")
    return counts


def incomplete(df: DataFrame, *columns: str) -> Column:
    """Whether a row lacks one of the columns, by default any."""
    missing = F.lit(False)
    for c in columns or df.columns:
        missing = missing | F.col(f"`{c}`").isNull()
    return missing
