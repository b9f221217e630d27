"""Named queries, each with the survey entries it covers and its SQL check."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from epifold.plans import fixtures

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}

# Named sub-queries for the SQL checks; a text may use those defined before it.
PARTS: dict[str, str] = {name: fixtures.view_sql(name) for name in fixtures.VIEWS}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql.strip()


def with_parts(sql: str) -> str:
    """Prefix the query with the sub-queries it names, directly or through others."""

    def used(text, names):
        return {n for n in names if re.search(rf"\b{n}\b", text)}

    needed, pending = set(), used(sql, PARTS)
    while pending:
        name = pending.pop()
        needed.add(name)
        pending |= used(PARTS[name], PARTS) - needed
    if not needed:
        return sql.strip()
    texts = [f"{n} AS (\n{PARTS[n]}\n)" for n in PARTS if n in needed]
    return "WITH " + ",\n".join(texts) + "\n" + sql.strip()


def query(name: str, *covers: str, sql: str | None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, covers, build, None if sql is None else with_parts(sql))
        return build

    return add
