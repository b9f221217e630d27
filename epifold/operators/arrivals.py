"""De-duplication of notifications as they arrive.

The state of a case is an aggregate that merges: for every column its value at
the smallest place in the order of arrival, with that place. A delivery is
reduced to states of its own, and only the buckets of the store that hold one of
its cases are read, merged and written anew. The files of all other buckets stay
as they are.

A version of the store is a small file that names the folder of every bucket. A
new one is published by a rename that refuses to replace: a writer that dies
leaves the last version in force, and of two writers the second one is refused
and applies its delivery again. A delivery applied twice changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold.sources.manifest import hadoop, publish, write_text

BUCKETS = 256
BUCKET = "_bucket"


class Overtaken(RuntimeError):
    """Another writer published a version in between."""


@dataclass(frozen=True)
class Rule:
    """How a case's rows become one: by ``key``, in the order of ``order``.

    Columns in ``best_of`` come from the earliest row that knows them, all others
    from the first row.
    """

    key: str
    order: str
    best_of: tuple[str, ...] = ()


def _at(c: str) -> str:
    return f"_at_{c}"


def states(rows: DataFrame, rule: Rule) -> DataFrame:
    """One state per case: every column's value and its place in the order."""
    others = [c for c in rows.columns if c not in (rule.key, rule.order)]
    place = F.col(rule.order)

    def source(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), place) if c in rule.best_of else place

    found = [F.min(place).alias(rule.order)]
    found += [F.min_by(c, source(c)).alias(c) for c in others]
    found += [F.min(source(c)).alias(_at(c)) for c in others]
    return rows.groupBy(rule.key).agg(*found)


def merged(several: DataFrame, rule: Rule, columns: Sequence[str]) -> DataFrame:
    """States of one case made one; merging is free of order and of repeats."""
    others = [c for c in columns if c not in (rule.key, rule.order)]
    found = [F.min(rule.order).alias(rule.order)]
    found += [F.min_by(c, _at(c)).alias(c) for c in others]
    found += [F.min(_at(c)).alias(_at(c)) for c in others]
    return several.groupBy(rule.key).agg(*found)


class Store:
    """States of all cases in buckets by key, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, rule: Rule, schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.rule, self.schema, self.buckets = spark, root.rstrip("/"), rule, schema, buckets
        place = schema[rule.order].dataType
        others = [c for c in schema.names if c not in (rule.key, rule.order)]
        held = [schema[rule.key], schema[rule.order], *(schema[c] for c in others), *(T.StructField(_at(c), place) for c in others)]
        self.held = T.StructType([T.StructField(f.name, f.dataType) for f in held])

    def version(self) -> tuple[int, dict[int, str]]:
        """The number of the newest version and the folder of every bucket in it."""
        target, fs = hadoop(self.spark, f"{self.root}/versions")
        names = [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        file, _ = hadoop(self.spark, f"{self.root}/versions/{max(numbers):012d}")
        stream = fs.open(file)
        try:
            named = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if (named["buckets"], named["key"]) != (self.buckets, self.rule.key):
            raise ValueError(f"the store at {self.root} has {named['buckets']} buckets by {named['key']}")
        return max(numbers), {int(b): p for b, p in named["folders"].items()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.rule.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.held)
        return self.spark.read.schema(self.held).parquet(*folders)

    def apply(self, delivery: DataFrame) -> list[int]:
        """Merge a delivery into the store; the buckets that were written anew."""
        number, folders = self.version()
        new = f"{self.root}/data/{uuid.uuid4().hex}"
        reduced = states(delivery.select(*self.schema.names), self.rule).withColumn(BUCKET, self._bucket())
        # Written, as the delivery is needed twice: for its buckets and for its states.
        reduced.write.parquet(f"{new}/delivery")
        arrived = self.spark.read.schema(reduced.schema).parquet(f"{new}/delivery")
        # At most one row per bucket.
        touched = sorted(r[0] for r in arrived.select(BUCKET).distinct().collect())
        old = self._read([folders[b] for b in touched if b in folders])
        both = old.unionByName(arrived.drop(BUCKET))
        result = merged(both, self.rule, self.schema.names).withColumn(BUCKET, self._bucket())
        result.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{new}/states")
        self._publish(number + 1, folders | {b: f"{new}/states/{BUCKET}={b}" for b in touched})
        target, fs = hadoop(self.spark, f"{new}/delivery")
        fs.delete(target, True)
        return touched

    def _publish(self, number: int, folders: dict[int, str]) -> None:
        named = {"buckets": self.buckets, "key": self.rule.key, "folders": folders}
        written = f"{self.root}/versions-written/{uuid.uuid4().hex}"
        write_text(self.spark, written, json.dumps(named))
        if not publish(self.spark, written, f"{self.root}/versions/{number:012d}"):
            raise Overtaken(f"version {number} of {self.root} is there already")

    def rows(self) -> DataFrame:
        """One row per case, as the rule makes it of all deliveries so far."""
        return self._read(list(self.version()[1].values())).select(*self.schema.names)

    def prune(self) -> None:
        """Remove the files that the newest version does not name; for a time without writers and readers."""
        used = {p.split("/data/")[1] for p in self.version()[1].values()}
        target, fs = hadoop(self.spark, f"{self.root}/data")
        for job in fs.listStatus(target):
            name = job.getPath().getName()
            kept = {u.split("/")[-1] for u in used if u.startswith(f"{name}/")}
            if not kept:
                fs.delete(job.getPath(), True)
                continue
            inside, _ = hadoop(self.spark, f"{self.root}/data/{name}/states")
            for bucket in fs.listStatus(inside):
                if bucket.isDirectory() and bucket.getPath().getName() not in kept:
                    fs.delete(bucket.getPath(), True)
