"""Stored tables that are reused as long as their input stays the same.

A table lies in a folder named by the fingerprint of its input and parameters,
with a manifest beside its rows. It is written elsewhere first and published by
one rename that refuses to replace: a job that dies leaves nothing that could be
read, and of two jobs that write the same table one publishes and the other
takes what is there.

The fingerprint of a table does not depend on the order of its rows or files and
is a sum, so tasks add up their own part. By default it covers the files that a
frame reads (path, size, time of change) and what the frame makes of them, its
plan, which needs no job. ``by="content"`` covers the rows instead, in one pass:
for frames that hold rows of their own, or whose files are rewritten unchanged.
``by="auto"`` takes the files where a frame reads nothing else.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epifold.sources.storage import remove

MANIFEST = "_manifest.json"
WRITING = "_writing"
MODULUS = 1 << 128


def hadoop(spark: SparkSession, path: str):
    """A path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _sum(parts: Iterable[str]) -> str:
    """An order-free fingerprint of texts; that of two lots is the sum of theirs."""
    total = sum(int.from_bytes(hashlib.blake2b(p.encode(), digest_size=16).digest(), "big") for p in parts)
    return f"{total % MODULUS:032x}"


def merge_fingerprints(*parts: str) -> str:
    """The fingerprint of several lots of files or rows together."""
    return f"{sum(int(p, 16) for p in parts) % MODULUS:032x}"


def reads_only_files(df: DataFrame) -> bool:
    """Whether all rows of a frame come from files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = [leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())]
    return bool(kinds) and set(kinds) == {"LogicalRelation"} and len(df.inputFiles()) > 0


def plan_of(df: DataFrame) -> str:
    """What a frame does with its sources, as text that does not depend on the session."""
    conf, name = df.sparkSession.conf, "spark.sql.debug.maxToStringFields"
    before = conf.get(name)
    conf.set(name, str(10**6))
    try:
        return df._jdf.queryExecution().analyzed().canonicalized().toString()
    finally:
        conf.set(name, before)


def fingerprint_files(df: DataFrame) -> str:
    """Fingerprint of the files a frame reads, from their listing; no job runs."""
    spark = df.sparkSession
    if not reads_only_files(df):
        raise ValueError("the frame has rows that are in no file; use the fingerprint of its content")
    parts = []
    for name in df.inputFiles():
        target, fs = hadoop(spark, name)
        status = fs.getFileStatus(target)
        parts.append(f"{name}\n{status.getLen()}\n{status.getModificationTime()}")
    return _sum(parts)


def fingerprint_rows(df: DataFrame) -> str:
    """Fingerprint of a frame's rows as a bag, from one pass with partial sums.

    NULL differs from every value and from a NULL in another column. Names and
    types of the columns count, their order does not. Maps are refused.
    """
    if any(isinstance(f.dataType, T.MapType) for f in df.schema):
        raise ValueError("rows with maps have no fingerprint")
    names = sorted(df.columns)
    cells = [x for c in names for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    # Two hashes of a row, each added up as it is and mixed once more; sums that cannot overflow.
    sums = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), *cells)
        sums += [F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64(h, F.lit(seed)).cast("decimal(20,0)"))]
    row = df.agg(F.count(F.lit(1)), *sums).first()
    kinds = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return _sum([json.dumps([kinds, *(str(v or 0) for v in row)])])


def fingerprint(inputs: Sequence[DataFrame], parameters: Mapping[str, Any] | None = None, by: str = "files") -> str:
    """Fingerprint of several inputs, by their place, and of the parameters."""
    if by not in ("files", "content", "auto"):
        raise ValueError(f"no fingerprint by {by}")
    parts = []
    for i, df in enumerate(inputs):
        if by == "content" or (by == "auto" and not reads_only_files(df)):
            parts.append(f"rows {i}\n{fingerprint_rows(df)}")
        else:
            parts.append(f"files {i}\n{fingerprint_files(df)}\n{plan_of(df)}")
    return _sum([*parts, "parameters\n" + json.dumps(dict(parameters or {}), sort_keys=True, default=str)])


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """What a published table says of itself; None if there is none."""
    target, fs = hadoop(spark, f"{folder.rstrip('/')}/{MANIFEST}")
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file; an existing one is an error."""
    target, fs = hadoop(spark, path)
    stream = fs.create(target, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def publish(spark: SparkSession, written: str, folder: str) -> bool:
    """Rename a written folder or file to its final name; False if that name is taken."""
    jvm = spark.sparkContext._jvm
    source, fs = hadoop(spark, written)
    target = jvm.org.apache.hadoop.fs.Path(folder)
    fs.mkdirs(target.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, target, options)
    except Py4JJavaError as refused:
        # A taken name is told by its error, or by the published table itself.
        if "FileAlreadyExists" in str(refused.java_exception.getClass().getName()) or fs.exists(target):
            return False
        raise
    return True


def versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(time of publication, fingerprint) of the published tables, newest first."""
    target, fs = hadoop(spark, root)
    if not fs.exists(target):
        return []
    found = [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(target) if s.isDirectory()]
    return sorted(((t, n.removeprefix("v-")) for t, n in found if n.startswith("v-")), reverse=True)


def prune(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Remove all but the newest published tables, and what dead writers left.

    For a time at which no job writes or reads an older table.
    """
    for _, name in versions(spark, root)[keep:]:
        remove(spark, f"{root.rstrip('/')}/v-{name}")
    remove(spark, f"{root.rstrip('/')}/{WRITING}")


def materialise_current(
    build: Callable[[], DataFrame],
    root: str,
    inputs: Sequence[DataFrame],
    parameters: Mapping[str, Any] | None = None,
    by: str = "files",
) -> DataFrame:
    """The table that ``build`` makes of ``inputs``, from storage if these are unchanged.

    ``build`` is called only when no table of this fingerprint is published.
    ``parameters`` are all other values the result depends on.
    """
    spark = inputs[0].sparkSession
    root = root.rstrip("/")
    print_ = fingerprint(inputs, parameters, by)
    folder = f"{root}/v-{print_}"
    manifest = read_manifest(spark, folder)
    if manifest is None:
        written = f"{root}/{WRITING}/{uuid.uuid4().hex}"
        df = build()
        df.write.parquet(f"{written}/rows")
        manifest = {"fingerprint": print_, "by": by, "parameters": dict(parameters or {}), "schema": df.schema.jsonValue()}
        write_text(spark, f"{written}/{MANIFEST}", json.dumps(manifest, default=str))
        if not publish(spark, written, folder):
            # Another job was first; its table is of the same input.
            remove(spark, written)
            manifest = read_manifest(spark, folder)
    return spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{folder}/rows")
