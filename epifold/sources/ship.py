"""Make the package importable in the tasks of a session."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import epifold

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application.

    The archive is made on the driver and served to the executors by Spark.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(epifold.__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='epifold-')}/epifold", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
