"""The library on the executors, where it is not installed there."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import hearsay

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors' Python, once per application; returns the session."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(hearsay.__file__).parent
        folder = tempfile.mkdtemp(prefix="hearsay-package-")
        archive = shutil.make_archive(f"{folder}/hearsay", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
