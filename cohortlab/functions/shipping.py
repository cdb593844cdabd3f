"""The package on the executors, for stages that run Python there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="cohortlab-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root, name = os.path.split(package)
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, name), "zip", root, name))
        _shipped.add(app)
