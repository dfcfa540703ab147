"""Gives the executors' Python workers this package where they don't have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once, unless the workers' path already leads to it."""
    home = Path(__file__).resolve().parent.parent
    paths = [Path(p or ".").resolve() for p in (os.environ.get("PYTHONPATH", "").split(os.pathsep) if os.environ.get("PYTHONPATH") else [])]
    app = spark.sparkContext.applicationId
    if home in paths or app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="lacuna-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # local executors compare their copy with it until the end
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/lacuna", "zip", home, "lacuna"))
    _SHIPPED.add(app)
