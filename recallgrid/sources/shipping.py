"""The package on the executors: Arrow functions refer to its modules, which a worker must be able to import."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_MARK = "_recallgrid_shipped"


def ship_package(spark: SparkSession) -> None:
    """Hands the package to the executors of a session, once: the driver serves it as a zip to whoever runs a task."""
    sc = spark.sparkContext
    if getattr(sc, _MARK, False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(package)
    folder = tempfile.mkdtemp(prefix="recallgrid-")  # on the driver only, which serves it
    path = os.path.join(folder, "recallgrid_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    setattr(sc, _MARK, True)
