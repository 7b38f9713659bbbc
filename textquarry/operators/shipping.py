"""Making this package importable in Python workers, wherever the driver was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once per application. The archive lies in the driver's own temporary folder."""
    sc = spark.sparkContext
    if getattr(sc, "_textquarry_shipped", False):
        return
    import textquarry

    root = os.path.dirname(os.path.dirname(os.path.abspath(textquarry.__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="textquarry-"), "textquarry_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "textquarry")):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    sc._textquarry_shipped = True
