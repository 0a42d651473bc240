"""What a Spark session needs before Python code of this package runs on executors."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession


_ONCE = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a Spark context.

    The archive goes through Spark's own file server, so executors need neither the driver's disk nor
    an installed copy. Where the package is installed everywhere, that does no harm.
    """
    with _ONCE:  # fits run side by side in driver threads
        _ship(spark.sparkContext)


def _ship(context) -> None:
    if getattr(context, "_plumbline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="plumbline-")), "plumbline_package.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("plumbline", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._plumbline_shipped = True
