"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends a zip of the package to all workers, once for an application, unless they find it by ``PYTHONPATH``."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    if context.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="loomwork-zip-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, "loomwork"), "zip", root, "loomwork"))
        _shipped.add(context.applicationId)
