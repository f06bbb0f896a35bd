"""Makes this package importable in the cluster's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once for each context.

    Workers need not share the driver's folders or import path: Spark's own
    file server hands them the archive.
    """
    context = spark.sparkContext
    if getattr(context, "_marginalia_shipped", False):
        return
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="marginalia-"), "marginalia.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, str(Path(package.name) / source.relative_to(package)))
    context.addPyFile(path)
    context._marginalia_shipped = True
