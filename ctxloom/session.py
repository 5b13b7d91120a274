"""Making the package known to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once per context, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_ctxloom_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="ctxloom-"), "ctxloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(path)
        context._ctxloom_shipped = True
    return spark
