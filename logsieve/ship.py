"""Makes the package importable in Python workers that were started without it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def to_workers(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_logsieve_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="logsieve-src-"), "logsieve_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("logsieve", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._logsieve_shipped = True


def shipped(query):
    """Wrap query(spark, ...) so that workers have the package."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        to_workers(spark)
        return query(spark, *args, **kwargs)

    return run
