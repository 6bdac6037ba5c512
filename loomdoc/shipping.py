"""The package's code on the executors, for operators with Python functions."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.join(tempfile.mkdtemp(), "loomdoc-code.zip")
    with zipfile.ZipFile(name, "w") as bundle:
        for folder, _, files in os.walk(top):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(name)
    _shipped.add(context.applicationId)
