"""What every machine of a cluster needs to have before tasks run Python code of this package."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers of all executors, those that join later too; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="fieldglass-"), "fieldglass.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(here):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


def carried(module: str) -> None:
    """Pickle what this module defines by value: stateful processors and data sources also run in workers beside the driver, which have no shipped package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
