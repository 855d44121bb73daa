"""Readies a session: the package is importable on every executor, and Arrow batches of texts stay small."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: A row may hold a whole text, so Spark's default batches of 10,000 rows and 64 MB are large for a Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_shipped: set[str] = set()


def ship(spark: SparkSession, small_batches: bool = True) -> None:
    """Sends the package to the executors, once per application; Spark fetches it for executors that join later as well.

    With ``small_batches`` the session's Arrow batches are made small, as the operators on texts need.
    """
    sc = spark.sparkContext
    for name, value in BATCHES.items() if small_batches else ():
        spark.conf.set(name, value)
    if sc.applicationId not in _shipped:
        folder = tempfile.mkdtemp(prefix="wayline-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "wayline"), "zip", ROOT, "wayline"))
        _shipped.add(sc.applicationId)
