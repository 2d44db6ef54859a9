"""Puts this package on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of an Arrow batch; documents can be long, and a batch is held twice on its way to Python.
BATCH_ROWS = "2000"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once for each application; they need no copy of the repository."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="folioloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # unless it was chosen
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    _shipped.add(sc.applicationId)
