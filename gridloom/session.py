"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give executors this package once per application (Python workers import it by name)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        handle, name = tempfile.mkstemp(prefix="gridloom-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(name, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(name)
        _shipped.add(app)
    return spark
