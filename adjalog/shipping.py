"""Make this package importable by the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_adjalog_shipped", False):
        root = Path(__file__).resolve().parent
        name = Path(tempfile.mkdtemp(prefix="adjalog-")) / "adjalog.zip"
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(name))
        context._adjalog_shipped = True
    return spark
