"""Sending this package to the executors, so that it need not be installed there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None) -> SparkSession | None:
    """Once an application; functions that run in Python on executors import it there."""
    if spark is not None and spark.sparkContext.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-rivulet-")) / "rivulet.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(spark.sparkContext.applicationId)
    return spark
