"""Sending this package to the executors, whose workers may not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the files of the application, once each. The archive lies with the driver, whose file server sends it on."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(target)
        _sent.add(sc.applicationId)
    return spark
