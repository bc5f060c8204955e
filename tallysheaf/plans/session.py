"""Session settings the plans are written for."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    # A generated method past 8,000 bytes is never compiled by the JVM's JIT; let such a stage fall back to projections,
    # whose code Spark splits into methods that are.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Datetimes are UTC wall clocks; date formatting must not shift them.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A key may hold a third of all rows: split it even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; everything else stays as the cluster has it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per context: a cluster's executors need no installed copy of it."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    if any(str(f).endswith(f"{name}-shipped.zip") for f in context._python_includes):
        return spark
    # The archive is the driver's own; Spark serves it to the executors from there.
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{name}-shipped.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    z.write(path, os.path.join(name, os.path.relpath(path, root)))
    context.addPyFile(archive)
    return spark
