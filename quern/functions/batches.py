"""Bounds on what one call of a Python function gets."""

from __future__ import annotations

from pyspark.sql import SparkSession


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes where the session sets no bound itself."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(16 << 20))
