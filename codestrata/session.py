"""Session factory used by tests, benchmarks and scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "codestrata", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution on; on a cluster the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "SPARK_MASTER" not in os.environ:
        builder = builder.master(f"local[{cores or os.cpu_count() or 4}]").config("spark.driver.memory", "8g")
    return builder.getOrCreate()
