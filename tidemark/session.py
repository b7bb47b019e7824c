"""Session defaults that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", cores: int | None = None) -> SparkSession:
    """A local session for development, tests and benchmarks; a cluster brings its own.

    Adaptive execution sizes and splits shuffle partitions at run time, so the
    number set here is only where it starts from.
    """
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
