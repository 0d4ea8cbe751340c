"""Session helpers. A cluster names its own settings; these only fill the gaps."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "beamspark", cores: str | None = None) -> SparkSession:
    """Local session used by the tests and the bench; a cluster passes its own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # Rows carry whole traces, so an Arrow batch is bounded by bytes and not only by rows.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
