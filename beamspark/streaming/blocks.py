"""Streaming forms of two batch steps. The jobs themselves are batch; these let a live feed use them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def block_rms(samples: DataFrame, key: str, *, block: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Root mean square per key and tumbling block of (key, ts, x) samples; closed blocks are final."""
    w = samples.withWatermark("ts", late).groupBy(key, F.window("ts", block).alias("w")).agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))
    return w.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rms", "n")


def append_manifest(entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append arriving manifest entries as JSON, each exactly once; stops when the input is used up."""
    return (
        entries.writeStream.format("json").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
