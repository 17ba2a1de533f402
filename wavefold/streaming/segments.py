"""Tumbling segmentation of a live signal: an extension, the batch operators know no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def tumbling_energy(stream: DataFrame, width: str, delay: str, keys: list[str]) -> DataFrame:
    """stream (ts, keys, v): energy, count and peak-to-peak value of each window; rows later than `delay` are dropped and
    state is kept no longer."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), *keys).agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.count(F.lit(1)).alias("n"), (F.max("v") - F.min("v")).alias("vpp"))
