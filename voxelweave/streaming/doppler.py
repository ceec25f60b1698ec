"""Sliding-window power Doppler over a stream of samples. An addition: batch recordings have no late data.

Event time is the sample's time; a window closes when the watermark passes its end, and its state is two numbers for
each voxel, kept by Spark's own window aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def power_doppler_stream(samples: DataFrame, width: str = "3 seconds", stride: str = "1 second", late: str = "2 seconds", time: str = "ts") -> DataFrame:
    """window start and end, voxel_id, value: mean squared magnitude of each window and voxel of (ts, voxel_id, re, im)."""
    power = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    out = samples.withWatermark(time, late).groupBy(F.window(time, width, stride), "voxel_id").agg(power.alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "voxel_id", "value")
