"""What plots and panels of quality show: the data behind them, as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from . import reductions, series
from .layout import TIME, VALUE, VOXEL


def carpet(samples: DataFrame, mask: DataFrame | None = None, detrend_order: int | None = None, standardize: bool = True, limits: tuple[float | None, float | None] = (None, None), most: int = 800) -> tuple[DataFrame, tuple[float, float]]:
    """t_idx, voxel_id, value of a carpet plot, and the limits of its colours.

    Without a mask the voxels that are ever other than 0 count. Beyond `most` times only every 2 ** n-th one is kept, so
    that at most that many are. Limits that aren't given are the mean, less and plus twice the mean deviation in time.
    """
    if mask is None:
        mask = samples.groupBy(VOXEL).agg(F.max(F.coalesce(F.col(VALUE) != 0, F.lit(False))).alias("any")).filter("any").select(VOXEL)
    out = samples.join(mask.select(VOXEL).distinct(), VOXEL, "left_semi").select(TIME, VOXEL, VALUE)
    out = series.detrend(out, detrend_order) if detrend_order is not None else out
    out = series.standardize(out) if standardize else out
    n = out.agg(F.max(TIME)).first()[0]
    step = 2 ** max(0, math.ceil(math.log2((n + 1) / most))) if n is not None and n + 1 > most else 1
    each = out.groupBy(VOXEL).agg(F.avg(VALUE).alias("m"), F.stddev_pop(VALUE).alias("s")).agg(F.avg("m").alias("m"), F.avg("s").alias("s")).first()
    low, high = limits
    return out.filter(F.col(TIME) % step == 0), (each.m - 2 * each.s if low is None else low, each.m + 2 * each.s if high is None else high)


def color_limits(samples: DataFrame, low: float | None = None, high: float | None = None, value: str = VALUE) -> tuple[float, float]:
    """Limits of colours: those given, else the 2nd and 98th percentile of the finite values."""
    finite = samples.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    a, b = finite.agg(F.percentile(value, F.array(F.lit(0.02), F.lit(0.98)))).first()[0] or (0.0, 1.0)
    return a if low is None else low, b if high is None else high


def frame_windows(times: DataFrame, duration: float | None = None, reference: str = "start") -> DataFrame:
    """frame_id, start, end of each frame: from its time and duration, or up to the next frame's time without one."""
    w = Window.partitionBy(F.lit(0)).orderBy("time")  # frames of one recording
    t = F.col("time")
    if duration is None:
        step = F.lead("time").over(w) - t
        out = times.withColumn("__d", F.coalesce(step, F.lag(t).over(w) * -1 + t))
    else:
        out = times.withColumn("__d", F.lit(float(duration)))
    share = {"start": 0.0, "center": 0.5, "end": 1.0}[reference]
    return out.select(F.col(TIME).alias("frame_id"), (t - share * F.col("__d")).alias("start"), (t + (1 - share) * F.col("__d")).alias("end"))


def metrics(samples: DataFrame, dvars: bool = True, tsnr: bool = True, cv: bool = True, carpet_: bool = True) -> dict[str, DataFrame]:
    """The chosen measures by name, each one a plan that runs when it is read."""
    made = {"dvars": (dvars, lambda: reductions.compute_dvars(samples)), "tsnr": (tsnr, lambda: reductions.compute_tsnr(samples)), "cv": (cv, lambda: reductions.compute_cv(samples)), "carpet": (carpet_, lambda: carpet(samples)[0])}
    return {k: f() for k, (wanted, f) in made.items() if wanted}


def sorted_coordinates(samples: DataFrame, coords: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """samples with the places along each dimension numbered by rising coordinate."""
    for d in dims:
        w = Window.partitionBy("dim").orderBy("coord")
        new = coords.filter(F.col("dim") == d).select(F.col("idx").alias(f"{d}_idx"), (F.row_number().over(w) - 1).alias("__n"))
        samples = samples.join(new, f"{d}_idx").withColumn(f"{d}_idx", F.col("__n")).drop("__n")
    return samples
