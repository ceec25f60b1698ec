"""Sliding windows over complex samples: power Doppler, B-mode, axial velocity, and clutter filters.

Samples have a value struct re, im. A window is a row of the plan, and a sample is copied to the windows that hold it
(width / stride of them); aggregates over (window, voxel) are partial before their shuffle. Clutter filters need a whole
window at once: it is one bounded block, and blocks are spread over the tasks by window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import filters
from ..functions.scale import convert_time_reference
from .layout import TIME, VOXEL


def window_count(n: int, width: int, stride: int) -> int:
    """Complete windows only: what is left at the end is dropped."""
    if not 0 < stride <= width <= n:
        raise ValueError(f"stride {stride} and width {width} must be positive, the stride at most the width, the width at most {n}")
    return (n - width) // stride + 1


def sliding_windows(samples: DataFrame, n: int, width: int, stride: int | None = None, time: str = TIME, out: str = "window_id") -> DataFrame:
    """samples with the windows that hold them, a row for each."""
    stride = stride or width
    last = window_count(n, width, stride) - 1
    t = F.col(time)
    first = F.greatest(F.ceil((t - (width - 1)) / stride), F.lit(0))
    final = F.least(F.floor(t / stride), F.lit(last))
    return samples.filter(t < last * stride + width).withColumn("__w", F.sequence(first.cast("int"), final.cast("int"))).withColumn(out, F.explode("__w")).drop("__w")


def power_doppler(windows: DataFrame) -> DataFrame:
    """Mean squared magnitude of each window and voxel."""
    z = F.col("value")
    return windows.groupBy("window_id", VOXEL).agg(F.avg(z["re"] * z["re"] + z["im"] * z["im"]).alias("value"))


def bmode(windows: DataFrame) -> DataFrame:
    """Mean magnitude of each window and voxel."""
    z = F.col("value")
    return windows.groupBy("window_id", VOXEL).agg(F.avg(F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])).alias("value"))


def axial_velocity(windows: DataFrame, rate: float, frequency: float, lag: int = 1, sound: float = 1540.0, time: str = TIME, grid: DataFrame | None = None, kernel: int | tuple[int, int, int] = 3) -> DataFrame:
    """Velocity from the phase of the lag autocorrelation: phase * rate * c / (4 pi f lag).

    The phase is smoothed by a median over the kernel's neighbours in space. grid has voxel_id and the places z_idx,
    y_idx, x_idx; only a kernel of 1 does without it.
    """
    w = Window.partitionBy("window_id", VOXEL).orderBy(time)
    z, b = F.col("value"), F.lag("value", lag).over(w)
    steps = windows.select("window_id", VOXEL, (z["re"] * b["re"] + z["im"] * b["im"]).alias("re"), (z["im"] * b["re"] - z["re"] * b["im"]).alias("im"))
    phase = steps.groupBy("window_id", VOXEL).agg(F.atan2(F.sum("im"), F.sum("re")).alias("value"))
    if kernel not in (1, (1, 1, 1)):
        if grid is None:
            raise ValueError("a median over neighbours needs the grid of the voxels")
        phase = median_filter(phase, grid, kernel)
    return phase.withColumn("value", F.col("value") * F.lit(rate * sound / (4 * math.pi * frequency * lag)))


def kernel_sizes(kernel: int | tuple[int, int, int], shape: tuple[int, int, int]) -> tuple[int, ...]:
    """Odd sizes along z, y, x: at most the volume's, and one more where that is even."""
    sizes = (kernel,) * 3 if isinstance(kernel, int) else tuple(kernel)
    if len(sizes) != 3 or any(k < 1 for k in sizes):
        raise ValueError(f"a kernel is a positive number or three of them, not {kernel!r}")
    return tuple(k + (k + 1) % 2 for k in map(min, sizes, shape))


def median_filter(volumes: DataFrame, grid: DataFrame, kernel: int | tuple[int, int, int] = 3) -> DataFrame:
    """window_id, voxel_id, value: the median over each voxel's neighbours; beyond the volume all is 0.

    A value goes to the places that have it in their kernel, as many rows as the kernel has cells. Places are dealt by
    window and place, so no task gets a volume.
    """
    dims = ["z_idx", "y_idx", "x_idx"]
    low = [F.min(d).alias(f"a{k}") for k, d in enumerate(dims)]
    ends = grid.agg(*low, *[F.max(d).alias(f"b{k}") for k, d in enumerate(dims)]).first()
    sizes = kernel_sizes(kernel, tuple(ends[k + 3] - ends[k] + 1 for k in range(3)))
    cells = math.prod(sizes)
    out = volumes.filter("value IS NOT NULL").join(grid.select(VOXEL, *dims), VOXEL).select("window_id", "value", F.col(VOXEL).alias("__own"), *dims)
    for d, size in zip(dims, sizes, strict=True):
        if size > 1:
            out = out.withColumn("__d", F.explode(F.sequence(F.lit(-(size // 2)), F.lit(size // 2))))
            out = out.withColumns({d: F.col(d) + F.col("__d"), "__own": F.when(F.col("__d") == 0, F.col("__own"))}).drop("__d")
    near = out.groupBy("window_id", *dims).agg(F.collect_list("value").alias("near"), F.max("__own").alias(VOXEL))
    padded = F.array_sort(F.concat("near", F.array_repeat(F.lit(0.0), F.lit(cells) - F.size("near"))))
    return near.filter(F.col(VOXEL).isNotNull()).select("window_id", VOXEL, F.element_at(padded, cells // 2 + 1).alias("value"))


def acquisition_duration(meta: dict, times: list[float] | None = None) -> float:
    """Seconds that one volume takes: the attribute, else one over the compound rate, else the typical step of times."""
    import warnings

    if meta.get("volume_acquisition_duration") is not None:
        return float(meta["volume_acquisition_duration"])
    if meta.get("compound_sampling_frequency"):
        warnings.warn("the volume's duration is taken from the compound rate", stacklevel=2)
        return 1 / float(meta["compound_sampling_frequency"])
    if times is not None and len(times) > 1:
        warnings.warn("the volume's duration is taken from the typical step of times", stacklevel=2)
        return float(np.median(np.diff(times)))
    raise ValueError("nothing says how long a volume takes")


def filter_rate(times: list[float], method: str = "butterworth", unit: float = 1.0, tolerance: float = 0.01) -> float:
    """Volumes in a second from their times in units of so many seconds; a Butterworth filter needs even steps."""
    steps = np.diff(np.asarray(times, float)) * unit
    if not len(steps):
        raise ValueError("two times or more are needed")
    typical = float(np.median(steps))
    if method == "butterworth" and (np.abs(steps - typical) > tolerance * abs(typical)).any():
        raise ValueError("a Butterworth filter needs uniform times")
    return 1 / typical


def typical_duration(durations: DataFrame, tolerance: float = 0.01, column: str = "duration") -> float:
    """The median duration of windows, with a warning where some are off by more than the tolerance."""
    import warnings

    row = durations.agg(F.median(column).alias("m")).first()
    off = durations.filter(F.abs(F.col(column) - F.lit(row.m)) > tolerance * abs(row.m)).limit(1).count()
    if off:
        warnings.warn(f"durations of windows differ by more than {tolerance:.0%}", stacklevel=2)
    return float(row.m)


def filter_label(method: str | None, low=None, high=None) -> str:
    """A filter in words for a recording's history; indices are a half-open range, other cutoffs are both kept."""
    if method is None or low is None and high is None:
        return method or "none"
    a, b = ("" if x is None else f"{x:g}" for x in (low, high))
    return f"{method}[{a}, {b})" if method == "svd_indices" else f"{method}[{a}, {b}]"


def window_timings(times: DataFrame, n: int, width: int, stride: int, duration: float, from_reference: str = "start", to_reference: str = "start", inner_width: int | None = None, inner_stride: int | None = None) -> DataFrame:
    """window_id, time, duration of each output volume: from its first sample's onset to the end of its last one.

    With inner windows each outer window holds as many inner ones as fit, numbered through.
    """
    outer = window_count(n, width, stride)
    spark = times.sparkSession
    if inner_width is None:
        grid = spark.range(outer).select(F.col("id").alias("window_id"), (F.col("id") * stride).alias("first"), (F.col("id") * stride + width - 1).alias("last"))
    else:
        inner_stride = inner_stride or inner_width
        k = window_count(width, inner_width, inner_stride)
        first = F.floor(F.col("id") / k) * stride + (F.col("id") % k) * inner_stride
        grid = spark.range(outer * k).select(F.col("id").alias("window_id"), first.alias("first"), (first + inner_width - 1).alias("last"))
    a, b = times.select(F.col(TIME).alias("first"), F.col("time").alias("t0")), times.select(F.col(TIME).alias("last"), F.col("time").alias("t1"))
    joined = grid.join(a, "first").join(b, "last")
    start = convert_time_reference(F.col("t0"), duration, from_reference, "start")
    span = F.col("t1") - F.col("t0") + F.lit(float(duration))
    return joined.select("window_id", convert_time_reference(start, span, "start", to_reference).alias("time"), span.alias("duration"))


# Kernels on one block: frames x voxels, complex.


def temporal_components(block: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Energies in descending order and temporal components, from the time x time Gram matrix of the masked voxels."""
    part = block if mask is None else block[:, mask]
    energy, vectors = np.linalg.eigh(part @ part.conj().T)
    return energy[::-1], vectors[:, ::-1]


def without(block: np.ndarray, vectors: np.ndarray, drop: np.ndarray) -> np.ndarray:
    v = vectors[:, drop]
    return block - v @ (v.conj().T @ block)


def svd_from_indices(block: np.ndarray, mask: np.ndarray | None = None, low: int | None = None, high: int | None = None) -> np.ndarray:
    """Remove components [0, low) and [high, end)."""
    _, vectors = temporal_components(block, mask)
    k = np.arange(vectors.shape[1])
    return without(block, vectors, (k < (low or 0)) | (k >= (len(k) if high is None else high)))


def svd_from_energy(block: np.ndarray, mask: np.ndarray | None = None, low: float | None = None, high: float | None = None) -> np.ndarray:
    """Remove components whose energy is below low or above high."""
    energy, vectors = temporal_components(block, mask)
    return without(block, vectors, (energy < (-np.inf if low is None else low)) | (energy > (np.inf if high is None else high)))


def svd_from_cumulative_energy(block: np.ndarray, mask: np.ndarray | None = None, low: float | None = None, high: float | None = None) -> np.ndarray:
    """The same on energies summed from the smallest one up."""
    energy, vectors = temporal_components(block, mask)
    summed = np.cumsum(energy[::-1])[::-1]
    return without(block, vectors, (summed < (-np.inf if low is None else low)) | (summed > (np.inf if high is None else high)))


def butterworth_block(block: np.ndarray, rate: float, low: float | None = None, high: float | None = None, order: int = 4) -> np.ndarray:
    """Zero-phase filter along frames; without cutoffs the block itself."""
    if low is None and high is None:
        return block
    s = filters.butterworth(order, rate, low, high)
    return (filters.forward_backward(s, block.real.T) + 1j * filters.forward_backward(s, block.imag.T)).T


METHODS = {"svd_indices": svd_from_indices, "svd_energy": svd_from_energy, "svd_cumulative_energy": svd_from_cumulative_energy}


def process_blocks(windows: DataFrame, function, schema: str = "window_id int, voxel_id long, value double", time: str = TIME) -> DataFrame:
    """function(frames x voxels, voxel ids) -> a value for each voxel, or one volume of them for each inner window.

    Volumes of inner windows are numbered through: window_id times their number, plus their place.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        z = frame["re"].to_numpy() + 1j * frame["im"].to_numpy()
        rows, t = np.unique(frame[time].to_numpy(), return_inverse=True)
        voxels, x = np.unique(frame[VOXEL].to_numpy(), return_inverse=True)
        block = np.zeros((len(rows), len(voxels)), complex)
        block[t, x] = z
        volumes = function(block, voxels)
        k = len(volumes) if np.ndim(volumes) == 2 else 1
        ids = int(frame["window_id"].iloc[0]) * k + np.repeat(np.arange(k), len(voxels))
        return pd.DataFrame({"window_id": ids, VOXEL: np.tile(voxels, k), "value": np.ravel(volumes)})

    flat = windows.select("window_id", VOXEL, time, F.col("value.re").alias("re"), F.col("value.im").alias("im"))
    return flat.groupBy("window_id").applyInPandas(run, schema)


def filtered(kernel, method: str | None, rate: float | None, low, high, mask: np.ndarray | None, inner_width: int | None, inner_stride: int | None):
    """A function on blocks: clutter filter, then the kernel on the block or on each inner window of it."""

    def run(block: np.ndarray, voxels: np.ndarray) -> np.ndarray:
        inside = None if mask is None else np.isin(voxels, mask)
        if method in METHODS:
            block = METHODS[method](block, inside, low, high)
        elif method == "butterworth":
            block = butterworth_block(block, rate, low, high)
        if inner_width is None:
            return kernel(block)
        step = inner_stride or inner_width
        return np.stack([kernel(block[a : a + inner_width]) for a in range(0, len(block) - inner_width + 1, step)])

    return run


def filtered_power_doppler(windows: DataFrame, method: str = "svd_indices", rate: float | None = None, low=None, high=None, mask: np.ndarray | None = None, inner_width: int | None = None, inner_stride: int | None = None) -> DataFrame:
    return process_blocks(windows, filtered(lambda b: (np.abs(b) ** 2).mean(0), method, rate, low, high, mask, inner_width, inner_stride))


def filtered_bmode(windows: DataFrame, method: str = "svd_indices", rate: float | None = None, low=None, high=None, mask: np.ndarray | None = None, inner_width: int | None = None, inner_stride: int | None = None) -> DataFrame:
    return process_blocks(windows, filtered(lambda b: np.abs(b).mean(0), method, rate, low, high, mask, inner_width, inner_stride))


def filtered_axial_velocity(windows: DataFrame, rate: float, frequency: float, lag: int = 1, sound: float = 1540.0, method: str = "svd_indices", low=None, high=None, mask: np.ndarray | None = None, inner_width: int | None = None, inner_stride: int | None = None, grid: DataFrame | None = None, kernel: int | tuple[int, int, int] = 3) -> DataFrame:
    """Axial velocity after a clutter filter, with the phase's median over neighbours as in `axial_velocity`."""
    phase = process_blocks(windows, filtered(lambda b: np.angle((b[lag:] * b[:-lag].conj()).sum(0)), method, rate, low, high, mask, inner_width, inner_stride))
    if kernel not in (1, (1, 1, 1)):
        if grid is None:
            raise ValueError("a median over neighbours needs the grid of the voxels")
        phase = median_filter(phase, grid, kernel)
    return phase.withColumn("value", F.col("value") * F.lit(rate * sound / (4 * np.pi * frequency * lag)))


def cumulative_energy_threshold(windows: DataFrame, index: int, time: str = TIME) -> float:
    """Over all windows the least energy that is left when the `index` largest components are gone."""

    def rest(block: np.ndarray, voxels: np.ndarray) -> np.ndarray:
        energy, _ = temporal_components(block)
        return np.full(len(voxels), energy[index:].sum())

    return process_blocks(windows, rest, time=time).agg(F.min("value")).first()[0]
