"""Operators along time: cleaning, filtering, resampling, censoring, and smoothing along an axis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import filters
from .layout import SERIES, TIME, VALUE, VOXEL, checkpointed, exact_quantile, map_series, matrix_of, over_time, time_components, whole

EPSILON = float(np.finfo(float).eps)


def detrend(samples: DataFrame, order: int = 1, value: str = VALUE, time: str = TIME) -> DataFrame:
    """Subtract each voxel's mean (order 0) or least-squares line over the sample index (order 1)."""
    v, t, w = F.col(value).cast("double"), F.col(time).cast("double"), whole()
    if order == 0:
        return samples.withColumn(value, v - F.avg(v).over(w))
    if order != 1:
        raise ValueError("higher orders take the series encoding: detrend_series")
    slope = F.covar_pop(v, t).over(w) / F.var_pop(t).over(w)
    return samples.withColumn(value, v - F.avg(v).over(w) - F.coalesce(slope, F.lit(0.0)) * (t - F.avg(t).over(w)))


def polynomial_factor(n: int, order: int) -> np.ndarray:
    """times x (order + 1): an orthonormal basis of polynomials."""
    return np.linalg.qr(np.vander(np.linspace(-1, 1, n), order + 1, increasing=True))[0]


def polynomial_residual(n: int, order: int) -> np.ndarray:
    """The projector as a whole matrix, for short series."""
    q = polynomial_factor(n, order)
    return np.eye(n) - q @ q.T


def without(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rows less what they have of an orthonormal basis (times x few): two thin products, no times x times matrix."""
    return x - (x @ q) @ q.T


def detrend_series(series: DataFrame, n: int, order: int) -> DataFrame:
    q = polynomial_factor(n, order)
    return map_series(series, lambda x: without(x, q))


def standardize(samples: DataFrame, method: str = "zscore", value: str = VALUE) -> DataFrame:
    """zscore: over the standard deviation (n - 1); psc: percent of the mean's size. Below machine precision: NaN."""
    v, w = F.col(value).cast("double"), whole()
    mean = F.avg(v).over(w)
    if method == "zscore":
        scale, factor = F.stddev_samp(v).over(w), 1.0
    elif method == "psc":
        scale, factor = F.abs(mean), 100.0
    else:
        raise ValueError(f"unknown method {method!r}; known: zscore, psc")
    return samples.withColumn(value, F.when(scale < EPSILON, F.lit(float("nan"))).otherwise((v - mean) / scale * factor))


def censor_samples(samples: DataFrame, sample_mask: DataFrame, time: str = TIME) -> DataFrame:
    """Samples of the times that the mask (t_idx, keep) keeps; an error if it keeps none."""
    if not sample_mask.filter("keep").limit(1).count():
        raise ValueError("the sample mask drops every time")
    return samples.join(sample_mask.filter("keep").select(time), time, "left_semi")


def interpolated(v: Column, t: Column, w_before, w_after) -> Column:
    """v where it isn't null, otherwise on the line between its neighbours in time that aren't; null outside of them."""
    known = F.when(v.isNotNull(), F.struct(t.cast("double").alias("t"), v.alias("v")))
    a, b = F.last(known, True).over(w_before), F.first(known, True).over(w_after)
    return F.coalesce(v, a["v"] + (b["v"] - a["v"]) * (t - a["t"]) / (b["t"] - a["t"]))


def _sides(keys: tuple[str, ...], time: str):
    w = over_time(keys, time)
    return w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)


def interpolate_samples(samples: DataFrame, sample_mask: DataFrame, value: str = VALUE, time: str = TIME, edges: bool = False) -> DataFrame:
    """Values of censored times from the line between kept neighbours; outside of them null, or the nearest kept one."""
    v = F.when(F.col("keep"), F.col(value).cast("double"))
    before, after = _sides((VOXEL,), time)
    filled = interpolated(v, F.col(time), before, after)
    if edges:
        filled = F.coalesce(filled, F.last(v, True).over(before), F.first(v, True).over(after))
    return samples.join(sample_mask.select(time, "keep"), time).withColumn(value, filled).drop("keep")


def repair_non_finite(samples: DataFrame, value: str = VALUE, time: str = TIME) -> DataFrame:
    """Non-finite samples from the line between finite neighbours, at the ends from the nearest one."""
    x = F.col(value).cast("double")
    v = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    before, after = _sides((VOXEL,), time)
    return samples.withColumn(value, F.coalesce(interpolated(v, F.col(time), before, after), F.last(v, True).over(before), F.first(v, True).over(after)))


def resample_time(samples: DataFrame, targets: DataFrame, method: str = "linear", extrapolate: bool = True, value: str = VALUE, time: str = "time", key: str = VOXEL) -> DataFrame:
    """key, time, value of each voxel at the target times (time), from its own samples at (time).

    linear (slinear): the line through the neighbours, or through the two outermost samples beyond them; nearest (the
    earlier one on a tie; nearest-up the later one), previous (zero), next: the neighbour's value. Samples and targets are sorted together once, so no sample meets any
    target but its neighbours.
    """
    t, method = F.col(time), {"slinear": "linear", "zero": "previous"}.get(method, method)
    grid = samples.select(key).distinct().crossJoin(F.broadcast(targets.select(t.cast("double").alias(time)).distinct()))
    both = samples.select(key, t.cast("double").alias(time), F.col(value).cast("double").alias("v"), F.lit(False).alias("asked"))
    both = both.unionByName(grid.select(key, time, F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked")))
    order = Window.partitionBy(key).orderBy(time, "asked")
    later = Window.partitionBy(key).orderBy(F.col(time).desc(), "asked")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), later.rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(~F.col("asked"), F.struct(time, "v"))
    a, b = F.last(known, True).over(back), F.last(known, True).over(ahead)
    line = lambda p, q: p["v"] + (q["v"] - p["v"]) * (t - p[time]) / (q[time] - p[time])
    if method == "linear":
        ends = samples.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(t.cast("double").alias(time), F.col(value).cast("double").alias("v")))).alias("s")) if extrapolate else None
        inside = F.when(a["v"].isNotNull() & b["v"].isNotNull(), F.when(a[time] == b[time], a["v"]).otherwise(line(a, b)))
        out = both.withColumn("out", inside).filter("asked").select(key, time, "out")
        if extrapolate:
            n = F.size("s")
            two = ends.select(key, F.get("s", F.lit(0)).alias("f0"), F.get("s", F.lit(1)).alias("f1"), F.get("s", n - 2).alias("l0"), F.get("s", n - 1).alias("l1"))
            beyond = F.when(t < F.col("f0")[time], line(F.col("f0"), F.col("f1"))).when(t > F.col("l1")[time], line(F.col("l0"), F.col("l1")))
            out = out.join(two, key).select(key, time, F.coalesce("out", beyond).alias("out"))
        return out.select(key, time, F.col("out").alias(value))
    earlier = {"nearest": t - a[time] <= b[time] - t, "nearest-up": t - a[time] < b[time] - t}
    if method not in ("previous", "next", *earlier):
        raise ValueError(f"unknown method {method!r}; quadratic and cubic take the series encoding: resample_series")
    value_of = {"previous": a["v"], "next": b["v"]} | {k: F.when(b["v"].isNull() | (a["v"].isNotNull() & closer), a["v"]).otherwise(b["v"]) for k, closer in earlier.items()}
    value_of = value_of[method]
    return both.withColumn("out", value_of).filter("asked").select(key, time, F.col("out").alias(value))


def spline_basis(knots: np.ndarray, degree: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the degree + 1 B-splines that aren't 0 at each x, and their values; the outer pieces go on beyond the ends.

    By the recurrence over degrees on these splines alone: a row has as many numbers as a piece has splines.
    """
    count = len(knots) - degree - 1
    piece = np.clip(np.searchsorted(knots, x, "right") - 1, degree, count - 1)
    values = np.ones((len(x), 1))
    for d in range(1, degree + 1):
        new = np.zeros((len(x), d + 1))
        for j in range(d):  # the j-th spline of degree d - 1 on the piece gives to two of degree d
            low, high = knots[piece - d + 1 + j], knots[piece + 1 + j]
            share = values[:, j] / (high - low)
            new[:, j] += (high - x) * share
            new[:, j + 1] += (x - low) * share
        values = new
    return piece - degree, values


class Banded:
    """LU factors of a matrix that is 0 beyond `width` places from its diagonal, without pivoting: collocation matrices of
    splines are totally positive, so that none is needed. Rows of right-hand sides are solved at once."""

    def __init__(self, first: np.ndarray, values: np.ndarray) -> None:
        """Row i has values[i] from column first[i] on."""
        n, k = values.shape
        self.width = w = max(k - 1, int(np.abs(first - np.arange(n)).max(initial=0)), int((first + k - 1 - np.arange(n)).max(initial=0)))
        band = np.zeros((n, 2 * w + 1))  # column c of row i stands at c - i + w
        for j in range(k):
            at = first + j - np.arange(n) + w
            inside = (at >= 0) & (at < 2 * w + 1)
            band[np.flatnonzero(inside), at[inside]] += values[inside, j]
        for i in range(n):
            for r in range(i + 1, min(n, i + w + 1)):
                low = band[r, i - r + w]
                if low:
                    low = low / band[i, w]
                    band[r, i - r + w] = low
                    band[r, i - r + w + 1 : i - r + 2 * w + 1] -= low * band[i, w + 1 :]
        self.band = band

    def solve(self, y: np.ndarray) -> np.ndarray:
        """Rows x with matrix @ x = y, for each row y."""
        x, w, n = np.array(y, float).T.copy(), self.width, len(self.band)
        for i in range(n):
            for c in range(max(0, i - w), i):
                if low := self.band[i, c - i + w]:
                    x[i] -= low * x[c]
        for i in range(n - 1, -1, -1):
            for c in range(i + 1, min(n, i + w + 1)):
                if high := self.band[i, c - i + w]:
                    x[i] -= high * x[c]
            x[i] /= self.band[i, w]
        return x.T


class Resampler:
    """How a series gives its values at other times: a few weights for each target, of the samples or of spline
    coefficients that a banded system gives. Nothing is times x times or targets x times large.

    Splines of degree 2 and 3 go through all samples, without a knot next to the ends (3) or with knots between the
    samples (2). Beyond the ends: extrapolate (neighbours: the nearest sample where there is one on that side), nan, a
    number, or one for each side.
    """

    def __init__(self, times: np.ndarray, targets: np.ndarray, method: str = "linear", fill: float | tuple[float, float] | str = "extrapolate") -> None:
        t, x = np.asarray(times, float), np.asarray(targets, float)
        n, kinds = len(t), {"linear": 1, "slinear": 1, "quadratic": 2, "cubic": 3}
        self.system, self.rest = None, np.zeros(len(x))
        if method in kinds:
            k = kinds[method]
            if n <= k:
                raise ValueError(f"{method} needs {k + 1} times or more")
            inner = t if k % 2 else (t[1:] + t[:-1]) / 2
            cut = (k + 1) // 2
            knots = np.concatenate([np.full(k + 1, t[0]), inner[cut : len(inner) - cut], np.full(k + 1, t[-1])])
            self.system = Banded(*spline_basis(knots, k, t)) if k > 1 else None
            self.first, self.weights = spline_basis(knots, k, x)
        else:
            after = np.searchsorted(t, x, "left")
            before = np.searchsorted(t, x, "right") - 1
            low, high = np.maximum(before, 0), np.minimum(after, n - 1)
            near, up = (np.where((x - t[low] <= t[high] - x) if tie else (x - t[low] < t[high] - x), low, high) for tie in (True, False))
            outside = (x < t[0]) | (x > t[-1])
            end = np.where(x < t[0], 0, n - 1)
            found = {"previous": before, "zero": before, "next": np.where(after < n, after, -1), "nearest": np.where(outside, end, near), "nearest-up": np.where(outside, end, up)}
            if method not in found:
                raise ValueError(f"unknown method {method!r}")
            at = found[method]
            self.first, self.weights = np.maximum(at, 0), (at >= 0).astype(float)[:, None]
            self.rest[at < 0] = np.nan
        if fill != "extrapolate":
            left, right = fill if isinstance(fill, tuple) else (np.nan, np.nan) if fill == "nan" else (fill, fill)
            for side, value in ((x < t[0], left), (x > t[-1], right)):
                self.weights[side], self.rest[side] = 0, value

    def __call__(self, y: np.ndarray) -> np.ndarray:
        """Each row at the targets."""
        c = self.system.solve(y) if self.system else y
        out = np.tile(self.rest, (len(y), 1))
        for j in range(self.weights.shape[1]):
            used = self.weights[:, j] != 0
            out[:, used] += c[:, self.first[used] + j] * self.weights[used, j]
        return out


def resample_weights(times: np.ndarray, targets: np.ndarray, method: str = "linear", fill: float | tuple[float, float] | str = "extrapolate") -> tuple[np.ndarray, np.ndarray]:
    """targets x times, and a constant for each target: the same as whole matrices, for short series."""
    r = Resampler(times, targets, method, fill)
    rest, r.rest = r.rest, np.zeros(len(r.rest))
    return r(np.eye(len(times))).T, rest


def resample_series(series: DataFrame, times: np.ndarray, targets: np.ndarray, method: str = "linear", fill: float | tuple[float, float] | str = "extrapolate") -> DataFrame:
    """Series whose times all voxels share at other times: a few weights for each target, sent to the tasks."""
    return map_series(series, Resampler(times, targets, method, fill))


def uniform_times(samples: DataFrame, start: float | None = None, stop: float | None = None, step: float | None = None, time: str = "time") -> DataFrame:
    """time: start + k step up to stop; by default from the first to the last sample with the median step."""
    times = samples.select(F.col(time).cast("double").alias(time)).distinct()
    steps = times.withColumn("d", F.col(time) - F.lag(time).over(Window.orderBy(time)))  # one row for each time
    lo, hi, typical = steps.agg(F.min(time), F.max(time), F.median("d")).first()
    start, stop, step = (x if x is not None else y for x, y in ((start, lo), (stop, hi), (step, typical)))
    n = int(np.floor((stop - start) / step + 1e-12)) + 1
    return samples.sparkSession.range(n).select((F.lit(float(start)) + F.col("id") * F.lit(float(step))).alias(time))


def representative_step(coords: DataFrame, coord: str = "coord", tolerance: float = 0.01) -> DataFrame:
    """One row: the median step, and whether any step is further from it than the tolerance allows."""
    steps = coords.select((F.col(coord) - F.lag(coord).over(Window.orderBy(coord))).alias("d")).filter("d IS NOT NULL")
    typical = steps.agg(F.median("d").alias("step"))
    return steps.crossJoin(F.broadcast(typical)).groupBy("step").agg(F.max((F.abs(F.col("d") - F.col("step")) > tolerance * F.abs("step"))).alias("non_uniform"))


def correct_slice_timings(samples: DataFrame, slice_time: str = "slice_time", time: str = "time", value: str = VALUE) -> DataFrame:
    """Each voxel's samples, taken at its slice's own times, at the volumes' times."""
    own = samples.select(VOXEL, F.col(slice_time).alias(time), value)
    return resample_time(own, samples.select(time), "linear", True, value, time)


# Confounds and filters: a shared matrix along time for all voxels.


def cosine_drift(n: int, low_cutoff: float, interval: float) -> np.ndarray:
    """n x (order + 1): cosine columns up to the cutoff, the constant last."""
    order = min(int(np.floor(2 * n * low_cutoff * interval)), n - 1)
    t = np.arange(n)[:, None] + 0.5
    return np.hstack([np.sqrt(2 / n) * np.cos(np.pi / n * t * np.arange(1, order + 1)), np.ones((n, 1))])


def cosine_drift_rows(spark, n: int, low_cutoff: float, interval: float) -> DataFrame:
    """t_idx, k, value of the same columns, as rows; k = 0 is the constant."""
    order = min(int(np.floor(2 * n * low_cutoff * interval)), n - 1)
    rows = spark.range(n).select(F.col("id").alias(TIME), F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
    wave = F.lit(float(np.sqrt(2 / n))) * F.cos(F.lit(float(np.pi / n)) * (F.col(TIME) + 0.5) * F.col("k"))
    return rows.withColumn(VALUE, F.when(F.col("k") == 0, 1.0).otherwise(wave))


def confound_factor(confounds: np.ndarray, standardize_: bool = True) -> np.ndarray:
    """times x rank: an orthonormal basis of the confounds."""
    c = np.array(confounds, float).reshape(len(confounds), -1)
    if standardize_:
        c = c - c.mean(0)  # a constant becomes 0 and takes nothing off
        sd = c.std(0, ddof=1)
        c = c / np.where(sd > EPSILON, sd, 1)
    else:
        top = np.abs(c).max(0)
        c = c / np.where(top > 0, top, 1)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    return u[:, s > s[0] * 100 * EPSILON] if len(s) and s[0] > 0 else u[:, :0]


def residual_matrix(confounds: np.ndarray, standardize_: bool = True) -> np.ndarray:
    """time x time: what is left of a series after projection on the confounds, as a whole matrix, for short series."""
    q = confound_factor(confounds, standardize_)
    return np.eye(len(q)) - q @ q.T


def regress_confounds(series: DataFrame, confounds: np.ndarray, standardize_confounds: bool = True) -> DataFrame:
    q = confound_factor(confounds, standardize_confounds)
    return map_series(series, lambda x: without(x, q))


def filter_cosine(series: DataFrame, n: int, low_cutoff: float, interval: float) -> DataFrame:
    q = confound_factor(cosine_drift(n, low_cutoff, interval), False)
    return map_series(series, lambda x: without(x, q))


def filter_butterworth(series: DataFrame, rate: float, low_cutoff: float | None = None, high_cutoff: float | None = None, order: int = 5) -> DataFrame:
    """Zero-phase Butterworth filter: high-pass above low_cutoff, low-pass below high_cutoff, or a band."""
    if low_cutoff is None and high_cutoff is None:
        return series
    sections = filters.butterworth(order, rate, low_cutoff, high_cutoff)
    return map_series(series, lambda x: filters.forward_backward(sections, x))


def regress_one(samples: DataFrame, confound: DataFrame, value: str = VALUE, time: str = TIME) -> DataFrame:
    """Residual of each voxel on one confound (t_idx, c) with its mean taken off; the voxel keeps its own mean."""
    c = confound.select(time, (F.col("c") - F.avg("c").over(Window.partitionBy(F.lit(1)))).alias("c"))  # one row for each time
    both = samples.join(F.broadcast(c), time)
    w = whole()
    beta = F.sum(F.col(value) * F.col("c")).over(w) / F.sum(F.col("c") * F.col("c")).over(w)
    return both.withColumn(value, F.col(value) - F.coalesce(beta, F.lit(0.0)) * F.col("c")).drop("c")


def compcor_voxels(samples: DataFrame, fraction: float, value: str = VALUE) -> DataFrame:
    """voxel_id, variance of the voxels whose variance is at the (1 - fraction) quantile or above, zero left out."""
    spread = checkpointed(samples.groupBy(VOXEL).agg(F.var_samp(value).alias("variance")).filter("variance > 0"))
    return spread.filter(F.col("variance") >= F.lit(exact_quantile(spread, "variance", 1 - fraction)))


def compcor_confounds(series: DataFrame, n_components: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """First left singular vectors in time of the z-scored noise voxels, and the share of variance of each."""

    def zscored(x: np.ndarray) -> np.ndarray:
        sd = x.std(1, ddof=1, keepdims=True)
        return np.where(sd > 0, (x - x.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1), 0)

    values, vectors, total = time_components(map_series(series, zscored), n_components)
    return vectors, values / max(total, EPSILON)


def finite(x: np.ndarray, what: str = "series") -> np.ndarray:
    """Rows whose non-finite samples lie on the line between their finite neighbours, at the ends on the nearest one."""
    x, t = np.array(x, float), np.arange(x.shape[1])
    for row in x:
        ok = np.isfinite(row)
        if not ok.any():
            raise ValueError(f"{what}: one has no finite value along time")
        if not ok.all():
            row[~ok] = np.interp(t[~ok], t[ok], row[ok])
    return x


def filled(x: np.ndarray, keep: np.ndarray, times: np.ndarray, method: str = "linear", fill: float | tuple[float, float] | str = "nan") -> np.ndarray:
    """Rows whose censored samples come from the kept ones; where these give none at an end, from the nearest kept one."""
    x = np.array(x, float)
    x[:, ~keep] = Resampler(times[keep], times[~keep], method, fill)(x[:, keep])
    ends = np.flatnonzero(keep)[[0, -1]]
    for side, end in ((slice(0, ends[0]), ends[0]), (slice(ends[1] + 1, None), ends[1])):
        x[:, side] = np.where(np.isfinite(x[:, side]), x[:, side], x[:, [end]])
    return x


def clean(
    series: DataFrame,
    n: int,
    *,
    interval: float = 1.0,
    detrend_order: int | None = None,
    standardize_method: str | None = None,
    low_cutoff: float | None = None,
    high_cutoff: float | None = None,
    filter_method: str = "butterworth",
    order: int = 5,
    confounds: np.ndarray | None = None,
    standardize_confounds: bool = True,
    sample_mask: np.ndarray | None = None,
    ensure_finite: bool = False,
    interpolate_method: str = "linear",
    interpolate_fill: float | tuple[float, float] | str = "nan",
) -> DataFrame:
    """In this order: repair of non-finite samples (ensure_finite), interpolation of censored ones, detrending, Butterworth
    filter, censoring, regression of confounds, standardisation. Confounds take the same steps before they are regressed.

    Censored samples are interpolated only where detrending or a Butterworth filter needs even times. A cosine filter is
    part of the regression: its drifts join the confounds, all as they are, after censoring. For psc, signals that lost
    their mean (over all of them, less than a tenth of it is left) get it back. Without ensure_finite, what isn't finite
    spreads as far as the steps carry it.
    """
    if filter_method not in ("butterworth", "cosine"):
        raise ValueError(f"unknown filter {filter_method!r}; known: butterworth, cosine")
    cosine = filter_method == "cosine"
    if cosine and high_cutoff is not None:
        raise ValueError("a cosine filter has a low cutoff only")
    if standardize_method not in (None, "zscore", "psc"):
        raise ValueError(f"unknown method {standardize_method!r}; known: zscore, psc")
    keep = np.ones(n, bool) if sample_mask is None else np.asarray(sample_mask, bool)
    if not keep.any():
        raise ValueError("the sample mask drops every time")
    sections = None if cosine or (low_cutoff is None and high_cutoff is None) else filters.butterworth(order, 1 / interval, low_cutoff, high_cutoff)
    trend = None if detrend_order is None else polynomial_factor(n, detrend_order)
    times = np.arange(n) * interval

    def prepared(x: np.ndarray, what: str) -> tuple[np.ndarray, np.ndarray]:
        """Rows up to censoring, and their means before."""
        x = finite(x, what) if ensure_finite else np.array(x, float)
        mean = x.mean(1, keepdims=True)
        if not keep.all() and (trend is not None or sections is not None):
            x = filled(x, keep, times, interpolate_method, interpolate_fill)
        x = x if trend is None else without(x, trend)
        x = x if sections is None else filters.forward_backward(sections, x)
        return x[:, keep], mean

    basis = None
    columns = None if confounds is None else prepared(np.asarray(confounds, float).reshape(n, -1).T, "confounds")[0].T
    if cosine and low_cutoff is not None:
        drift = cosine_drift(n, low_cutoff, interval)[keep]
        columns = drift if columns is None else np.hstack([columns, drift])
    if columns is not None:
        basis = confound_factor(columns, standardize_confounds and not cosine)

    def regressed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, mean = prepared(x, "signals")
        return (x if basis is None else without(x, basis)), mean

    def scaled(x: np.ndarray, method: str) -> np.ndarray:
        mean = x.mean(1, keepdims=True)
        scale = x.std(1, ddof=1, keepdims=True) if method == "zscore" else np.abs(mean)
        return np.where(scale < EPSILON, np.nan, (x - mean) / np.where(scale < EPSILON, 1, scale) * (1 if method == "zscore" else 100))

    if standardize_method != "psc":
        return map_series(series, lambda x: regressed(x)[0] if standardize_method is None else scaled(regressed(x)[0], "zscore"), SERIES)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, mean = regressed(matrix_of(batch.column(0)))
                after, before = (np.abs(v) for v in (x.mean(1), mean[:, 0]))
                yield pa.RecordBatch.from_arrays([pa.array([float(np.nansum(after))]), pa.array([int(np.isfinite(after).sum())]), pa.array([float(np.nansum(before))]), pa.array([int(np.isfinite(before).sum())])], names=["a", "na", "b", "nb"])

    a, na, b, nb = (v or 0 for v in series.select(SERIES).mapInArrow(sizes, "a double, na long, b double, nb long").agg(*[F.sum(c) for c in ("a", "na", "b", "nb")]).first())
    lost = bool(na and nb and b) and (a / na) / (b / nb) < 0.1

    def percent(x: np.ndarray) -> np.ndarray:
        x, mean = regressed(x)
        return scaled(x + mean if lost else x, "psc")

    return map_series(series, percent, SERIES)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


def smooth_axis(samples: DataFrame, axis: str, size: int, fwhm: float, spacing: float = 1.0, keys: tuple[str, ...] = (TIME,), value: str = VALUE) -> DataFrame:
    """Gaussian smoothing along one index axis of `size`, edges mirrored, by a join with the few weights of the kernel."""
    weights = gaussian_weights(fwhm / (2 * np.sqrt(2 * np.log(2))) / spacing)
    radius = len(weights) // 2
    spark = samples.sparkSession
    kernel = spark.createDataFrame([(k - radius, float(w)) for k, w in enumerate(weights)], "step int, w double")
    spread = spark.range(size).withColumnRenamed("id", "to").crossJoin(F.broadcast(kernel)).withColumn("m", F.pmod(F.col("to") + F.col("step"), F.lit(2 * size)))
    spread = spread.withColumn(axis, F.when(F.col("m") < size, F.col("m")).otherwise(2 * size - 1 - F.col("m"))).groupBy("to", axis).agg(F.sum("w").alias("w"))
    out = samples.join(F.broadcast(spread), axis).groupBy(*keys, "to").agg(F.sum(F.col(value) * F.col("w")).alias(value))
    return out.withColumnRenamed("to", axis)


def smooth_volume(samples: DataFrame, shape: tuple[int, int, int], fwhm: float | tuple[float, float, float], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), ensure_finite: bool = False, keys: tuple[str, ...] = (TIME,), value: str = VALUE) -> DataFrame:
    """Gaussian smoothing along z, y and x, one axis after the other, edges mirrored; a width of 0 leaves an axis as it is.

    With ensure_finite what isn't finite counts as 0; without it, it spreads.
    """
    dims = ("z_idx", "y_idx", "x_idx")
    out = samples.select(*keys, *dims, F.col(value).cast("double").alias(value))
    if ensure_finite:
        x = F.col(value)
        out = out.withColumn(value, F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    for d, n, width, step in zip(dims, shape, (fwhm,) * 3 if np.ndim(fwhm) == 0 else fwhm, spacing, strict=True):
        if width:
            out = smooth_axis(out, d, n, width, step, (*keys, *(x for x in dims if x != d)), value)
    return out


def rolling_mean(samples: DataFrame, before: int, after: int, least: int = 1, keys: tuple[str, ...] = (VOXEL,), time: str = TIME, value: str = VALUE) -> DataFrame:
    """Mean over a frame of rows; null where it has fewer than `least` of them."""
    w = over_time(keys, time).rowsBetween(-before, after)
    return samples.withColumn(value, F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def first_difference(samples: DataFrame, keys: tuple[str, ...] = (VOXEL,), time: str = TIME, value: str = VALUE) -> DataFrame:
    return samples.withColumn(value, F.col(value) - F.lag(value).over(over_time(keys, time)))
