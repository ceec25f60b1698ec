"""Resampling of all kinds and smoothing of volumes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import layout, series

T = np.array([0.0, 1.0, 2.5, 3.0, 4.5, 6.0])


def test_splines_keep_polynomials_and_go_through_samples():
    x = np.array([-0.5, 0.0, 0.3, 1.0, 2.6, 5.9, 6.0, 7.0])
    for method, degree in (("linear", 1), ("slinear", 1), ("quadratic", 2), ("cubic", 3)):
        w, rest = series.resample_weights(T, x, method)
        for k in range(degree + 1):
            assert np.allclose(w @ T**k + rest, x**k)
        again, _ = series.resample_weights(T, T, method)
        assert np.allclose(again, np.eye(len(T)))
        # pieces meet with equal slopes (and curvature) at the knots between the ends
        knots = {1: [], 2: [0.5 * (T[k] + T[k + 1]) for k in range(1, 4)], 3: T[2:4]}[degree]
        y, h = np.random.default_rng(0).standard_normal(len(T)), 1e-4
        f = lambda v: series.resample_weights(T, np.atleast_1d(v), method)[0] @ y  # noqa: E731, B023
        for v in knots:
            left, right = (f(v) - f(v - h)) / h, (f(v + h) - f(v)) / h
            assert np.allclose(left, right, atol=2e-2)
    with pytest.raises(ValueError):
        series.resample_weights(T[:3], T, "cubic")


def test_cubic_of_five_points_by_hand():
    """Without a knot next to the ends, five points have one knot: two cubics that share value, slope, curvature at 2."""
    t, y = np.arange(5.0), np.array([0.0, 1, 0, 1, 0])
    rows, right = [], []
    row = lambda v, side: [*(v**k if side == 0 else 0 for k in range(4)), *(v**k if side else 0 for k in range(4))]
    for v, z in zip(t, y, strict=True):
        rows.append(row(v, int(v > 2)))
        right.append(z)
    for d in range(3):
        dv = lambda k, d=d: np.prod([k - j for j in range(d)]) * 2.0 ** (k - d) if k >= d else 0
        rows.append([*(dv(k) for k in range(4)), *(-dv(k) for k in range(4))])
        right.append(0)
    c = np.linalg.solve(np.array(rows, float), np.array(right, float))
    x = np.array([0.5, 1.7, 2.3, 3.9])
    want = [sum(c[(4 if v > 2 else 0) + k] * v**k for k in range(4)) for v in x]
    assert np.allclose(series.resample_weights(t, x, "cubic")[0] @ y, want)


def test_neighbours_and_fills(spark):
    y = T * 10
    x = np.array([-1.0, 0.5, 1.0, 2.75, 6.0, 7.0])
    at = lambda method, **o: (lambda w, rest: w @ y + rest)(*series.resample_weights(T, x, method, **o))
    assert np.allclose(at("nearest"), [0, 0, 10, 25, 60, 60]) and np.allclose(at("nearest-up"), [0, 10, 10, 30, 60, 60])
    assert np.allclose(at("previous"), [np.nan, 0, 10, 25, 60, 60], equal_nan=True) and np.allclose(at("zero"), at("previous"), equal_nan=True)
    assert np.allclose(at("next"), [0, 10, 10, 30, 60, np.nan], equal_nan=True)
    assert np.allclose(at("linear", fill="nan"), [np.nan, 5, 10, 27.5, 60, np.nan], equal_nan=True)
    assert np.allclose(at("cubic", fill=(-1.0, 9.0))[[0, -1]], [-1, 9]) and np.allclose(at("linear", fill=0.0)[[0, -1]], 0)
    s = spark.createDataFrame([(v, (y + v).tolist()) for v in range(3)], "voxel_id long, series array<double>")
    got = {r.voxel_id: r.series for r in series.resample_series(s, T, x, "quadratic").collect()}
    assert np.allclose(got[2], x * 10 + 2)
    long = layout.to_long(s).join(spark.createDataFrame(list(enumerate(T.tolist())), "t_idx int, time double"), "t_idx")
    want = spark.createDataFrame([(float(v),) for v in x], "time double")
    for method in ("nearest-up", "zero"):
        found = series.resample_time(long, want, method).filter("voxel_id = 0").orderBy("time").toPandas()["value"].to_numpy(float)
        assert np.allclose(found, at(method), equal_nan=True)
    with pytest.raises(ValueError, match="series"):
        series.resample_time(long, want, "cubic")


def test_smoothing_of_volumes(spark):
    shape, spacing, fwhm = (3, 5, 6), (1.0, 0.5, 0.25), (0.0, 1.0, 0.5)
    v = np.random.default_rng(1).standard_normal(shape)
    v[1, 2, 3] = np.inf
    cells = [(0, *map(int, c), float(v[c])) for c in np.ndindex(shape)]
    s = spark.createDataFrame(pd.DataFrame(cells, columns=["t_idx", "z_idx", "y_idx", "x_idx", "value"]))
    out = np.where(np.isfinite(v), v, 0)
    for axis in (1, 2):
        w = series.gaussian_weights(fwhm[axis] / (2 * np.sqrt(2 * np.log(2))) / spacing[axis])
        r = len(w) // 2
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(3)], mode="symmetric")
        out = sum(w[k] * np.take(wide, range(k, k + shape[axis]), axis) for k in range(len(w)))
    p = series.smooth_volume(s, shape, fwhm, spacing, ensure_finite=True).toPandas()
    got = np.zeros(shape)
    got[p.z_idx, p.y_idx, p.x_idx] = p.value
    assert len(p) == v.size and np.allclose(got, out)
    assert not np.isfinite(series.smooth_volume(s, shape, fwhm, spacing).agg(F.max("value")).first()[0])
