"""The order of cleaning, step by step in numpy, and projections without a times x times matrix."""

import numpy as np
import pytest

from voxelweave.functions import filters
from voxelweave.operators import layout, series

N, RATE = 120, 10.0
RNG = np.random.default_rng(0)
X = RNG.normal(size=(4, N)).cumsum(1) + 100
MASK = np.ones(N, bool)
MASK[[0, 10, 11, 60, N - 1]] = False
C = np.column_stack([np.sin(np.arange(N) / 7), RNG.normal(size=N)])


def cleaned(spark, x, **how):
    df = spark.createDataFrame([(v, [float(y) for y in row]) for v, row in enumerate(x)], "voxel_id long, series array<double>")
    out = series.clean(df, x.shape[1], interval=1 / RATE, **how)
    return np.array([r.series for r in out.orderBy("voxel_id").collect()], float)


def left(x, c, standardize):
    """Least squares of the signals on the confounds alone, as they are or standardised."""
    c = (c - c.mean(0)) / c.std(0, ddof=1) if standardize else c
    return x - (c @ np.linalg.lstsq(c, x.T, rcond=None)[0]).T


def low_pass(x, high=2.0):
    return filters.forward_backward(filters.butterworth(5, RATE, None, high), x)


def line(x, keep):
    t = np.arange(x.shape[1])
    return np.array([np.where(keep, row, np.interp(t, t[keep], row[keep])) for row in x])


def test_nothing_to_do_leaves_everything(spark):
    x = X.copy()
    x[0, 0], x[1, 1] = np.nan, np.inf
    got = cleaned(spark, x)
    assert np.isnan(got[0, 0]) and np.isinf(got[1, 1]) and np.array_equal(got[2:], X[2:])


def test_censored_at_once_without_filter(spark):
    x = X.copy()
    x[:, ~MASK] = np.nan  # never looked at
    assert np.array_equal(cleaned(spark, x, sample_mask=MASK), X[:, MASK])
    assert np.allclose(cleaned(spark, x, sample_mask=MASK, confounds=C), left(X[:, MASK], C[MASK], True))


def test_censored_samples_are_interpolated_for_a_filter(spark):
    x = X.copy()
    x[:, ~MASK] = 1e6
    assert np.allclose(cleaned(spark, x, sample_mask=MASK, high_cutoff=2.0), low_pass(line(X, MASK))[:, MASK])
    q = series.polynomial_factor(N, 1)
    filled = line(X, MASK)
    assert np.allclose(cleaned(spark, x, sample_mask=MASK, detrend_order=1), (filled - filled @ q @ q.T)[:, MASK])


def test_other_interpolation(spark):
    near = X.copy()
    near[:, [10, 11, 60]] = X[:, [9, 12, 59]]
    near[:, [0, -1]] = X[:, [1, -2]]
    assert np.allclose(cleaned(spark, X, sample_mask=MASK, high_cutoff=2.0, interpolate_method="nearest"), low_pass(near)[:, MASK])
    on = line(X, MASK)
    on[:, 0], on[:, -1] = 2 * X[:, 1] - X[:, 2], 2 * X[:, -2] - X[:, -3]
    assert np.allclose(cleaned(spark, X, sample_mask=MASK, high_cutoff=2.0, interpolate_fill="extrapolate"), low_pass(on)[:, MASK])


def test_what_is_not_finite_spreads_unless_repaired(spark):
    x = X.copy()
    x[0, 50] = np.nan
    got = cleaned(spark, x, sample_mask=MASK, high_cutoff=2.0)
    assert not np.isfinite(got[0]).any() and np.isfinite(got[1:]).all()
    x[1, 1], x[2, -1] = np.inf, np.nan
    fixed, c = X.copy(), C.copy()
    fixed[0, 50], fixed[1, 1], fixed[2, -1] = X[0, [49, 51]].mean(), X[1, [0, 2]].mean(), X[2, -2]
    c[0, 0], c[-1, 1] = np.nan, np.inf
    c_fixed = C.copy()
    c_fixed[0, 0], c_fixed[-1, 1] = C[1, 0], C[-2, 1]
    how = dict(detrend_order=1, high_cutoff=2.0, standardize_method="zscore")
    assert np.allclose(cleaned(spark, x, confounds=c, ensure_finite=True, **how), cleaned(spark, fixed, confounds=c_fixed, **how))


def test_a_series_without_finite_samples(spark):
    x = X.copy()
    x[2] = np.nan
    with pytest.raises(Exception, match="no finite value"):
        cleaned(spark, x, ensure_finite=True)
    assert np.isnan(cleaned(spark, x)[2]).all()


def test_percent_gets_the_mean_back_by_one_rule_for_all(spark):
    filtered = filters.forward_backward(filters.butterworth(5, RATE, 1.0, None), X)
    mean = X.mean(1, keepdims=True)
    want = 100 * (filtered + mean - (filtered + mean).mean(1, keepdims=True)) / np.abs((filtered + mean).mean(1, keepdims=True))
    assert np.allclose(cleaned(spark, X, low_cutoff=1.0, standardize_method="psc"), want)
    plain = 100 * (X - mean) / np.abs(mean)
    assert np.allclose(cleaned(spark, X, standardize_method="psc"), plain)
    # one voxel lost its mean by itself, but over all of them most of it is there: nothing is given back
    mixed = X.copy()
    mixed[0] -= X[0].mean() - 1e-3
    got = cleaned(spark, mixed, standardize_method="psc", high_cutoff=2.0)
    y = low_pass(mixed)
    m = y.mean(1, keepdims=True)
    assert np.allclose(got, 100 * (y - m) / np.abs(m))


def test_cosine_drifts_are_regressed_with_the_confounds_as_they_are(spark):
    drift = series.cosine_drift(N, 0.2, 1 / RATE)
    assert drift.shape[1] > 2
    how = dict(low_cutoff=0.2, filter_method="cosine")
    assert np.allclose(cleaned(spark, X, **how), left(X, drift, False))
    both = np.hstack([C, drift])
    assert np.allclose(cleaned(spark, X, confounds=C, **how), left(X, both, False))
    assert np.allclose(cleaned(spark, X, confounds=C[:, 0], **how), left(X, np.hstack([C[:, :1], drift]), False))
    x = X.copy()
    x[:, ~MASK] = 1e6  # censored first, without interpolation
    assert np.allclose(cleaned(spark, x, confounds=C, sample_mask=MASK, **how), left(X[:, MASK], both[MASK], False))


def test_confounds_take_the_same_steps(spark):
    got = cleaned(spark, X, confounds=C, high_cutoff=2.0, detrend_order=1)
    q = series.polynomial_factor(N, 1)
    steps = lambda v: low_pass(v - v @ q @ q.T)
    assert np.allclose(got, left(steps(X), steps(C.T).T, True))
    assert np.allclose(cleaned(spark, X, confounds=C, standardize_confounds=False), left(X, C, False))


def test_refused(spark):
    for how, says in (({"filter_method": "box"}, "unknown filter"), ({"filter_method": "cosine", "high_cutoff": 1.0}, "low cutoff only"), ({"standardize_method": "x"}, "unknown method"), ({"sample_mask": np.zeros(N, bool)}, "every time")):
        with pytest.raises(ValueError, match=says):
            cleaned(spark, X, **how)


def test_long_series_need_no_square_matrix():
    n = 200_000
    t = np.linspace(0, 1, n)
    q = series.polynomial_factor(n, 2)
    y = np.stack([3 + 2 * t - t**2, np.sin(40 * t)])
    assert np.abs(series.without(y, q)[0]).max() < 1e-8
    drift = series.confound_factor(series.cosine_drift(n, 5 / n, 1.0), False)
    assert drift.shape == (n, 11) and np.abs(series.without(drift.T.copy(), drift)).max() < 1e-10


def test_cubic_of_a_long_series():
    n = 30_000
    t = np.arange(n, dtype=float) + 0.3 * np.sin(np.arange(n))
    x = np.linspace(-0.2, n - 0.5, 50_001)
    at = series.Resampler(t, x, "cubic")
    assert at.weights.shape == (50_001, 4) and at.system.band.shape[1] <= 9
    s = t / n
    got = at(np.stack([s**3 - s, np.sin(t / 50)]))
    u = x / n
    assert np.allclose(got[0], u**3 - u, atol=1e-9) and np.abs(got[1] - np.sin(x / 50)).max() < 1e-5


def test_banded_systems():
    rng = np.random.default_rng(1)
    knots = np.concatenate([[0] * 4, np.sort(rng.uniform(0, 9, 20)), [9] * 4])
    where = np.sort(rng.uniform(0, 9, 24))
    where = (knots[1:25] + knots[2:26] + knots[3:27]) / 3  # one place for each spline
    first, values = series.spline_basis(knots, 3, where)
    dense = np.zeros((24, 24))
    for i in range(24):
        dense[i, first[i] : first[i] + 4] = values[i]
    y = rng.normal(size=(3, 24))
    assert np.allclose(series.Banded(first, values).solve(y), np.linalg.solve(dense, y.T).T)


def test_no_module_defines_a_name_twice():
    import ast
    import pathlib

    for path in pathlib.Path(layout.__file__).parent.parent.rglob("*.py"):
        names = [n.name for n in ast.parse(path.read_text()).body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        assert len(names) == len(set(names)), path
