"""Kernels against closed forms and brute force; no Spark."""

import math

import numpy as np
import pytest

from voxelweave.functions import affine, filters, hrf, tails
from voxelweave.operators import decompose, glm, series, spatial, thresholds, windows


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_gain(order):
    def gain(s, f, rate):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z) for b0, b1, b2, a0, a1, a2 in s]))

    low, high, band = (filters.butterworth(order, 100.0, *c) for c in ((None, 10.0), (10.0, None), (5.0, 20.0)))
    assert gain(low, 10, 100) == pytest.approx(math.sqrt(0.5)) and gain(low, 0.001, 100) == pytest.approx(1, abs=1e-6)
    assert gain(high, 10, 100) == pytest.approx(math.sqrt(0.5)) and gain(high, 49.99, 100) == pytest.approx(1, abs=1e-5)
    assert gain(band, 5, 100) == pytest.approx(math.sqrt(0.5)) and gain(band, 20, 100) == pytest.approx(math.sqrt(0.5))


def test_zero_phase_filter_keeps_slow_waves_and_drops_fast_ones():
    t = np.arange(1000) / 100
    slow, fast = np.sin(2 * np.pi * t), np.sin(2 * np.pi * 30 * t)
    out = filters.forward_backward(filters.butterworth(5, 100.0, None, 10.0), slow + fast)
    assert np.abs(out - slow)[100:-100].max() < 1e-3
    with pytest.raises(ValueError):
        filters.forward_backward(filters.butterworth(5, 100.0, None, 10.0), np.ones(5))
    with pytest.raises(ValueError):
        filters.butterworth(2, 100.0, None, 60.0)


def test_tails():
    assert tails.t_sf(2.228138852, 10) == pytest.approx(0.025, abs=1e-9)
    assert tails.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-9)
    for z in (-8.0, -1.0, 0.0, 0.5, 3.0, 20.0):
        assert tails.normal_isf(tails.normal_sf(z)) == pytest.approx(z, abs=1e-6) or z < -5
    assert tails.t_sf(50.0, 30) > 0 and tails.normal_isf(1e-300) == pytest.approx(37.04709, abs=1e-4)
    assert math.isnan(tails.t_sf(float("nan"), 3))


def test_kernels_sum_to_one():
    for name in hrf.RESPONSES:
        assert hrf.kernels(name, 0.5)[0].sum() == pytest.approx(1)
    assert len(hrf.kernels("fir", 1.0, 10, [0, 1, 2])) == 3
    with pytest.raises(ValueError):
        hrf.kernels("other", 1.0)


def test_affines_come_apart_and_together():
    r = affine.rotation(0.1, -0.2, 0.3)
    a = affine.compose([1, 2, 3], r, [2, 0.5, 1.5], [0.1, 0.2, -0.1])
    t, q, z, s = affine.decompose(a)
    assert np.allclose(affine.compose(t, q, z, s), a) and np.allclose(affine.motion_parameters(affine.compose([1, 2, 3], r, [1, 1, 1])), [0.1, -0.2, 0.3, 1, 2, 3])
    assert affine.motion_parameters(affine.compose([0] * 3, affine.rotation(0.2, np.pi / 2, 0), [1] * 3))[5] == 0
    with pytest.raises(ValueError):
        affine.decompose(np.diag([-1.0, 1, 1, 1]))


def test_hommel_is_closed_testing():
    from itertools import combinations

    p = np.random.default_rng(3).uniform(size=6) ** 2
    simes = lambda s: min(len(s) * x / (k + 1) for k, x in enumerate(sorted(s)))
    want = [max(simes([p[j] for j in c]) for k in range(1, 7) for c in combinations(range(6), k) if i in c) for i in range(6)]
    assert np.allclose(thresholds.hommel(p), np.minimum(want, 1))


def test_clutter_filters():
    rng = np.random.default_rng(0)
    block = rng.standard_normal((20, 30)) + 1j * rng.standard_normal((20, 30))
    assert np.allclose(windows.svd_from_indices(block), block)
    u, s, v = np.linalg.svd(block, full_matrices=False)
    assert np.allclose(windows.svd_from_indices(block, low=2, high=10), (u[:, 2:10] * s[2:10]) @ v[2:10])
    assert np.allclose(windows.svd_from_energy(block, low=s[4] ** 2 * 1.0001), (u[:, :4] * s[:4]) @ v[:4])
    assert np.allclose(windows.svd_from_cumulative_energy(block, high=(s[3:] ** 2).sum() * 1.0001), (u[:, 3:] * s[3:]) @ v[3:])
    assert windows.butterworth_block(block, 100.0) is block


def test_contrasts_and_designs():
    assert np.allclose(glm.contrast_vector("a - 2 * b", ["a", "b", "c"]), [1, -2, 0])
    assert np.allclose(glm.contrast_vector([1.0], ["a", "b"]), [1, 0])
    for bad in ("a +", "d", "__import__('os')"):
        with pytest.raises((ValueError, SyntaxError)):
            glm.contrast_vector(bad, ["a", "b"])
    import pandas as pd

    e = pd.DataFrame({"onset": [0.0, 20, 40], "duration": [2.0] * 3, "trial_type": ["A", "B", "A"], "modulation": [1.0] * 3})
    d = glm.first_level_design(np.arange(100) * 0.5, e)
    assert list(d.columns)[:2] == ["A", "B"] and d.columns[-1] == "constant" and d["A"].to_numpy()[:15].max() > 0
    q = glm.orthogonalize(np.random.default_rng(0).standard_normal((20, 3)))
    assert abs(q[:, 0] @ q[:, 1]) < 1e-9 and abs(q[:, 1] @ q[:, 2]) < 1e-9


def test_matrices():
    rng = np.random.default_rng(1)
    m = np.array([x @ x.T + np.eye(4) for x in rng.standard_normal((5, 4, 6))])
    g = decompose.geometric_mean(m)
    back = decompose.power(g, -0.5)
    assert np.abs(np.mean([decompose._function(back @ x @ back, np.log) for x in m], 0)).max() < 1e-5
    for diagonal in (False, True):
        v = decompose.to_vector(m[0], diagonal)
        assert np.allclose(decompose.to_matrix(v, np.diag(m[0]) if diagonal else None), m[0])
    c = decompose.shrunk_covariance(rng.standard_normal((30, 5)))
    assert np.linalg.eigvalsh(c).min() > 0


def test_registration_finds_a_shift():
    fixed = np.zeros((1, 24, 24))
    fixed[0, 8:14, 6:13] = 100
    a, found = spatial.register(np.roll(fixed, (2, -1), (1, 2)), fixed)
    assert np.allclose(a[:3, 3], [0, 2, -1], atol=0.05) and found["metric"] > 0.99


def test_fields_invert():
    z, y, x = np.meshgrid(*[np.arange(8.0)] * 3, indexing="ij")
    field = np.stack([0.2 * np.sin(y / 3), 0.3 * np.cos(x / 4), 0.1 * np.sin(z / 2)])
    p = spatial.grid_points((4, 4, 4), (1, 1, 1), (2, 2, 2))
    there = spatial.displaced(p, field, (1, 1, 1), (0, 0, 0))
    assert np.abs(spatial.invert_at_points(there, field, (1, 1, 1), (0, 0, 0)) - p).max() < 1e-4
    flat = spatial.bspline_field(np.ones((3, 6, 6, 6)), (4, 4, 4), (1, 1, 1), (2, 2, 2), (2, 2, 2), (-2, -2, -2))
    assert np.allclose(flat, 1)


def test_projection_residuals():
    c = series.cosine_drift(50, 0.05, 1.0)
    r = series.residual_matrix(c, False)
    assert np.abs(r @ c).max() < 1e-9 and np.allclose(r @ r, r)
    assert np.abs(series.polynomial_residual(30, 2) @ np.arange(30.0) ** 2).max() < 1e-8
