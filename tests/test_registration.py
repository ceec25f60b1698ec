"""Cubic B-splines, mutual information, levels, first affines, frames pulled through their own affines."""

import numpy as np
import pandas as pd
import pytest

from voxelweave.functions import affine, splines
from voxelweave.operators import spatial


def picture(shape=(1, 24, 24), seed=3):
    return spatial.smoothed(np.random.default_rng(seed).random(shape), 2.0) * 100


def rows_of(spark, frames):
    z, y, x = (a.ravel() for a in np.meshgrid(*map(np.arange, frames[0].shape), indexing="ij"))
    parts = [pd.DataFrame({"t_idx": t, "z_idx": z, "y_idx": y, "x_idx": x, "value": f.ravel()}) for t, f in enumerate(frames)]
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


@pytest.mark.parametrize("shape", [(5, 6, 7), (1, 2, 9), (3, 1, 1)])
def test_coefficients(shape):
    v = np.random.default_rng(0).standard_normal(shape)
    systems = []
    for n in shape:  # splines that pass through all samples, mirrored at the edges
        m = np.zeros((n, n))
        for i in range(n):
            for step, w in ((-1, 1 / 6), (0, 2 / 3), (1, 1 / 6)):
                m[i, splines.mirrored(np.array([i + step]), n)[0]] += w
        systems.append(np.linalg.inv(m))
    assert np.allclose(splines.coefficients(v), np.einsum("ai,bj,ck,ijk->abc", *systems, v))
    points = spatial.grid_points(shape, (1, 1, 1), (0, 0, 0))
    assert np.allclose(spatial.sample_bspline(v, points, -9.0), v.ravel())
    outside = points.astype(float) + np.array([0, 0, shape[2]])
    assert (spatial.sample_bspline(v, outside, -9.0) == -9.0).all()


def test_polynomials_of_degree_three():
    n = 41
    z, y, x = np.meshgrid(*[(np.arange(n) - 20) / 10] * 3, indexing="ij")
    f = lambda z, y, x: 1 + x - 2 * y * z + x**3 - y**2 * x + z**3
    index = np.random.default_rng(1).uniform(16, 24, (200, 3))
    got = spatial.sample_bspline(f(z, y, x), index, 0.0)
    assert np.abs(got - f(*((index - 20) / 10).T)).max() < 1e-7
    assert np.abs(spatial.sample_linear(f(z, y, x), index, 0.0) - f(*((index - 20) / 10).T)).max() > 1e-4


def test_a_tap_at_a_time_is_the_sum_of_all():
    v = np.random.default_rng(2).standard_normal((4, 5, 3))
    index = np.random.default_rng(3).uniform(0, [3, 4, 2], (20, 3))
    c, want = splines.coefficients(v), []
    for p in index:
        ws = []
        for a, n in enumerate(v.shape):
            w = np.zeros(n)
            for k in range(-4, n + 5):
                w[splines.mirrored(np.array([k]), n)[0]] += splines.kernel(np.array(p[a] - k))
            ws.append(w)
        want.append(np.einsum("i,j,k,ijk->", *ws, c))
    assert np.allclose(splines.sample(c, index), want)


def test_resampled_frames(spark):
    frames = [picture(seed=s) for s in (1, 2)]
    affine = np.eye(4)
    affine[:3, 3] = (0, 0.3, -0.6)
    grid = ((1, 24, 24), (1, 1, 1), (0, 0, 0))
    got = spatial.resample(rows_of(spark, frames), affine, grid, grid, "bspline", fill=-1.0).toPandas()
    points = spatial.grid_points(*grid) + affine[:3, 3]
    for t, f in enumerate(frames):
        one = got[got.t_idx == t].sort_values(["z_idx", "y_idx", "x_idx"])
        assert np.allclose(one.value, spatial.sample_bspline(f, points, -1.0))
    with pytest.raises(KeyError):
        spatial.resample(rows_of(spark, frames), affine, grid, grid, "quintic")


def test_mutual_information():
    rng = np.random.default_rng(4)
    fixed = rng.integers(2, 30, 20_000)
    free, tied = rng.random(20_000), (40.0 - fixed) ** 2
    ends = lambda v: (v.min(), v.max())
    assert spatial.mutual_information(fixed, free, ends(free), 32) < 0.05 < 1 < spatial.mutual_information(fixed, tied, ends(tied), 32)
    assert spatial.mutual_information(fixed, np.ones(20_000), (1.0, 1.0), 32) == pytest.approx(0, abs=1e-9)
    # against the sum over all bins
    f, m, bins = np.array([2, 3, 3, 5]), np.array([0.0, 0.4, 1.0, 0.9]), 8
    joint = np.zeros((bins, bins))
    for a, b in zip(f, m, strict=True):
        joint[a] += splines.kernel(2 + b * (bins - 5) - np.arange(bins))
    joint /= joint.sum()
    alone = joint.sum(1)[:, None] * joint.sum(0)
    want = sum(joint[i, j] * np.log(joint[i, j] / alone[i, j]) for i in range(bins) for j in range(bins) if joint[i, j] > 0)
    assert np.isclose(spatial.mutual_information(f, m, (0.0, 1.0), bins), want)


def test_contrast_turned_round():
    fixed = picture()
    moving = 100 - np.roll(fixed, (2, -1), (1, 2))
    wrong, _ = spatial.register(moving, fixed)
    right, found = spatial.register(moving, fixed, metric="mutual_information", bins=16, levels=(2, 1))
    assert np.allclose(right[:3, 3], [0, 2, -1], atol=0.2) and found["status"] == "converged"
    assert np.abs(wrong[:3, 3] - [0, 2, -1]).max() > 1


def test_levels_starts_and_masks():
    fixed = np.zeros((1, 48, 48))
    fixed[0, 4:10, 5:12] = 50 + np.arange(7)
    moving = np.roll(fixed, (25, 20), (1, 2))  # nothing overlaps at the start
    lost, _ = spatial.register(moving, fixed)
    a, _ = spatial.register(moving, fixed, initial="moments")
    assert np.allclose(a[:3, 3], [0, 25, 20], atol=0.05) and not np.allclose(lost[:3, 3], a[:3, 3], atol=1)
    given = np.eye(4)
    given[:3, 3] = (0, 24, 21)
    b, _ = spatial.register(moving, fixed, initial=given, levels=(4, 2, 1))
    assert np.allclose(b[:3, 3], [0, 25, 20], atol=0.05)
    larger = np.zeros((1, 58, 58))
    larger[:, 5:53, 5:53] = fixed
    c, _ = spatial.register(larger, fixed, initial="geometry")
    assert np.allclose(c[:3, 3], [0, 5, 5], atol=0.05)
    p = picture()
    spoilt = np.roll(p, (1, 1), (1, 2))
    spoilt[:, 16:] = 0
    keep = np.ones(p.shape)
    keep[:, 16:] = 0
    d, _ = spatial.register(spoilt, p, metric="mutual_information", bins=16, moving_mask=keep)
    assert np.allclose(d[:3, 3], [0, 1, 1], atol=0.2)


def test_faults():
    p = picture()
    for options in ({"metric": "distance"}, {"bins": 5}, {"fixed": np.where(p == p.max(), np.nan, p)}):
        with pytest.raises(ValueError):
            spatial.register(p, options.pop("fixed", p), **options)


def test_frames_through_their_own_affines(spark):
    fixed = picture((1, 32, 32)) * np.pad(np.hanning(20)[:, None] * np.hanning(20), 6)[None]  # nothing near the edges
    shifts = [(0, 0), (2, 1), (-1, 3)]
    samples = rows_of(spark, [np.roll(fixed, s, (1, 2)) for s in shifts])
    found = spatial.register_volumewise(samples, fixed.shape, transform="translation", levels=(2, 1))
    back = spatial.realign(samples, found, (fixed.shape, (1, 1, 1), (0, 0, 0)), "bspline").toPandas()
    for t in range(3):
        one = back[back.t_idx == t].sort_values(["z_idx", "y_idx", "x_idx"]).value.to_numpy().reshape(fixed.shape)
        assert np.abs(one - fixed)[:, 4:28, 4:28].max() < 0.5
    some = spatial.realign(samples.filter("t_idx < 2"), found.filter("t_idx > 0"), (fixed.shape, (1, 1, 1), (0, 0, 0)))
    assert [r.t_idx for r in some.select("t_idx").distinct().collect()] == [1]


def test_motion_by_axes(spark):
    a = [affine.compose([0, 0, 0], np.eye(3), [1, 1, 1]), affine.compose([1, 2, 3], affine.rotation(0.1, -0.2, 0.3), [1, 1, 1]), affine.compose([1, 2, 5], affine.rotation(0.1, -0.2, 0.3), [2, 1, 3])]
    rows = spark.createDataFrame([(t, m.tolist()) for t, m in enumerate(a)], "t_idx long, m array<array<double>>")
    grid, mask = ((2, 3, 4), (1.0, 0.5, 0.2), (-1.0, 0.0, 4.0)), np.arange(24).reshape(2, 3, 4) % 5 > 0
    got = spatial.motion_table(rows, grid=grid, mask=mask).toPandas().sort_values("t_idx")
    assert np.allclose(got[["rot_z", "rot_y", "rot_x", "trans_z", "trans_y", "trans_x"]].iloc[1], [0.1, -0.2, 0.3, 1, 2, 3])
    assert np.allclose(got[["rot_z", "rot_y", "rot_x", "trans_z"]].iloc[2], [0.1, -0.2, 0.3, 1])  # zooms don't turn
    p = spatial.grid_points(*grid)[mask.ravel()]
    at = [p @ m[:3, :3].T + m[:3, 3] for m in a]
    d = [np.linalg.norm(at[1] - at[0], axis=1), np.linalg.norm(at[2] - at[1], axis=1), np.zeros(len(p))]
    assert np.allclose(got.mean_fd, [x.mean() for x in d]) and np.allclose(got.max_fd, [x.max() for x in d]) and np.allclose(got.rms_fd, [np.sqrt((x * x).mean()) for x in d])
    swapped = spatial.motion_table(rows, dims=("x", "y", "z")).toPandas().sort_values("t_idx")
    assert np.allclose(swapped[["trans_x", "trans_y", "trans_z"]].iloc[1], [1, 2, 3]) and "mean_fd" not in swapped
