"""Components of long recordings: products with few columns against a whole singular value decomposition."""

import numpy as np
import pytest

from voxelweave.operators import decompose, layout, series


def table(spark, x):
    return spark.createDataFrame([(v, row.tolist()) for v, row in enumerate(x)], "voxel_id long, series array<double>")


@pytest.mark.parametrize("voxels,times", [(30, 90), (90, 30), (60, 60)])
@pytest.mark.parametrize("mode", ["temporal", "spatial"])
def test_all_ways_give_the_same_components(spark, voxels, times, mode):
    rng = np.random.default_rng(voxels)
    x = rng.normal(size=(voxels, 4)) @ rng.normal(size=(4, times)) + 0.1 * rng.normal(size=(voxels, times)) + 3
    c = x - x.mean(1, keepdims=True) if mode == "temporal" else x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    df = table(spark, x)
    for direct in (1000, 0):
        p = decompose.PCA(3, mode, direct=direct).fit(df)
        assert np.allclose(p.singular_values_, s[:3]) and np.allclose(np.abs((p.vectors_ * v[:3].T).sum(0)), 1)
        assert np.allclose(p.explained_variance_ratio_, s[:3] ** 2 / (s**2).sum())
        back = np.array([r.series for r in p.reconstruct(df).orderBy("voxel_id").collect()])
        assert np.allclose(back, (c @ v[:3].T) @ v[:3] + (x - c))


def test_close_values_and_few_ranks():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([[10, 9.99, 9.98], np.linspace(9.5, 0.1, 197)])
    a = (q * values) @ q.T
    got, vectors = layout.top_eigenvectors(lambda b: a @ b, 200, 3)
    assert np.allclose(got, values[:3]) and np.allclose(np.abs((vectors * q[:, :3]).sum(0)), 1, atol=1e-7)
    low = np.outer(q[:, 0], q[:, 0]) * 4
    got, vectors = layout.top_eigenvectors(lambda b: low @ b, 200, 3)
    assert np.allclose(got, [4, 0, 0], atol=1e-9) and np.isclose(abs(vectors[:, 0] @ q[:, 0]), 1)
    assert np.allclose(layout.top_eigenvectors(lambda b: np.diag([3.0, 2, 1]) @ b, 3, 2)[0], [3, 2])


def test_what_the_driver_holds_grows_with_times_alone(spark, monkeypatch):
    """Neither square matrix is made beyond the bound."""
    x = np.random.default_rng(2).normal(size=(40, 3)) @ np.random.default_rng(3).normal(size=(3, 50))
    for name in ("temporal_gram", "spatial_gram"):
        monkeypatch.setattr(layout, name, lambda *a, **k: pytest.fail("a square matrix"))
    seen = []
    inner = layout.gram_product
    monkeypatch.setattr(layout, "gram_product", lambda s, q: (seen.append(q.shape), inner(s, q))[1])
    values, vectors, total = layout.time_components(table(spark, x), 2, "voxel", direct=10)
    c = x - x.mean(1, keepdims=True)
    assert np.allclose(np.sqrt(values), np.linalg.svd(c)[1][:2]) and np.isclose(total, (c**2).sum()) and all(q[0] == 50 and q[1] <= 6 for q in seen)


def test_confounds_of_noise_voxels(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 40))
    x[3] = 1.0
    z = np.where(x.std(1, keepdims=True) > 0, (x - x.mean(1, keepdims=True)) / np.maximum(x.std(1, ddof=1, keepdims=True), 1e-300), 0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    got, share = series.compcor_confounds(table(spark, x), 3)
    assert np.allclose(np.abs((got * v[:3].T).sum(0)), 1) and np.allclose(share, s[:3] ** 2 / (s**2).sum())


def test_no_voxels(spark):
    with pytest.raises(ValueError, match="no voxels"):
        layout.time_components(table(spark, np.zeros((1, 3))).limit(0), 2)
