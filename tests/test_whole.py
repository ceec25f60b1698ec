"""Registered queries against brute force on tables that reach beyond fixed ids, times and columns."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import decompose, layout
from voxelweave.plans import registry


def put(spark, folder, name, rows, *columns):
    spark.createDataFrame(pd.DataFrame(rows)).select(*(columns or ["*"])).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_active_events(spark, tmp_path):
    onset = 86400.0 * 19000 + np.array([0, 3600, 86400 * 24, 86400 * 29, 86400 * 40, 86400 * 55 + 17])
    value = np.array([2.0, 0, 500, 0, 90, 4000])
    d = put(spark, tmp_path, "events", {"event_id": np.arange(6), "ts": onset, "value": value, "event_type": "a"}, "event_id", F.timestamp_seconds("ts").alias("ts"), "value", "event_type")
    got = registry.queries()["active_events"](spark, d).toPandas()
    want = set()
    for k in range(1000):
        start, end = onset[0] + k * 7200, onset[0] + k * 7200 + 7200
        for i, (a, n) in enumerate(zip(onset, np.floor(value * 60), strict=True)):
            if (a < end and start < a + n) if n > 0 else start <= a < end:
                want.add((k, i))
    assert sorted(zip(got.frame_id, got.event_id, strict=True)) == sorted(want)
    assert set(got.event_id) == set(range(6))


def test_thresholds_of_all_parts(spark, tmp_path):
    rng = np.random.default_rng(1)
    key, size = np.arange(1, 1001), rng.integers(1, 51, 1000)
    d = put(spark, tmp_path, "part", {"p_partkey": key, "p_size": size})
    z = {(k // 20, k % 20): round((s - 25) / 5, 3) for k, s in zip(key.tolist(), size.tolist(), strict=True)}
    run = lambda name: registry.queries()[name](spark, d).toPandas()
    cells = lambda p: {(y, x): v for y, x, v in zip(p.y_idx, p.x_idx, p.z, strict=True)}
    assert cells(run("threshold_fixed")) == {c: v if abs(v) >= 2.5 else 0 for c, v in z.items()}
    got = cells(run("threshold_slices"))
    assert got.keys() == z.keys() and all(got[c] == v if abs(v) <= 2 else np.isnan(got[c]) for c, v in z.items())
    large = {}
    for c in z:
        if c not in large and abs(z[c]) >= 1:
            seen, todo = {c}, [c]
            while todo:
                y, x = todo.pop()
                for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if n not in seen and abs(z.get(n, 0)) >= 1 and z[n] * z[c] > 0:
                        seen.add(n)
                        todo.append(n)
            large |= dict.fromkeys(seen, len(seen) >= 4)
    assert cells(run("cluster_filter")) == {c: v if large.get(c) else 0 for c, v in z.items()}
    p = np.array([math.erfc(abs(v) / math.sqrt(2)) for v in z.values()])
    ranked = np.sort(p)
    cut = ranked[np.flatnonzero(ranked <= 0.05 * np.arange(1, 1001) / 1000).max()]
    want = {y * 20 + x: v if q <= cut else 0 for ((y, x), v), q in zip(z.items(), p, strict=True)}
    got = run("threshold_fdr")
    assert dict(zip(got.voxel_id, got.z, strict=True)) == want
    assert set(got.threshold) == {min(abs(v) for v in want.values() if v)}


def embeddings(spark, folder, n):
    """n vectors of 64 columns, and where they are."""
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((n, 3)) ** 3 @ rng.standard_normal((3, 64)) + 0.1 * rng.standard_normal((n, 64))).astype(np.float32).astype(float)
    label = rng.integers(0, 3, n)
    rows = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{folder}/embeddings.parquet")
    return x, label, str(folder)


def by_voxel(df, k):
    out = np.full((64, k), np.nan)
    out[df.voxel_id, df.component] = df.value
    return out


def factors(x, k, steps, tolerance=1e-4):
    """The rounds of nmf on voxels x time, with nothing spread."""
    h, losses = np.random.default_rng(0).uniform(0.1, 1, (k, x.shape[1])), []

    def weights(h):
        w = np.maximum(x @ np.linalg.pinv(h), 1e-6)
        for _ in range(60):
            w = w * (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        return w

    for _ in range(steps):
        w = weights(h)
        losses.append(((x - w @ h) ** 2).sum())
        for _ in range(60):
            h = h * (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[0]:
            break
    return weights(h)


def components(x, k, steps, tolerance=1e-4):
    """The rounds of fast_ica on voxels x time, from a singular value decomposition."""
    n, c = len(x), x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    v = v[:k] * np.where(v[np.arange(k), np.abs(v[:k]).argmax(1)] < 0, -1, 1)[:, None]
    white = c @ (v / s[:k, None] * np.sqrt(n)).T

    def symmetric(w):
        u, _, t = np.linalg.svd(w)
        return u @ t

    w = symmetric(np.random.default_rng(0).standard_normal((k, k)))
    for _ in range(steps):
        y = white @ w.T
        new = symmetric((y**3).T @ white / n - (3 * y**2).mean(0)[:, None] * w)
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < tolerance:
            break
    return white @ w.T


@pytest.mark.parametrize("n", [40, 150])
def test_factors_of_all_times(spark, tmp_path, n):
    x, _, d = embeddings(spark, tmp_path, n)
    x = np.abs(x).T
    got = by_voxel(registry.queries()["nmf"](spark, d).toPandas(), 3)
    assert np.allclose(got, factors(x, 3, 200), atol=2e-3, rtol=1e-3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "voxel_id long, series array<double>")
    rows = decompose.fast_ica(df, 3, steps=10)[0].orderBy("voxel_id").collect()
    assert np.allclose([r.series for r in rows], components(x, 3, 10), atol=2e-3)


def test_sources_of_all_parts(spark, tmp_path):
    rng = np.random.default_rng(7)
    size, price = rng.integers(1, 51, 300), rng.uniform(900, 1100, 300)
    d = put(spark, tmp_path, "part", {"p_partkey": np.arange(1, 301), "p_size": size, "p_retailprice": price})
    got = registry.queries()["fast_ica"](spark, d).toPandas().pivot(index="voxel_id", columns="component", values="value").to_numpy()
    sources = np.column_stack([size / 14, price / 100, np.arange(1, 301) % 7])
    x = np.stack([sum(sources[:, j] * (np.cos(1.0 + 2 * t * (j + 1)) + (j == t)) for j in range(3)) for t in range(6)], 1)
    assert np.allclose(got, components(x, 3, 500), atol=2e-3)
    z = (sources - sources.mean(0)) / sources.std(0)
    assert (np.abs(got.T @ z / 300).max(1) > 0.97).all()  # each one is a source


def test_spatial_gram_of_blocks(spark):
    x = np.random.default_rng(3).standard_normal((5, 23))
    s = spark.createDataFrame([(7 * i, v.tolist()) for i, v in enumerate(x)], "voxel_id long, series array<double>")
    gram = layout.spatial_gram(s, x.mean(0), 10)
    c = x - x.mean(0)
    assert np.allclose(gram, c @ c.T)
    _, values, v = np.linalg.svd(c, full_matrices=False)
    fit = decompose.PCA(3, "spatial").fit(s)
    assert np.allclose(fit.singular_values_, values[:3])
    assert np.allclose(np.abs((fit.vectors_.T * v[:3]).sum(1)), 1)


def test_searchlight_of_all_times(spark, tmp_path):
    x, label, d = embeddings(spark, tmp_path, 150)
    got = registry.queries()["searchlight"](spark, d).toPandas().set_index("voxel_id").score.sort_index()
    fold, start = np.empty(150, int), 0
    for y in dict.fromkeys(label):  # in order of appearance
        rows = np.flatnonzero(label == y)
        fold[rows] = sorted(p % 5 for p in range(start, start + len(rows)))
        start += len(rows)
    want = []
    for c in range(64):
        near = [v for v in range(64) if (v % 8 - c % 8) ** 2 + (v // 8 - c // 8) ** 2 <= 1]
        scores = []
        for k in range(5):
            train, test = x[fold != k][:, near], x[fold == k][:, near]
            means = np.array([train[label[fold != k] == y].mean(0) for y in range(3)])
            scores.append((((test[:, None] - means) ** 2).sum(2).argmin(1) == label[fold == k]).mean())
        want.append(np.mean(scores))
    assert list(got.index) == list(range(64)) and np.allclose(got, want, atol=1e-5)


def test_connectivity_of_all_columns(spark, tmp_path):
    x, _, d = embeddings(spark, tmp_path, 150)
    inverse = [np.linalg.inv(decompose.shrunk_covariance(x[s::5])) for s in range(5)]
    partial = [np.where(np.eye(64) > 0, 1, -m / np.sqrt(np.outer(np.diag(m), np.diag(m)))) for m in inverse]
    for kind, want in (("precision", inverse), ("partial_correlation", partial), ("tangent", None)):
        p = registry.queries()[f"connectivity_{kind}"](spark, d).toPandas()
        got = np.full((5, 64, 64), np.nan)
        got[p.subject, p.i, p.j] = p.value
        assert len(p) == got.size and np.isfinite(got).all()
        if want is not None:
            assert np.allclose(got, want, atol=1e-4, rtol=1e-5)
        else:  # the tangents of the subjects are around their mean
            assert np.abs(got.mean(0)).max() < 1e-3


def test_factors_of_many_times_stay_on_the_cluster(spark, tmp_path, monkeypatch):
    x, _, d = embeddings(spark, tmp_path, 2100)  # two blocks of times and a part
    kind, sent = type(spark.range(1)), []
    whole = kind.toPandas

    def counted(df):
        out = whole(df)
        sent.append(len(out))
        return out

    monkeypatch.setattr(kind, "toPandas", counted)
    rows = registry.queries()["nmf"](spark, d)
    monkeypatch.undo()
    assert sent and max(sent) <= 3 * 3 + 64 * 3 + 1  # sums of a round, whatever the times
    x = np.abs(x).T
    assert np.allclose(by_voxel(rows.toPandas(), 3), factors(x, 3, 200), atol=2e-3, rtol=1e-3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:9])], "voxel_id long, series array<double>")
    near, far = (decompose.nmf(df, 2, steps=4, direct=n) for n in (10, 5000))
    assert np.allclose(near[1], far[1], rtol=1e-8, atol=1e-10) and np.allclose(near[2], far[2])
