"""Exact AR fits against whitened least squares voxel by voxel, and models of many runs in one plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import glm, layout, runs, series


def simulated(n=80, voxels=6, seed=0, rho=0.4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.sin(np.arange(n) / 5), rng.normal(size=n), np.ones(n)])
    noise = rng.normal(size=(voxels, n))
    for t in range(1, n):
        noise[:, t] += rho * noise[:, t - 1]
    return x, rng.normal(size=(voxels, 3)) @ x.T + noise


def one_by_one(x, y, order):
    """Ordinary least squares on a voxel's own whitened design, written out."""
    n, out = len(x), []
    for row in y:
        e = row - x @ np.linalg.lstsq(x, row, rcond=None)[0]
        e = e - e.mean()
        c = [np.sum(e[: n - k] * e[k:]) / n for k in range(order + 1)]
        rho = np.linalg.solve([[c[abs(i - j)] for j in range(order)] for i in range(order)], c[1:])
        w = np.eye(n)
        for k, r in enumerate(rho, 1):
            w -= r * np.eye(n, k=-k)
        wx, wy = w @ x, w @ row
        theta = np.linalg.lstsq(wx, wy, rcond=None)[0]
        rss = np.sum((wy - wx @ theta) ** 2)
        out.append((theta, np.linalg.inv(wx.T @ wx), rss / (n - np.linalg.matrix_rank(x))))
    return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_ar_fit_is_exact_for_each_voxel(order):
    x, y = simulated()
    theta, cov, dispersion = glm.Design(x, order).fit(y)
    for k, (t, c, d) in enumerate(one_by_one(x, y, order)):
        assert np.allclose(theta[k], t) and np.allclose(cov[k], c) and np.isclose(dispersion[k], d)


def test_whitening_by_one_or_by_each():
    x, y = simulated()
    assert np.array_equal(glm.whitened(y, np.zeros((len(y), 1))), y)
    rho = np.linspace(-0.5, 0.5, 2 * len(y)).reshape(-1, 2)
    each = np.stack([glm.whitened(row, r) for row, r in zip(y, rho)])
    assert np.allclose(glm.whitened(y, rho), each) and np.allclose(each[0, 2:], y[0, 2:] - rho[0, 0] * y[0, 1:-1] - rho[0, 1] * y[0, :-2])


def test_degenerate_and_saturated():
    x, y = simulated(voxels=3)
    y[1] = 0.0
    y[2] = x @ [1.0, 2.0, 3.0]
    theta, cov, dispersion = glm.Design(x, 1).fit(y)
    assert np.allclose(theta[1], 0) and dispersion[1] == 0 and np.allclose(theta[2], [1, 2, 3]) and dispersion[2] < 1e-20
    square = np.vander(np.arange(4.0), 4)
    d = glm.Design(square)
    theta, _, dispersion = d.fit(np.ones((2, 4)))
    assert d.dof == 0 and np.isnan(dispersion).all() and np.allclose(theta @ square.T, 1)
    twice = glm.Design(np.column_stack([x, x[:, 0]]), 1)  # a column that is there twice shares its effect
    theta, _, _ = twice.fit(y[:1])
    assert twice.dof == len(x) - 3 and np.isclose(theta[0, 0], theta[0, 3])
    with pytest.raises(ValueError):
        glm.Design(np.ones((3, 1)), 3)
    for bad in ("ar", "ar0", "arx", "none"):
        with pytest.raises(ValueError):
            glm.noise_order(bad)


def table(spark, y):
    return spark.createDataFrame([(v, row.tolist()) for v, row in enumerate(y)], "voxel_id long, series array<double>")


def test_f_is_t_squared(spark):
    x, y = simulated()
    fitted = glm.fit(table(spark, y), x, "ar2")
    t = {r.voxel_id: r.statistic for r in glm.statistic(glm.contrast(fitted, np.array([1.0, -0.5, 0.0]))).collect()}
    f = {r.voxel_id: r.statistic for r in glm.f_contrast(fitted, np.array([[1.0, -0.5, 0.0]])).collect()}
    assert all(np.isclose(f[v], t[v] ** 2) for v in t)


RUNS = [(0, 60, 1.0), (1, 60, 1.0), (2, 45, 1.5)]  # run, volumes, step


@pytest.fixture(scope="module")
def recorded(spark):
    """Three runs, of two lengths, with their tables."""
    rng = np.random.default_rng(3)
    samples, times, events, confounds = [], [], [], []
    for run, n, dt in RUNS:
        t = dt * np.arange(n)
        times += [(run, k, float(v)) for k, v in enumerate(t)]
        for k, onset in enumerate(np.arange(4, n * dt - 10, 9.0)):
            events.append((run, float(onset + run), 2.0, "go" if k % 2 else "stop", 1.0 + k % 3))
        motion = rng.normal(size=n)
        confounds += [(run, k, float(v), float(k % 5)) for k, v in enumerate(motion)]
        y = rng.normal(size=(7, n)) + np.sin(t / 6)
        samples += [(run, v, k, float(y[v, k])) for v in range(7) for k in range(n)]
    make = spark.createDataFrame
    return {"samples": make(samples, "run int, voxel_id long, t_idx int, value double"), "times": make(times, "run int, t_idx int, time double"), "events": make(events, "run int, onset double, duration double, trial_type string, modulation double"), "confounds": make(confounds, "run int, t_idx int, motion double, slow double")}


def of_run(recorded, name, run):
    return recorded[name].filter(F.col("run") == run).toPandas()


def by_hand(recorded, run, **how):
    """The design of one run by the functions of the driver."""
    e = of_run(recorded, "events", run).drop(columns="run")
    e = e.sort_values(["trial_type", "onset"])
    c = of_run(recorded, "confounds", run).sort_values("t_idx")[["motion", "slow"]].reset_index(drop=True)
    t = of_run(recorded, "times", run).sort_values("t_idx")["time"].to_numpy()
    return glm.first_level_design(t, e, confounds=c, **how)


@pytest.mark.parametrize("how", [{}, {"drift": "polynomial", "drift_order": 2}, {"model": "fir", "fir_delays": [0, 2, 11]}, {"drift": None, "model": "spm"}])
def test_designs(spark, recorded, how):
    got = {r.run: r for r in runs.designs(recorded["times"], recorded["events"], recorded["confounds"], **how).collect()}
    for run, _, _ in RUNS:
        want = by_hand(recorded, run, **how)
        assert got[run].columns == list(want.columns) and np.allclose(np.array(got[run].x).T, want.to_numpy())


@pytest.mark.parametrize("noise", ["ols", "ar1"])
@pytest.mark.parametrize("few", [runs.DESIGN_VALUES, 0])
def test_fit_and_contrasts_of_each_run(spark, recorded, noise, few):
    packed = layout.to_series(recorded["samples"], ("run", "voxel_id"))
    design = runs.designs(recorded["times"], recorded["events"], recorded["confounds"])
    fitted = runs.fit(packed, design, noise, few).collect()
    assert len(fitted) == 21
    for run, _, _ in RUNS:
        x = by_hand(recorded, run)
        y = {r.voxel_id: r.series for r in packed.filter(F.col("run") == run).collect()}
        want = glm.Design(x.to_numpy(), glm.noise_order(noise)).fit(np.array([y[v] for v in range(7)]))
        for r in fitted:
            if r.run == run:
                assert r.columns == list(x.columns) and np.allclose(r.theta, want[0][r.voxel_id]) and np.allclose(r.covariance, want[1][r.voxel_id].ravel()) and np.isclose(r.dispersion, want[2][r.voxel_id])


def test_pooled_over_runs(spark, recorded):
    model = runs.RunsModel(noise="ar1").fit(recorded["samples"], recorded["times"], recorded["events"], recorded["confounds"])
    got = {r.voxel_id: r for r in model.contrast("go - stop").collect()}
    each = {v: [] for v in range(7)}
    for run, _, _ in RUNS:
        x = by_hand(recorded, run)
        c = glm.contrast_vector("go - stop", list(x.columns))
        y = {r.voxel_id: r.series for r in model.series.filter(F.col("run") == run).collect()}
        d = glm.Design(x.to_numpy(), 1)
        theta, cov, dispersion = d.fit(np.array([y[v] for v in range(7)]))
        for v in range(7):
            each[v].append((c @ theta[v], c @ cov[v] @ c * dispersion[v], d.dof))
    for v, rows in each.items():
        e, s, dof = (sum(r[k] for r in rows) for k in range(3))
        assert np.isclose(got[v].effect, e / 3) and np.isclose(got[v].variance, s / 9) and got[v].dof == dof
        assert np.isclose(got[v].statistic, (e / 3) / np.sqrt(s / 9))
    maps = {r.voxel_id: r.value for r in model.compute_contrast("go - stop", output="statistic").collect()}
    assert all(np.isclose(maps[v], got[v].statistic) for v in maps)
    f = {r.voxel_id: r for r in model.contrast(np.eye(2)).collect()}
    assert len(f) == 7 and all(len(r.effects) == 2 and r.statistic >= 0 for r in f.values())


def test_f_of_one_run_is_t_squared(spark, recorded):
    one = recorded["samples"].filter("run = 2")
    model = runs.RunsModel().fit(one, recorded["times"].filter("run = 2"), recorded["events"].filter("run = 2"))
    t = {r.voxel_id: r.statistic for r in model.contrast("go").collect()}
    f = {r.voxel_id: r.statistic for r in model.contrast("go", "F").collect()}
    assert all(np.isclose(f[v], t[v] ** 2) for v in t)


def test_pooled_by_subject(spark, recorded):
    subjects = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "run int, subject string")
    model = runs.RunsModel(noise="ols").fit(recorded["samples"], recorded["times"], recorded["events"])
    got = {(r.subject, r.voxel_id): r for r in model.contrast("go", keys=subjects).collect()}
    alone = {r.voxel_id: r for r in runs.RunsModel(noise="ols").fit(recorded["samples"].filter("run < 2"), recorded["times"].filter("run < 2"), recorded["events"].filter("run < 2")).contrast("go").collect()}
    assert len(got) == 14 and all(np.isclose(got["a", v].effect, alone[v].effect) and np.isclose(got["a", v].variance, alone[v].variance) for v in range(7))


def test_a_voxel_that_a_run_lacks_is_left_out(spark, recorded):
    model = runs.RunsModel(noise="ols").fit(recorded["samples"].filter("not (run = 1 and voxel_id = 3)"), recorded["times"], recorded["events"])
    assert sorted(r.voxel_id for r in model.contrast("go").collect()) == [0, 1, 2, 4, 5, 6]


def test_given_designs_masks_and_predictions(spark, recorded):
    given = recorded["confounds"].withColumn("constant", F.lit(1.0))
    mask = spark.createDataFrame([(1,), (4,)], "voxel_id long")
    model = runs.RunsModel(noise="ols").fit(recorded["samples"], given=given, mask=mask)
    assert {tuple(r.columns) for r in model.designs.collect()} == {("motion", "slow", "constant")}
    rows = model.predictions().collect()
    assert {r.voxel_id for r in rows} == {1, 4} and len(rows) == 2 * (60 + 60 + 45)
    x = of_run(recorded, "confounds", 2).sort_values("t_idx")[["motion", "slow"]].assign(c=1.0).to_numpy()
    y = np.array(model.series.filter("run = 2 and voxel_id = 4").first().series)
    left = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([r.residual for r in sorted(rows, key=lambda r: r.t_idx) if (r.run, r.voxel_id) == (2, 4)], left)
    with pytest.raises(ValueError, match="no place"):
        runs.RunsModel().fit(recorded["samples"], given=given, events=recorded["events"])
    with pytest.raises(ValueError, match="times"):
        runs.RunsModel().fit(recorded["samples"])


def test_smoothing_comes_before_the_mask(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 1, 2, 3))
    rows = [(0, z * 6 + y * 3 + k, t, z, y, k, float(x[t, z, y, k])) for t, z, y, k in np.ndindex(x.shape)]
    samples = spark.createDataFrame(rows, "run int, voxel_id long, t_idx int, z_idx int, y_idx int, x_idx int, value double")
    given = spark.createDataFrame([(0, t, 1.0) for t in range(20)], "run int, t_idx int, constant double")
    mask = spark.createDataFrame([(4,)], "voxel_id long")
    model = runs.RunsModel(noise="ols", smoothing=2.0, shape=(1, 2, 3)).fit(samples, given=given, mask=mask)
    smooth = series.smooth_volume(samples, (1, 2, 3), 2.0, keys=("run", "t_idx")).filter("y_idx = 1 and x_idx = 1").agg(F.avg("value")).first()[0]
    assert np.isclose(model.contrast("constant").first().effect, smooth)


def test_faults(spark, recorded):
    packed = layout.to_series(recorded["samples"], ("run", "voxel_id"))
    some = runs.designs(recorded["times"].filter("run < 2"))
    for few in (runs.DESIGN_VALUES, 0):
        with pytest.raises(Exception, match="no design"):
            runs.fit(packed, some, "ols", few).collect()
    short = runs.designs(recorded["times"].filter("t_idx < 30"))
    with pytest.raises(Exception, match="meets a design"):
        runs.fit(packed, short).collect()
    with pytest.raises(Exception, match="one name"):
        runs.designs(recorded["times"], recorded["events"], recorded["confounds"].withColumnRenamed("motion", "go")).collect()
    with pytest.raises(Exception, match="different lengths"):
        runs.designs(recorded["times"], None, recorded["confounds"].filter("t_idx > 0")).collect()
    with pytest.raises(Exception, match="isn't finite"):
        runs.designs(recorded["times"], None, recorded["confounds"].withColumn("motion", F.lit(None).cast("double"))).collect()


def test_a_thousand_runs_are_one_plan(spark):
    n, voxels = 12, 2
    times = spark.range(1000).select(F.col("id").alias("run")).crossJoin(spark.range(n).select(F.col("id").cast("int").alias("t_idx"))).withColumn("time", F.col("t_idx") * 2.0)
    samples = times.crossJoin(spark.range(voxels).withColumnRenamed("id", "voxel_id")).withColumn("value", F.col("run") * 0.001 + F.col("voxel_id") + F.pmod(F.xxhash64("run", "t_idx", "voxel_id"), F.lit(100)) / 100.0)
    model = runs.RunsModel(drift=None, noise="ols").fit(samples, times)
    plan = model.contrast("constant")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.splitlines()) < 120
    got = {r.voxel_id: r for r in model.contrast("constant").collect()}
    want = {r.voxel_id: r.m for r in samples.groupBy("voxel_id").agg(F.avg("value").alias("m")).collect()}
    assert all(np.isclose(got[v].effect, want[v]) and got[v].dof == 1000 * (n - 1) for v in range(voxels))
