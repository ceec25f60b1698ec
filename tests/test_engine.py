"""Operators on small tables against numpy."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.operators import atlas, decompose, glm, layout, masks, reductions, series, spatial, thresholds, validate, windows
from voxelweave.sources import tables, volumes
from voxelweave.streaming import doppler


def frame(spark, x, name="value"):
    t, v = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"t_idx": t.ravel(), "voxel_id": v.ravel(), name: x.ravel()}))


def back(df, shape, value="value"):
    p = df.toPandas()
    out = np.full(shape, np.nan)
    out[p["t_idx"], p["voxel_id"]] = p[value]
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).standard_normal((40, 6)).cumsum(0) + 50


def test_reductions(spark, x):
    s = frame(spark, x)
    got = reductions.compute_tsnr(s).toPandas().set_index("voxel_id").tsnr.sort_index()
    assert np.allclose(got, x.mean(0) / x.std(0))
    flat = frame(spark, np.ones((4, 2)))
    assert np.isinf(reductions.compute_tsnr(flat).toPandas().tsnr).all()
    c = x - x.mean(0)
    ar = reductions.ar1_coefficients(s).toPandas().set_index("voxel_id").sort_index()
    assert np.allclose(ar.ar1, (c[1:] * c[:-1]).sum(0) / (c * c).sum(0))
    assert reductions.ar1_coefficients(flat).toPandas().ar1.tolist() == [0.0, 0.0]
    d = reductions.compute_dvars(s).toPandas().set_index("t_idx").dvars.sort_index().to_numpy()
    assert d[0] == pytest.approx(d[1:].min())
    with pytest.raises(ValueError):
        reductions.extract_with_labels(s, spark.createDataFrame([(0, 1)], "voxel_id long, region int"), "mode")


def test_series_operators(spark, x):
    s, packed = frame(spark, x), layout.to_series(frame(spark, x))
    assert np.allclose(back(layout.to_long(packed), x.shape), x)
    t = np.arange(40.0)
    line = np.polynomial.polynomial.polyval(t, np.polynomial.polynomial.polyfit(t, x, 1)).T
    assert np.allclose(back(series.detrend(s, 1), x.shape), x - line)
    assert np.allclose(back(layout.to_long(series.detrend_series(packed, 40, 1)), x.shape), x - line)
    assert np.allclose(back(series.standardize(s), x.shape), (x - x.mean(0)) / x.std(0, ddof=1))
    assert np.isnan(back(series.standardize(frame(spark, np.ones((4, 2)))), (4, 2))).all()
    y = back(layout.to_long(series.clean(packed, 40, detrend_order=1, standardize_method="zscore", confounds=np.sin(t))), x.shape)
    assert np.allclose(y.mean(0), 0, atol=1e-9) and np.allclose(y.std(0, ddof=1), 1)
    bad = x.copy()
    bad[[0, 7, 39], 2] = np.nan
    fixed = back(series.repair_non_finite(frame(spark, bad)), x.shape)
    assert fixed[7, 2] == pytest.approx((x[6, 2] + x[8, 2]) / 2) and fixed[0, 2] == x[1, 2] and fixed[39, 2] == x[38, 2]
    with pytest.raises(ValueError):
        series.censor_samples(s, spark.createDataFrame([(0, False)], "t_idx long, keep boolean"))


def test_resample(spark, x):
    s = frame(spark, x).withColumn("time", F.col("t_idx") * 0.5)
    want = np.array([-0.5, 0.0, 3.3, 19.5, 20.4])
    out = series.resample_time(s, spark.createDataFrame([(float(v),) for v in want], "time double")).toPandas()
    got = out.pivot(index="time", columns="voxel_id", values="value").to_numpy()
    inner = np.array([np.interp(want, np.arange(40) * 0.5, c) for c in x.T]).T
    assert np.allclose(got[1:4], inner[1:4]) and np.allclose(got[0], 2 * x[0] - x[1]) and np.allclose(got[4], x[39] + (x[39] - x[38]) * 1.8)


def test_windows(spark):
    rng = np.random.default_rng(2)
    z = rng.standard_normal((20, 3)) + 1j * rng.standard_normal((20, 3))
    t, v = np.indices(z.shape)
    s = spark.createDataFrame(pd.DataFrame({"t_idx": t.ravel(), "voxel_id": v.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})).select("t_idx", "voxel_id", F.struct("re", "im").alias("value"))
    w = windows.sliding_windows(s, 20, 6, 4)
    assert w.select("window_id").distinct().count() == windows.window_count(20, 6, 4) == 4
    p = windows.power_doppler(w).toPandas().pivot(index="window_id", columns="voxel_id", values="value").to_numpy()
    assert np.allclose(p, [(np.abs(z[a : a + 6]) ** 2).mean(0) for a in (0, 4, 8, 12)])
    q = windows.filtered_power_doppler(w, "svd_indices", low=0).toPandas().pivot(index="window_id", columns="voxel_id", values="value").to_numpy()
    assert np.allclose(p, q)
    a = windows.axial_velocity(w, 500.0, 15e6, kernel=1).toPandas().pivot(index="window_id", columns="voxel_id", values="value").to_numpy()
    b = windows.filtered_axial_velocity(w, 500.0, 15e6, kernel=1).toPandas().pivot(index="window_id", columns="voxel_id", values="value").to_numpy()
    assert np.allclose(a, b)
    assert windows.cumulative_energy_threshold(w, 6) == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        windows.window_count(5, 6, 1)


def test_glm(spark, x):
    rng = np.random.default_rng(4)
    design = np.column_stack([rng.standard_normal(40), np.ones(40)])
    f = glm.fit(layout.to_series(frame(spark, x)), design)
    got = glm.with_tails(glm.statistic(glm.contrast(f, [1.0, 0.0]))).toPandas().set_index("voxel_id").sort_index()
    beta, rss, _, _ = np.linalg.lstsq(design, x, rcond=None)
    se = np.sqrt(rss / 38 * np.linalg.inv(design.T @ design)[0, 0])
    assert np.allclose(got.effect, beta[0]) and np.allclose(got.statistic, beta[0] / se)
    assert np.allclose(glm.f_contrast(f, [[1.0, 0.0]]).toPandas().set_index("voxel_id").sort_index().statistic, (beta[0] / se) ** 2)
    assert glm.fit(layout.to_series(frame(spark, x)), design, "ar1").count() == 6
    two = glm.fixed_effects([glm.contrast(f, [1.0, 0.0])] * 2).toPandas().set_index("voxel_id").sort_index()
    assert np.allclose(two.effect, beta[0]) and np.allclose(two.variance, se**2 / 2)


def test_first_level_model(spark):
    times = np.arange(120) * 0.5
    events = pd.DataFrame({"onset": [5.0, 25, 45], "duration": [2.0] * 3, "trial_type": ["A"] * 3, "modulation": [1.0] * 3})
    d = glm.first_level_design(times, events)
    y = np.column_stack([3 * d["A"], 0 * d["A"]]) + np.random.default_rng(1).standard_normal((120, 2)) * 0.001
    m = glm.FirstLevelModel().fit([layout.to_series(frame(spark, y))], [times], [events])
    got = m.contrast("A").toPandas().set_index("voxel_id")
    assert got.effect[0] == pytest.approx(3, abs=0.05) and got.z[0] > 10


def test_cluster_filter(spark):
    g = np.zeros((6, 6))
    g[0, :4], g[3, 3], g[5, :3] = 2, 2, -2
    y, x = np.indices(g.shape)
    df = spark.createDataFrame(pd.DataFrame({"z_idx": 0, "y_idx": y.ravel(), "x_idx": x.ravel(), "z": g.ravel()}))
    p = thresholds.cluster_filter(df, 3).toPandas()
    out = np.zeros_like(g)
    out[p.y_idx, p.x_idx] = p.z
    g[3, 3] = 0
    assert np.array_equal(out, g)


def test_decompositions(spark, x):
    s = layout.to_series(frame(spark, x))
    c = x - x.mean(0)
    _, sv, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(decompose.PCA(3).fit(s).singular_values_, sv[:3])
    full = decompose.PCA(6).fit(s)
    assert np.allclose(back(layout.to_long(full.reconstruct(s)), x.shape), x)
    w, h, losses = decompose.nmf(layout.to_series(frame(spark, np.abs(x))), 2, steps=8)
    assert losses[-1] <= losses[0]
    with pytest.raises(ValueError):
        decompose.nmf(layout.to_series(frame(spark, x - 60)), 2)
    comp, mix, n = decompose.fast_ica(s, 2, steps=20)
    assert comp.count() == 6 and mix.shape == (40, 2)


def test_masks_and_atlas(spark, x):
    s = frame(spark, x)
    kept = masks.extract_with_mask(s, spark.createDataFrame([(1,), (4,)], "voxel_id long"))
    assert kept.count() == 80
    full = back(masks.unmask(kept, spark.range(6).withColumnRenamed("id", "voxel_id")), x.shape)
    assert np.allclose(full[:, [1, 4]], x[:, [1, 4]]) and (full[:, [0, 2, 3, 5]] == 0).all()
    tree = spark.createDataFrame([(1, None, "root", "root"), (10, 1, "A", "area"), (20, 10, "B", "belt"), (30, 1, "C", "core")], "id long, parent_id long, acronym string, name string")
    st = tree.join(atlas.with_paths(tree), "id")
    assert sorted(r.id for r in atlas.descendants(st, 10).collect()) == [10, 20]
    assert [r.id for r in atlas.ancestors(st, 20).orderBy("depth").collect()] == [1, 10]
    assert {r.id for r in atlas.search(st, "b", "acronym").collect()} == {20}
    v = spark.createDataFrame([(0, 20, 1), (1, 30, 2), (2, 0, 1)], "voxel_id long, annotation long, hemisphere int")
    assert {(r.voxel_id, r.layer) for r in atlas.region_masks(v, st, [10, 30], "left").collect()} == {(0, "A_L")}
    assert tables.structures_from_json(spark, tables.structures_to_json(st)).count() == 4


def test_validation(spark):
    good = [(d, i, float(i), "mm", 1.0) for d in ("z", "y", "x") for i in range(3)]
    coords = spark.createDataFrame(good, "dim string, idx int, coord double, units string, voxdim double")
    validate.validate_recording(coords)
    with pytest.raises(validate.Invalid):
        validate.validate_recording(coords, require_time=True)
    bad = coords.withColumn("coord", F.when((F.col("dim") == "y") & (F.col("idx") == 1), 5.0).otherwise(F.col("coord")))
    with pytest.raises(validate.Invalid, match="not increasing"):
        validate.validate_recording(bad)
    with pytest.raises(validate.Invalid):
        validate.validate_matching_coordinates(coords, bad)
    assert {r.dim: r.spacing for r in validate.spacings(coords).collect()} == {"z": 1.0, "y": 1.0, "x": 1.0}


def test_files(spark, tmp_path, x):
    v = np.arange(2 * 3 * 4 * 5, dtype=np.float32).reshape(2, 3, 4, 5)
    (tmp_path / "a.nii").write_bytes(volumes.write_nifti(v, (0.4, 0.2, 0.1), 0.5))
    rows = volumes.load(spark, str(tmp_path / "a.nii")).toPandas()
    out = np.zeros_like(v)
    out[rows.t_idx, rows.z_idx, rows.y_idx, rows.x_idx] = rows.value
    assert np.array_equal(out, v)
    assert json.loads(volumes.nifti_meta(spark, str(tmp_path)).first().meta)["step"] == 0.5
    head = lambda n: np.array([n, 144, 6, 4, 3] + [0] * 5, "<i4").tobytes()
    blocks = [np.full((4, 6, 3), n * 100 + 1 + 1j, np.complex64) for n in (1, 2)]
    (tmp_path / "bf0part0.dat").write_bytes(b"".join(head(n + 1) + b.tobytes() for n, b in enumerate(blocks)))
    (tmp_path / "bf0part1.dat").write_bytes(b"")
    d = volumes.load_autc(spark, str(tmp_path))
    assert d.count() == 2 * 4 * 6 * 3 and d.filter("t_idx >= 3 AND value.re <> 201").count() == 0
    (tmp_path / "s.zarr/v").mkdir(parents=True)
    (tmp_path / "s.zarr/v/.zarray").write_text(json.dumps({"shape": [3, 5], "chunks": [2, 4], "dtype": "<f8", "compressor": None, "order": "C", "filters": None}))
    a = np.arange(15.0).reshape(3, 5)
    padded = np.zeros((4, 8))
    padded[:3, :5] = a
    for i in range(2):
        for j in range(2):
            (tmp_path / f"s.zarr/v/{i}.{j}").write_bytes(padded[2 * i : 2 * i + 2, 4 * j : 4 * j + 4].tobytes())
    z = volumes.load(spark, str(tmp_path / "s.zarr"), "v").toPandas()
    got = np.zeros((3, 5))
    got[z.y_idx, z.x_idx] = z.value
    assert np.array_equal(got, a)
    with pytest.raises(ValueError):
        volumes.load(spark, "x.unknown")


def test_event_files(spark, tmp_path):
    p = tmp_path / "e.tsv"
    p.write_text("onset\tduration\ttrial_type\n3\t1\tA\n1\t2\tn/a\n")
    e = tables.load_events(spark, str(p))
    assert {r.trial_type for r in e.collect()} == {"A", "dummy"}
    tables.save_events(e, str(tmp_path / "out"))
    assert [r.onset for r in tables.load_events(spark, str(tmp_path / "out")).orderBy("onset").collect()] == [1.0, 3.0]
    p.write_text("onset\tduration\nx\t1\n")
    with pytest.raises(ValueError):
        tables.load_events(spark, str(p))
    q = tmp_path / "p.tsv"
    q.write_text("1.0\t2.0\n3.0\t4.0\n")
    f = tables.load_physio(spark, str(q), {"Columns": ["pulse", "resp"], "SamplingFrequency": 2.0, "StartTime": -0.5}).orderBy("i").collect()
    assert [r.time for r in f] == [-0.5, 0.0] and f[1].pulse == 3.0


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{i}", 0, float(i), 0.0) for i in range(6)]
    src = spark.createDataFrame(rows, "ts string, voxel_id long, re double, im double").withColumn("ts", F.to_timestamp("ts"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = doppler.power_doppler_stream(stream, "2 seconds", "1 second", "0 seconds").writeStream.format("memory").queryName("pd").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.start.second: r.value for r in spark.table("pd").collect()}
    assert got[1] == pytest.approx((1 + 4) / 2)


def test_consolidated_poses(spark):
    affs = [np.eye(4), np.eye(4)]
    affs[1][2, 3] = 2.0
    s = spark.createDataFrame([(p, z, float(10 * p + z)) for p in (0, 1) for z in (0, 1)], "pose int, z_idx int, value double")
    out, a = spatial.consolidate_poses(s, affs, [0.0, 1.0])
    assert [r.value for r in out.orderBy("z_idx").collect()] == [0.0, 1.0, 10.0, 11.0]
