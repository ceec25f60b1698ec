"""Checks, connectivity of other subjects, transforms, quality control and the atlas object on small inputs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.atlas import Atlas
from voxelweave.operators import decompose, masks, quality_control, spatial, validate, windows
from voxelweave.recording import Recording
from voxelweave.sources import volumes


def coords_of(spark, **dims):
    rows = [(d, i, float(x), "s" if d == "time" else "mm", None) for d, xs in dims.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "dim string, idx int, coord double, units string, voxdim double")


def test_checks_of_recordings(spark):
    c = coords_of(spark, time=[0, 1, 2], z=[0, 1], y=[0, 0.5], x=[2, 2.25, 2.5])
    info = validate.grid_info(c)
    assert info == {"shape": (2, 2, 3), "spacing": (1.0, 0.5, 0.25), "origin": (0.0, 0.0, 2.0), "dims": ("z", "y", "x")}
    with pytest.raises(validate.Invalid, match="spacing"):
        validate.grid_info(coords_of(spark, z=[0], y=[0, 1], x=[0, 1]))
    assert validate.validate_matching_units([c, c]) == {"z": "mm", "y": "mm", "x": "mm"}
    with pytest.raises(validate.Invalid, match="units"):
        validate.validate_matching_units([c, c.withColumn("units", F.lit("um"))])
    s = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "t_idx int, voxel_id long, value double")
    assert {"z_idx", "y_idx", "x_idx"} <= set(validate.ensure_recording(s, c).columns)
    with pytest.raises(validate.Invalid, match="complex"):
        validate.ensure_iq(s, c)
    iq = s.withColumn("value", F.struct(F.col("value").alias("re"), F.lit(0.0).alias("im")))
    assert validate.ensure_iq(iq, c).count() == 2
    with pytest.raises(validate.Invalid, match="series"):
        validate.validate_whole_time(s)
    good = spark.createDataFrame([(0, 0.5), (1, 0.25)], "t_idx int, a double")
    assert validate.validate_confounds(s, good) == ["a"]
    for bad in (good.limit(1), good.union(good), good.withColumn("a", F.lit(float("nan")))):
        with pytest.raises(validate.Invalid):
            validate.validate_confounds(s, bad)
    layers = spark.createDataFrame([("a", 0), ("a", 3), ("b", 1), ("b", 2)], "layer string, region int")
    validate.validate_mask_layers(layers.filter("layer = 'a'"))
    with pytest.raises(validate.Invalid):
        validate.validate_mask_layers(layers)
    assert validate.energy_cutoffs(None, 3) == (0.0, 3.0) and validate.energy_cutoffs(1) == (1.0, float("inf"))
    for low, high in ((-1, 2), (2, 2), (3, 1)):
        with pytest.raises(validate.Invalid):
            validate.energy_cutoffs(low, high)
    targets = spark.createDataFrame([(0, "a"), (1, "b")], "t_idx int, target string")
    validate.validate_targets(targets, s)
    for bad in (targets.limit(1), targets.union(targets), targets.withColumn("target", F.lit(None).cast("string"))):
        with pytest.raises(validate.Invalid):
            validate.validate_targets(bad, s)


def test_window_rules(spark):
    assert windows.acquisition_duration({"volume_acquisition_duration": 0.5}) == 0.5
    with pytest.warns(UserWarning):
        assert windows.acquisition_duration({"compound_sampling_frequency": 500}) == 0.002
    with pytest.warns(UserWarning):
        assert windows.acquisition_duration({}, [0, 2, 4, 9]) == 2.0
    with pytest.raises(ValueError):
        windows.acquisition_duration({})
    assert windows.filter_rate([0, 2, 4], unit=1e-3) == pytest.approx(500) and windows.filter_rate([0, 2, 5], "svd_indices") == pytest.approx(0.4)
    with pytest.raises(ValueError):
        windows.filter_rate([0, 2, 5])
    d = spark.createDataFrame([(1.0,), (1.0,), (1.5,)], "duration double")
    with pytest.warns(UserWarning):
        assert windows.typical_duration(d) == 1.0
    assert windows.filter_label("svd_indices", 2, None) == "svd_indices[2, )" and windows.filter_label("svd_energy", 0.5, 9) == "svd_energy[0.5, 9]" and windows.filter_label(None) == "none"


def test_quality_control(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((40, 4)) + [5, 6, 7, 0]
    x[:, 3] = 0
    t, v = np.indices(x.shape)
    s = spark.createDataFrame(pd.DataFrame({"t_idx": t.ravel(), "voxel_id": v.ravel(), "value": x.ravel()}))
    got, (low, high) = quality_control.carpet(s, standardize=False, most=10)
    p = got.toPandas()
    assert sorted(set(p.t_idx)) == list(range(0, 40, 4)) and sorted(set(p.voxel_id)) == [0, 1, 2]
    mean, sd = x[:, :3].mean(0).mean(), x[:, :3].std(0).mean()
    assert (low, high) == pytest.approx((mean - 2 * sd, mean + 2 * sd))
    assert quality_control.carpet(s, limits=(-1.0, None))[1][0] == -1.0
    assert quality_control.color_limits(s) == pytest.approx(tuple(np.percentile(x, [2, 98]))) and quality_control.color_limits(s, low=0.0)[0] == 0.0
    assert set(quality_control.metrics(s, carpet_=False)) == {"dvars", "tsnr", "cv"}
    times = spark.createDataFrame([(k, 2.0 * k) for k in range(3)], "t_idx int, time double")
    rows = [tuple(r) for r in quality_control.frame_windows(times).orderBy("frame_id").collect()]
    assert rows == [(0, 0, 2), (1, 2, 4), (2, 4, 6)]
    assert [tuple(r) for r in quality_control.frame_windows(times, 1.0, "center").orderBy("frame_id").collect()][0] == (0, -0.5, 0.5)
    c = coords_of(spark, x=[3.0, 1.0, 2.0])
    r = quality_control.sorted_coordinates(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "x_idx int, v string"), c, ("x",))
    assert {(q.x_idx, q.v) for q in r.collect()} == {(2, "a"), (0, "b"), (1, "c")}


def test_connectivity_of_other_subjects(spark):
    rng = np.random.default_rng(1)
    data = {s: rng.standard_normal((60, 4)) @ rng.standard_normal((4, 4)) for s in range(5)}
    frame = lambda ids, n=4: spark.createDataFrame([(s, r, data[s][:, r].tolist()) for s in ids for r in range(n)], "subject long, region int, series array<double>")
    for kind in ("covariance", "correlation", "precision", "partial correlation", "tangent"):
        model = decompose.ConnectivityMatrix(kind).fit(frame([0, 1, 2]))
        own = {r.subject: np.reshape(r.matrix, (4, 4)) for r in model.fit_transform(frame([0, 1, 2])).collect()}
        covs = np.array([decompose.shrunk_covariance(data[s]) for s in range(3)])
        assert np.allclose(model.mean_, decompose.geometric_mean(covs) if kind == "tangent" else np.mean(list(own.values()), 0))
        again = {r.subject: np.reshape(r.matrix, (4, 4)) for r in model.transform(frame([1, 3])).collect()}
        assert set(again) == {1, 3} and np.allclose(again[1], own[1])
        if kind == "tangent":
            back = model.inverse_transform([again[3]])[0]
            assert np.allclose(back, np.reshape(decompose.ConnectivityMatrix("covariance").fit_transform(frame([3])).first().matrix, (4, 4)))
        low = decompose.to_vector(own[0]) if hasattr(decompose, "to_vector") else None
        if low is not None and kind != "tangent":
            assert np.allclose(model.inverse_transform([low])[0], own[0])
        with pytest.raises(Exception, match="regions"):
            model.transform(frame([3], 3)).collect()
    with pytest.raises(ValueError, match="fit"):
        decompose.ConnectivityMatrix().transform(frame([0]))
    with pytest.raises(ValueError, match="two subjects"):
        decompose.ConnectivityMatrix("tangent").fit(frame([0]))
    with pytest.raises(ValueError, match="different regions"):
        decompose.ConnectivityMatrix().fit(frame([0]).union(frame([1], 3)))
    with pytest.raises(ValueError, match="no subjects"):
        decompose.ConnectivityMatrix().fit(frame([0]).limit(0))


def test_transforms_compose(spark):
    grid = ((3, 4, 5), (1.0, 0.5, 0.5), (0.0, 1.0, 2.0))
    a, b = np.eye(4), np.eye(4)
    a[:3, 3], b[0, 3], b[1, 1] = (0.1, 0.2, 0.3), 0.25, 1.1
    assert spatial.composed(a, None, grid) is a and spatial.composed(None, b, grid) is b
    both = spatial.composed(a, b, grid)
    points = spatial.grid_points(*grid)
    assert np.allclose(spatial.pulled(points, both), spatial.pulled(spatial.pulled(points, b), a))
    field = spatial.field_on(b, grid)
    mixed = spatial.composed(a, field, grid, new_grid=grid)
    assert np.allclose(points + mixed.reshape(3, -1).T, spatial.pulled(points, both)) and mixed.shape == (3, 3, 4, 5)
    with pytest.raises(ValueError):
        spatial.pulled(points, field)
    spatial.validate_bspline({"transform_type": "bspline_transform", "order": 3, "direction": np.eye(3)}, np.zeros((3, 4, 4, 4)))
    for meta, control in (({}, np.zeros((3, 4, 4, 4))), ({"transform_type": "bspline_transform"}, np.zeros((3, 4, 4, 4))), ({"transform_type": "bspline_transform", "order": 3, "direction": 0}, np.zeros((4, 4, 4)))):
        with pytest.raises(ValueError):
            spatial.validate_bspline(meta, control)
    main = np.array([a, b])
    poses = {"main": main, "tied": np.array([b @ m for m in main]), "still": 2 * np.eye(4)}
    got = spatial.linked_affines(poses, "main", a)
    assert list(got) == ["main", "tied", "still"] and np.allclose(got["main"], a) and np.allclose(got["tied"], b @ a) and np.array_equal(got["still"], 2 * np.eye(4))
    with pytest.raises(ValueError, match="loose"):
        spatial.linked_affines(poses | {"loose": np.array([a, a])}, "main", np.eye(4))
    assert spatial.with_affines_of({"a": 1, "affines": 2}, {"affines": 3}) == {"a": 1, "affines": 3} and spatial.with_affines_of({"affines": 2}, {}) == {}


def small_atlas(spark):
    shape = (2, 2, 4)
    cells = [(k, *map(int, c), float(k), 20 if c[2] else 10, 1 if c[2] < 2 else 2) for k, c in enumerate(np.ndindex(shape))]
    voxels = spark.createDataFrame(cells, "voxel_id long, z_idx int, y_idx int, x_idx int, reference double, annotation int, hemisphere int")
    structures = spark.createDataFrame([(1, "root", "root", [1]), (10, "A", "area", [1, 10]), (20, "B", "part", [1, 10, 20])], "id long, acronym string, name string, path array<long>")
    meshes = spark.createDataFrame([(20, [0.0, 0.0, 0.0, 0.0, 0.0, 3000.0, 0.0, 1000.0, 0.0, 0.0, 0.0, 90_000.0], [0, 1, 2, 1, 2, 3])], "region long, vertices array<double>, faces array<int>")
    return Atlas(voxels, structures, (shape, (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)), meshes, np.eye(4))


def test_atlas(spark, tmp_path):
    a = small_atlas(spark).validate()
    assert {r.id for r in a.search("a|part").collect()} == {10, 20} and a.id_of("B") == 20 and a.show_tree().split("\n")[2] == "    B (20)"
    assert a.masks(["A"]).count() == 16 and a.masks(["B"], "left").count() == 4 and [r.id for r in a.ancestors("B").collect()] == [1, 10]
    v, f = a.mesh("B")
    assert v.shape == (3, 3) and f.tolist() == [[0, 1, 2]] and a.mesh("B", clip=False)[0].shape == (4, 3) and len(a.mesh("B", "left")[0]) == 2
    with pytest.raises(ValueError):
        a.id_of("C")
    with pytest.raises(validate.Invalid, match="structures"):
        Atlas(a.voxels.withColumn("annotation", F.lit(77)), a.structures, a.grid).validate()
    shift = np.eye(4)
    shift[2, 3] = 1.0
    moved = a.resample(shift, *a.grid)
    rows = {r.voxel_id: r for r in moved.voxels.collect()}
    assert rows[0].reference == 1.0 and rows[0].annotation == 20 and rows[3].annotation == 0 and rows[1].hemisphere == 2 and np.allclose(moved.to_base, shift)
    field = spatial.field_on(shift, a.grid)
    again = a.resample_like(a.grid, field)
    assert {r.voxel_id: r.annotation for r in again.voxels.collect()} == {k: r.annotation for k, r in rows.items()} and again.to_base.shape == (3, 2, 2, 4)
    a.save(str(tmp_path / "atlas"))
    b = Atlas.load(spark, str(tmp_path / "atlas"))
    assert b.grid == a.grid and b.voxels.count() == 16 and np.allclose(b.to_base, np.eye(4)) and len(b.mesh("B")[0]) == 3


def test_sources(spark):
    files = spark.createDataFrame([("participants.tsv",), ("sub-01/ses-1/sub-01_ses-1_bold.nii",), ("sub-02/ses-1/sub-02_ses-1_bold.nii",), ("sub-01/sub-01_scans.tsv",)], "path string")
    got = {r.path for r in masks.filter_files(files, sub="01", ses=["1", "2"], acq=None).collect()}
    assert got == {"participants.tsv", "sub-01/ses-1/sub-01_ses-1_bold.nii", "sub-01/sub-01_scans.tsv"}
    z = np.ones((3, 1, 2, 2)) * (1 + 2j)
    samples, coords, meta = volumes.create_iq(spark, z, 0.5, transmit_frequency=15e6, sound_velocity=1540.0)
    assert samples.count() == 12 and meta["volume_acquisition_reference"] == "start" and Recording(samples, coords, meta).axial_velocity(3, 3, 2.0).samples.count() == 4
    with pytest.raises(ValueError):
        volumes.create_iq(spark, z.real)
    one = spark.createDataFrame([(0, 3.0), (3, 4.0)], "voxel_id long, value double")
    assert volumes.to_array(one, samples.filter("t_idx = 0"), (1, 2, 2), fill=-1.0).tolist() == [[[3.0, -1.0], [-1.0, 4.0]]]
