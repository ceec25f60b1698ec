"""Zarr stores and NIfTI images as sinks: what is written is decoded here by hand, and read back by the library."""

import gzip
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.recording import Recording
from voxelweave.sources import files, images, sinks, volumes


def cube(*shape, kind=float):
    data = np.arange(np.prod(shape), dtype=float).reshape(shape) / 3
    return data + 1j * data[::-1] if kind is complex else data


def zarr_by_hand(path, name):
    meta = json.load(open(f"{path}/{name}/.zarray"))
    out = np.full(meta["shape"], np.nan, meta["dtype"])
    for file in os.listdir(f"{path}/{name}"):
        if file[0] == ".":
            continue
        raw = open(f"{path}/{name}/{file}", "rb").read()
        raw = zlib.decompress(raw) if meta["compressor"] and meta["compressor"]["id"] == "zlib" else gzip.decompress(raw) if meta["compressor"] else raw
        part = np.frombuffer(raw, meta["dtype"]).reshape(meta["chunks"])
        at = tuple(slice(int(k) * c, (int(k) + 1) * c) for k, c in zip(file.split("."), meta["chunks"]))
        out[at] = part[tuple(slice(0, s) for s in out[at].shape)]
    return out, meta


def back(samples, shape, kind=float):
    out = np.full(shape, np.nan, kind)
    for r in samples.collect():
        v = r["value"]
        out[r["t_idx"], r["z_idx"], r["y_idx"], r["x_idx"]] = complex(v["re"], v["im"]) if kind is complex else v
    return out


def stages(folder):
    return [f for f in os.listdir(folder) if "stage" in f]


@pytest.mark.parametrize("codec", ["zlib", "gzip", None])
@pytest.mark.parametrize("chunks", [None, (2, 1, 2, 3), (7, 2, 3, 5)])
def test_zarr_round_trip(spark, tmp_path, codec, chunks):
    data = cube(7, 2, 3, 5)
    samples, coords = volumes.create_recording(spark, data, 0.5, (0.4, 0.1, 0.2), (1, 2, 3))
    path = str(tmp_path / "a.zarr")
    sinks.save_zarr(samples, path, "power", coords, {"rate": np.float64(2), "affines": {"x": np.eye(2)}}, chunks=chunks, codec=codec)
    got, meta = zarr_by_hand(path, "power")
    assert np.array_equal(got, data) and meta["zarr_format"] == 2 and meta["shape"] == [7, 2, 3, 5]
    assert np.array_equal(back(files.load(spark, path), data.shape), data) and files.variables(spark, path) == ["power"]
    assert np.allclose(zarr_by_hand(path, "time")[0], 0.5 * np.arange(7)) and np.allclose(zarr_by_hand(path, "y")[0], 2 + 0.1 * np.arange(3))
    attrs = json.load(open(f"{path}/power/.zattrs"))
    assert attrs == {"_ARRAY_DIMENSIONS": ["time", "z", "y", "x"], "rate": 2.0, "affines": {"x": [[1, 0], [0, 1]]}}
    assert json.load(open(f"{path}/x/.zattrs")) == {"_ARRAY_DIMENSIONS": ["x"], "long_name": "Lateral", "units": "mm", "voxdim": 0.2}
    whole = json.load(open(f"{path}/.zmetadata"))["metadata"]
    assert whole["power/.zarray"] == meta and whole["z/.zattrs"]["units"] == "mm" and not stages(tmp_path)


def test_zarr_complex_fill_and_nulls(spark, tmp_path):
    data = cube(4, 1, 2, 3, kind=complex)
    samples, coords = volumes.create_recording(spark, data)
    path = str(tmp_path / "iq.zarr")
    holes = samples.filter("not (t_idx = 1 and x_idx = 2) and t_idx <> 3")
    sinks.save_zarr(holes, path, "iq", shape=(4, 1, 2, 3), chunks=(1, 1, 2, 3), fill=-1.0)
    got, meta = zarr_by_hand(path, "iq")
    want = data.astype(np.complex64)
    want[1, ..., 2], want[3] = -1, -1
    assert meta["dtype"] == "<c8" and np.array_equal(got, want) and meta["fill_value"] == [-1.0, 0.0]
    assert np.array_equal(back(files.load(spark, path, complex_as="parts"), data.shape, complex), want)
    assert np.allclose(back(files.load(spark, path, complex_as="magnitude"), data.shape), abs(want))
    with pytest.raises(ValueError, match="complex"):
        files.load(spark, path)
    real = samples.select("t_idx", "z_idx", "y_idx", "x_idx", F.when(F.col("x_idx") != 1, F.col("value.re")).alias("value"))
    sinks.save_zarr(real, str(tmp_path / "n.zarr"), shape=(4, 1, 2, 3), fill=float("nan"))
    got, meta = zarr_by_hand(str(tmp_path / "n.zarr"), "data")
    assert np.isnan(got[..., 1]).all() and np.array_equal(got[..., [0, 2]], data.real[..., [0, 2]]) and meta["fill_value"] == "NaN"


def test_zarr_overwrite(spark, tmp_path):
    path = str(tmp_path / "a.zarr")
    first, _ = volumes.create_recording(spark, cube(4, 1, 2, 2))
    sinks.save_zarr(first, path)
    with pytest.raises(FileExistsError):
        sinks.save_zarr(first, path)
    second, _ = volumes.create_recording(spark, cube(2, 1, 2, 2) + 7)
    sinks.save_zarr(second, path, overwrite=True)
    assert np.array_equal(zarr_by_hand(path, "data")[0], cube(2, 1, 2, 2) + 7) and not stages(tmp_path)


@pytest.mark.parametrize("fault", ["outside", "twice", "task"])
def test_a_job_that_fails_leaves_no_store(spark, tmp_path, fault):
    path = str(tmp_path / "a.zarr")
    good, _ = volumes.create_recording(spark, cube(6, 1, 2, 2))
    sinks.save_zarr(good.withColumn("value", F.lit(5.0)), path)
    bad = {
        "outside": good.withColumn("t_idx", F.when(F.col("t_idx") == 5, 9).otherwise(F.col("t_idx"))),
        "twice": good.unionByName(good.filter("t_idx = 3 and x_idx = 1")),
        "task": good.withColumn("value", F.when((F.col("t_idx") == 5) & (F.rand() >= 0), F.raise_error(F.lit("killed")).cast("double")).otherwise(F.col("value"))),
    }[fault]
    for target, how in ((str(tmp_path / "new.zarr"), {}), (path, {"overwrite": True})):
        with pytest.raises(Exception, match="outside|same indices|killed"):
            sinks.save_zarr(bad, target, shape=(6, 1, 2, 2), chunks=(1, 1, 2, 2), **how)
    assert not os.path.exists(tmp_path / "new.zarr") and not stages(tmp_path)
    assert (zarr_by_hand(path, "data")[0] == 5).all()  # the old store as it was


def test_axes_must_fit(spark, tmp_path):
    samples, coords = volumes.create_recording(spark, cube(4, 1, 2, 2))
    with pytest.raises(ValueError, match="coordinates of time"):
        sinks.save_zarr(samples, str(tmp_path / "a.zarr"), coords=coords.filter("dim <> 'time' or idx < 3"))
    with pytest.raises(ValueError, match="no samples"):
        sinks.save_zarr(samples.limit(0), str(tmp_path / "a.zarr"))


def autc(folder, n_blocks=4, frames=3, n_z=6, n_x=4):
    data = {}
    for b in range(n_blocks):
        block = np.zeros((n_x, n_z, frames), np.complex64)
        for f in range(frames):
            block[:, :, f] = (100 * b + f + 1) * (1 + 1j)
        data[b] = block
        head = np.array([b + 1, block.size, n_z, n_x, frames, 0, 0, 0, 0, 0], "<i4")
        with open(folder / f"bf00part{b // 2:03d}.dat", "ab") as file:
            file.write(head.tobytes() + block.tobytes())
    return data


def test_blocks_to_zarr(spark, tmp_path):
    autc(tmp_path)
    path = str(tmp_path / "out.zarr")
    lateral, axial = np.linspace(-10, 10, 4).tolist(), np.linspace(0, 20, 6).tolist()
    how = dict(lateral=lateral, axial=axial, sampling_frequency=500.0, repetition_frequency=1500.0, angles=[-15.0, 0.0, 15.0], transmit_frequency=3e6, beamforming_method="Fourier")
    sinks.convert_blocks(volumes.load_autc(spark, str(tmp_path)), path, 3, block_times=[1.0, 3.0, 5.0, 7.0], **how)
    iq, meta = zarr_by_hand(path, "iq")
    assert iq.shape == (12, 1, 6, 4) and iq.dtype == np.complex64 and iq[0, 0, 0, 0] == 1 + 1j and iq[3, 0, 0, 0] == 101 + 101j and (iq[11] == 303 + 303j).all()
    assert np.allclose(zarr_by_hand(path, "time")[0], [b + f / 500 for b in (1, 3, 5, 7) for f in range(3)])
    assert np.allclose(zarr_by_hand(path, "x")[0], lateral) and np.allclose(zarr_by_hand(path, "y")[0], axial) and zarr_by_hand(path, "z")[0].tolist() == [0.0]
    axis = {d: json.load(open(f"{path}/{d}/.zattrs")) for d in ("time", "z", "y", "x")}
    assert [axis[d]["long_name"] for d in axis] == ["Time", "Elevation", "Depth", "Lateral"] and [axis[d]["units"] for d in axis] == ["s", "mm", "mm", "mm"]
    assert axis["time"]["volume_acquisition_reference"] == "start" and np.isclose(axis["time"]["volume_acquisition_duration"], 3 / 1500)
    assert np.allclose([axis[d]["voxdim"] for d in "zyx"], [0.4, 4.0, 20 / 3])
    attrs = json.load(open(f"{path}/iq/.zattrs"))
    assert attrs["plane_wave_angles"] == [-15.0, 0.0, 15.0] and attrs["transmit_frequency"] == 3e6 and attrs["beamforming_method"] == "Fourier" and attrs["compound_sampling_frequency"] == 500.0


def test_blocks_skipped_and_other_chunks(spark, tmp_path):
    autc(tmp_path)
    samples, path = volumes.load_autc(spark, str(tmp_path)), str(tmp_path / "out.zarr")
    sinks.convert_blocks(samples, path, 3, skip_first=1, skip_last=1, sampling_frequency=500.0, frames_per_chunk=4)
    iq, meta = zarr_by_hand(path, "iq")
    assert meta["chunks"] == [4, 1, 6, 4] and iq[:, 0, 0, 0].real.tolist() == [101, 102, 103, 201, 202, 203]
    assert np.allclose(zarr_by_hand(path, "time")[0], (3 + np.arange(6)) / 500)
    sinks.convert_blocks(samples, path, 3, overwrite=True)
    assert zarr_by_hand(path, "time")[0].tolist() == list(range(12)) and json.load(open(f"{path}/x/.zattrs"))["voxdim"] == 0.0
    with pytest.raises(ValueError, match="sampling frequency"):
        sinks.convert_blocks(samples, path, 3, block_times=[1.0] * 4, overwrite=True)
    with pytest.raises(ValueError, match="3 times for 4 blocks"):
        sinks.convert_blocks(samples, path, 3, block_times=[1.0] * 3, sampling_frequency=1.0, overwrite=True)
    with pytest.raises(ValueError, match="no block is left"):
        sinks.convert_blocks(samples, path, 3, skip_first=4, overwrite=True)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("suffix", [".nii", ".nii.gz"])
@pytest.mark.parametrize("dtype", [None, "<f4", "<i2"])
def test_nifti_round_trip(spark, tmp_path, version, suffix, dtype):
    data = np.round(cube(5, 2, 3, 4) * 3)
    samples, coords = volumes.create_recording(spark, data, 0.5, (0.4, 0.1, 0.2), (1, 2, 3))
    path = str(tmp_path / f"a{suffix}")
    images.save_nifti(samples, path, coords, {"task_name": "rest"}, version=version, dtype=dtype)
    raw = open(path, "rb").read()
    raw = gzip.decompress(raw) if suffix.endswith("gz") else raw
    assert struct.unpack_from("<i", raw)[0] == (348 if version == 1 else 540)
    kind = np.dtype(dtype or "<f8")
    at = 352 if version == 1 else 544
    assert len(raw) == at + data.size * kind.itemsize and np.array_equal(np.frombuffer(raw, kind, offset=at).reshape(data.shape), data)
    got, where, meta, slices = images.load_image(spark, path)
    assert np.array_equal(back(got, data.shape), data) and slices is None
    key = lambda d: sorted((r["dim"], r["idx"], round(r["coord"], 5), r["units"]) for r in d.collect())
    assert key(where) == key(coords)
    side = json.load(open(tmp_path / "a.json"))
    assert side["RepetitionTime"] == 0.5 and "VolumeTiming" not in side and not stages(tmp_path)
    assert meta["qform_code"] == 1 and "sform_code" not in meta and np.allclose(meta["affines"]["physical_to_qform"], np.eye(4), atol=1e-6)
    assert meta["task_name"] == "rest"


def test_nifti_affines_and_codes(spark, tmp_path):
    samples, coords = volumes.create_recording(spark, cube(2, 2, 3, 4), 1.0, (0.4, 0.1, 0.2), (1, 2, 3))
    c, s = np.cos(0.3), np.sin(0.3)
    turn = np.array([[1, 0, 0, 5], [0, c, -s, -2], [0, s, c, 1], [0, 0, 0, 1.0]])
    shear = turn @ np.array([[1, 0.2, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
    meta = {"affines": {"physical_to_qform": turn, "physical_to_sform": shear, "physical_to_lab": 2 * np.eye(4)}, "qform_code": 3, "sform_code": 4}
    path = str(tmp_path / "a.nii")
    images.save_nifti(samples, path, coords, meta, version=2)
    head = volumes.image_head(path)
    grid = np.diag([0.2, 0.1, 0.4, 1])
    grid[:3, 3] = 3, 2, 1
    swap = lambda a: a[[2, 1, 0, 3]][:, [2, 1, 0, 3]]
    assert (head["qform_code"], head["sform_code"]) == (3, 4)
    assert np.allclose(head["affines"]["qform"], swap(turn) @ grid) and np.allclose(head["affines"]["sform"], swap(shear) @ grid)
    _, where, back_meta, _ = images.load_image(spark, path)
    # places times the affine come back as the same points of the world, whatever is chosen as the places
    at = {r["dim"]: r["coord"] for r in where.filter("idx = 1").collect()}
    world = np.array(back_meta["affines"]["physical_to_sform"]) @ [at["z"], at["y"], at["x"], 1]
    assert np.allclose(world, shear @ [1.4, 2.1, 3.2, 1])
    assert back_meta["affines"]["physical_to_lab"] == (2 * np.eye(4)).tolist()
    images.save_nifti(samples, path, coords, {"affines": {"other": turn}}, sform="other", qform_code=2, sform_code=0)
    head = volumes.image_head(path)
    assert (head["qform_code"], head["sform_code"]) == (2, 0)
    with pytest.raises(ValueError, match="no affine 'nothing'"):
        images.save_nifti(samples, path, coords, {}, sform="nothing")
    with pytest.raises(ValueError, match="needs an affine"):
        images.save_nifti(samples, path, coords, {}, sform_code=1)


def test_nifti_times(spark, tmp_path):
    data = cube(4, 1, 2, 2)
    samples, coords = volumes.create_recording(spark, data)
    uneven = coords.withColumn("coord", F.when(F.col("dim") == "time", F.col("coord") ** 2 + 1).otherwise(F.col("coord")))
    path = str(tmp_path / "a.nii.gz")
    images.save_nifti(samples, path, uneven, time_meta={"volume_acquisition_reference": "end", "volume_acquisition_duration": 0.25})
    side = json.load(open(tmp_path / "a.json"))
    assert side["VolumeTiming"] == [0.75, 1.75, 4.75, 9.75] and side["FrameAcquisitionDuration"] == 0.25 and volumes.image_head(path)["step"] == 0
    _, where, meta, _ = images.load_image(spark, path)
    assert [r["coord"] for r in where.filter("dim = 'time'").orderBy("idx").collect()] == [0.75, 1.75, 4.75, 9.75] and meta["volume_acquisition_duration"] == 0.25
    late = coords.withColumn("coord", F.when(F.col("dim") == "time", F.col("coord") * 500 + 3000).otherwise(F.col("coord")))
    images.save_nifti(samples, path, late, time_meta={"units": "ms", "volume_acquisition_duration": 200})
    side = json.load(open(tmp_path / "a.json"))
    assert np.isclose(side["RepetitionTime"], 0.5) and np.isclose(side["DelayAfterTrigger"], 3.0) and np.isclose(side["DelayTime"], 0.3)
    _, where, meta, _ = images.load_image(spark, path)
    assert np.allclose([r["coord"] for r in where.filter("dim = 'time'").orderBy("idx").collect()], [3, 3.5, 4, 4.5]) and np.isclose(meta["volume_acquisition_duration"], 0.2)


def test_nifti_slice_times(spark, tmp_path):
    samples, coords = volumes.create_recording(spark, cube(2, 3, 1, 2), 2.0)
    path = str(tmp_path / "a.nii")
    images.save_nifti(samples, path, coords)
    side = json.load(open(tmp_path / "a.json")) | {"SliceTiming": [0, 0.5, 1.0], "SliceEncodingDirection": "k-"}
    json.dump(side, open(tmp_path / "a.json", "w"))
    slices = images.load_image(spark, path)[3]
    assert sorted(tuple(r) for r in slices.collect()) == [(0, 0, 1.0), (0, 1, 0.5), (0, 2, 0.0), (1, 0, 3.0), (1, 1, 2.5), (1, 2, 2.0)]


def test_nifti_refused(spark, tmp_path):
    samples, coords = volumes.create_recording(spark, cube(2, 1, 2, 3))
    path = str(tmp_path / "a.nii")
    with pytest.raises(ValueError, match="doesn't end"):
        images.save_nifti(samples, str(tmp_path / "a.img"), coords)
    with pytest.raises(ValueError, match="32767"):
        images.image_header((40000, 1, 1), "f8", (1, 1, 1), 0, np.eye(4), None, 1, 0, 1)
    uneven = coords.withColumn("coord", F.when(F.col("dim") == "x", F.col("idx") ** 2).otherwise(F.col("coord")))
    with pytest.raises(ValueError, match="evenly"):
        images.save_nifti(samples, path, uneven)
    mixed = coords.withColumn("units", F.when(F.col("dim") == "x", F.lit("m")).otherwise(F.col("units")))
    with pytest.raises(ValueError, match="one unit"):
        images.save_nifti(samples, path, mixed)
    with pytest.raises(Exception, match="outside"):
        images.save_nifti(samples, path, shape=(1, 1, 2, 3))
    assert not os.path.exists(path) and not stages(tmp_path)


def test_quaternions():
    rng = np.random.default_rng(0)
    for _ in range(50):
        q, r = np.linalg.qr(rng.normal(size=(3, 3)))
        q = q * np.sign(np.linalg.det(q))
        a, b, c, d = images.quaternion(q)
        again = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        assert a >= 0 and np.allclose(again, q)


def test_images_are_read_by_ranges(spark, tmp_path):
    data = cube(9, 2, 3, 4)
    samples, coords = volumes.create_recording(spark, data)
    images.save_nifti(samples, str(tmp_path / "a.nii"), coords)
    frame = 8 * 24
    assert np.array_equal(back(volumes.load_nifti(spark, str(tmp_path), task_bytes=2 * frame), data.shape), data)
    with open(tmp_path / "a.nii", "r+b") as f:
        f.truncate(352 + 9 * frame - 8)
    with pytest.raises(Exception, match="ends inside a frame"):
        volumes.load_nifti(spark, str(tmp_path)).count()


def test_recording_saves_by_suffix(spark, tmp_path):
    data = cube(3, 1, 2, 2)
    r = Recording.create(spark, data, 0.5, rate=3)
    for name in ("a.zarr", "a.nii.gz", "a.nii", "plain"):
        r.save(str(tmp_path / name))
        assert np.array_equal(back(files.load(spark, str(tmp_path / name)), data.shape), data)
    with pytest.raises(ValueError, match="nothing writes"):
        r.save(str(tmp_path / "a.mat"))


def test_mirrored_images(spark, tmp_path):
    samples, coords = volumes.create_recording(spark, cube(1, 2, 3, 4))
    path = str(tmp_path / "a.nii")
    mirror = np.diag([1.0, 1.0, -1.0, 1.0])  # x of places to -x of the world
    images.save_nifti(samples, path, coords, {"affines": {"physical_to_qform": mirror}})
    assert np.allclose(volumes.image_head(path)["affines"]["qform"], np.diag([-1, 1, 1, 1]))
    _, where, meta, _ = images.load_image(spark, path)
    at = {r["dim"]: r["coord"] for r in where.filter("idx = 1").collect()}
    assert np.allclose(np.array(meta["affines"]["physical_to_qform"]) @ [at["z"], at["y"], at["x"], 1], [1, 1, -1, 1])
