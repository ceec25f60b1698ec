"""Scans of version 2, written here byte by byte: values, coordinates, metadata, pushed filters, files that are refused."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.sources import scans

TEXTS = ["default", "proj-01", "sub-01", "ses-01", "Rat", "T", "scan-01", "none", "None", "user-01"]
DT, STEP = 0.4, {"lateral_m": 0.00011, "elevation_m": 0.0004, "depth_m": 0.00009856}
ANGLES = [-10.0, -5.0, 0.0, 5.0, 10.0]


def payload(n_time=5, n_pose=1, n_block=1, depth=3, elevation=1, lateral=4):
    shape = (n_time, n_pose, n_block, depth, elevation, lateral)
    return np.arange(math.prod(shape), dtype="<f8").reshape(shape)


def write(path, data, depth_start=None, block=False, name=b"probe-1", broken_depth=False, pose=(0.0007, 0.0026, 0.0, 0.1, -0.2, math.pi / 2), stamp=None, texts=TEXTS, times=None, **patch):
    n_time, n_pose, n_block, depth, elevation, lateral = data.shape
    sizes = dict(lateral=lateral, elevation=elevation, depth=depth, n_time=n_time, n_pose=n_pose, n_block=n_block, payload_bytes=data.nbytes)
    start = 1.0 if depth_start is None else depth_start
    end = start + (99 if broken_depth else (depth - 1) * STEP["depth_m"] * 1e3)
    tail = b""
    if block:
        tail += struct.pack(f"<{n_time}I", *range(n_time)) + struct.pack("<6d", *pose) + struct.pack("<Q", 1) + bytes(8)
        tail += struct.pack("<4d", 15.625, 0.11, 1.5, 8.0) + bytes(16) + struct.pack("<H", len(name)) + name
        tail += struct.pack("<2d", start, end) + struct.pack("<4d", 9.0, 5500.0, 62.5, 1.0) + struct.pack("<I", len(ANGLES)) + struct.pack(f"<{len(ANGLES)}d", *ANGLES)
    elif depth_start is not None:
        tail += struct.pack("<2d", start, end)
    for t in [*texts, "SN-0001".encode().hex().upper(), "HW-1".encode().hex().upper()] if texts else []:
        tail += struct.pack("<I", len(t)) + t.encode()
    tail += b"" if stamp is None else struct.pack("<Q", stamp)
    sizes["header_bytes"] = scans.TIMES_AT + 8 * n_time + len(tail)
    head = bytearray(scans.TIMES_AT)
    head[:4] = b"scan"
    for k, v in (sizes | patch).items():
        struct.pack_into("<Q", head, scans.U64_AT[k], v)
    for k, v in ({"dt": DT} | STEP).items():
        struct.pack_into("<d", head, scans.F64_AT[k], v)
    struct.pack_into("<I", head, 0x9C, 60)
    struct.pack_into("<I", head, 0xA0, 200)
    times = DT * (np.arange(n_time) + 1) if times is None else times
    path.write_bytes(bytes(head) + struct.pack(f"<{n_time}d", *times) + tail + data.tobytes())
    return str(path)


def volume(samples, shape):
    out = np.full(shape, np.nan)
    for r in samples.collect():
        out[r["t_idx"], r["pose"], r["z_idx"], r["y_idx"], r["x_idx"]] = r["value"]
    return out


def expected(data):
    """(volume, pose, elevation, depth, lateral), repeats as volumes."""
    t, p, b, d, e, l = data.shape
    out = np.empty((t * b, p, e, d, l))
    for i in range(t):
        for k in range(b):
            out[i * b + k] = data[i, :, k].transpose(0, 2, 1, 3)
    return out


@pytest.mark.parametrize("sizes", [{}, {"n_pose": 2, "elevation": 2}, {"n_block": 2}, {"n_block": 3, "n_pose": 2, "elevation": 3}, {"depth": 1}])
def test_values(spark, tmp_path, sizes):
    data = payload(**sizes)
    path = write(tmp_path / "a.scan", data)
    want = expected(data)
    for most in (1, 200, scans.TASK_BYTES):
        got = volume(scans.load_scans(spark, path, most), want.shape)
        assert np.array_equal(got, want)


def test_coordinates(spark, tmp_path):
    path = write(tmp_path / "a.scan", payload(elevation=3), depth_start=1.25)
    samples, coords, meta = scans.load_scan(spark, path)
    by = {}
    for r in coords.orderBy("dim", "idx").collect():
        by.setdefault(r["dim"], []).append(r)
    of = lambda d: [r["coord"] for r in by[d]]
    assert np.allclose(of("x"), (np.arange(4) - 1.5) * 0.11) and np.allclose(of("z"), [-0.4, 0, 0.4]) and np.allclose(of("y"), 1.25 + np.arange(3) * 0.09856)
    assert np.allclose(of("time"), DT * np.arange(1, 6)) and {r["units"] for r in by["time"]} == {"s"} and {r["units"] for d in "xyz" for r in by[d]} == {"mm"}
    assert np.allclose([by[d][0]["voxdim"] for d in "xyz"], [0.11, 0.09856, 0.4])
    assert meta["volume_acquisition_reference"] == "end" and np.isclose(meta["volume_acquisition_duration"], DT)
    assert "pose" not in samples.columns and "pose" not in by


@pytest.mark.parametrize("start,depth,first", [(None, 3, 0.0), (None, 1, 0.0), (2.5, 3, 2.5)])
def test_depth_origin(tmp_path, start, depth, first):
    path = write(tmp_path / "a.scan", payload(depth=depth), depth_start=start)
    s = scans.parse_header(path, scans.read_header(path))
    assert s.coordinates()["y"][0][0] == first


def test_times_of_repeats_and_as_stored(tmp_path):
    path = write(tmp_path / "a.scan", payload(n_block=2), times=[1, 2, 3, 4, 5.5])
    assert np.allclose(scans.parse_header(path, scans.read_header(path)).times, DT * np.arange(1, 11))
    path = write(tmp_path / "b.scan", payload(), times=[1, 2, 3, 4, 5.5])
    assert scans.parse_header(path, scans.read_header(path)).times.tolist() == [1, 2, 3, 4, 5.5]


def test_strings_and_modes(spark, tmp_path):
    write(tmp_path / "a.scan", payload(), stamp=1784005200)
    write(tmp_path / "b.scan", payload(n_pose=2), texts=[])
    write(tmp_path / "c.scan", payload(n_time=1, n_pose=2))
    rows = {r["path"][-6:]: r for r in scans.scan_meta(spark, str(tmp_path)).collect()}
    a, b, c = (json.loads(rows[k]["meta"]) for k in ("a.scan", "b.scan", "c.scan"))
    assert [a[k] for k in scans.PLAIN] == TEXTS[:9] and a["experimenter"] == "user-01" and a["device_serial_number"] == "SN-0001" and a["hardware"] == "HW-1"
    assert a["datetime"] == "2026-07-14T05:00:00+00:00" and b["datetime"] == "" and "subject" not in b
    assert (a["mode"], b["mode"], c["mode"]) == ("2d", "4d", "3d") and a["svd_low_cutoff"] == 60 and a["power_doppler_integration_window"] == 200
    assert tuple(rows["b.scan"])[1:6] == (5, 2, 1, 3, 4) and a["affines"] == {}


def test_acquisition(spark, tmp_path):
    path = write(tmp_path / "a.scan", payload(), block=True)
    meta = scans.load_scan(spark, path)[2]
    assert meta["probe_model"] == "probe-1" and meta["probe_center_frequency"] == 15.625 and meta["transmit_frequency"] == 9.0 and meta["probe_pitch"] == 0.11
    assert meta["probe_focal_depth"] == 8.0 and meta["pulse_repetition_frequency"] == 5500.0 and meta["plane_wave_angles"] == ANGLES
    assert np.allclose(meta["imaging_depth"], [1, 1 + 2 * 0.09856])
    cx, sx, cy, sy = math.cos(0.1), math.sin(0.1), math.cos(-0.2), math.sin(-0.2)
    probe = np.eye(4)
    probe[:3, :3] = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    probe[:3, 3] = 0.0007, 0.0026, 0.0
    point = np.array([0.3, 0.5, 0.7, 1])  # elevation, depth, lateral in mm
    lab = probe @ np.array([0.7e-3, 0.3e-3, -0.5e-3, 1])
    assert np.allclose((np.array(meta["affines"]["physical_to_lab"]) @ point)[:3], 1e3 * np.array([lab[1], -lab[2], lab[0]]))


@pytest.mark.parametrize("how", [{"name": bytes([1, 2, 3])}, {"broken_depth": True}])
def test_acquisition_that_is_not_trusted(spark, tmp_path, how):
    meta = scans.load_scan(spark, write(tmp_path / "a.scan", payload(), block=True, **how))[2]
    assert "probe_model" not in meta and meta["affines"] == {} and meta["svd_low_cutoff"] == 60


def test_brain_affine(spark, tmp_path):
    brain = np.array([[0, 1e-3, 0, 2e-3], [1e-3, 0, 0, 1e-3], [0, 0, -1e-3, 0], [0, 0, 0, 1]])
    path = write(tmp_path / "a.scan", payload(), block=True)
    meta = scans.load_scan(spark, path, brain)[2]
    lab, to_brain = (np.array(meta["affines"][k]) for k in ("physical_to_lab", "physical_to_brain"))
    point = np.array([1.0, 2.0, 3.0, 1.0])
    metres = (lab @ point)[[2, 0, 1]] * [1e-3, 1e-3, -1e-3]  # (z, y, x) in mm as (x, y, z) in metres
    assert np.allclose(brain @ (to_brain @ point), [*metres, 1])
    bad = write(tmp_path / "b.scan", payload(), block=True, pose=(5.0, 0, 0, 0, 0, 0))
    assert scans.load_scan(spark, bad)[2]["affines"] == {}
    with pytest.raises(scans.ScanError, match="no pose"):
        scans.load_scan(spark, bad, brain)


@pytest.mark.parametrize("patch,says", [({"payload_bytes": 12345}, "sizes make"), ({"n_time": 10_000_000}, "can't hold"), ({"lateral": 0}, "positive"), ({"n_pose": 0}, "positive")])
def test_refused(tmp_path, patch, says):
    path = write(tmp_path / "a.scan", payload(), **patch)
    with pytest.raises(scans.ScanError, match=says):
        scans.parse_header(path, scans.read_header(path))


def test_not_a_scan(spark, tmp_path):
    (tmp_path / "a.scan").write_bytes(b"XXXX not one")
    with pytest.raises(scans.ScanError, match="doesn't begin"):
        scans.read_header(str(tmp_path / "a.scan"))
    (tmp_path / "b.scan").write_bytes(b"\x89HDF\r\n\x1a\n" + bytes(500))
    with pytest.raises(scans.ScanError, match="HDF5"):
        scans.read_header(str(tmp_path / "b.scan"))
    empty = tmp_path / "none"
    empty.mkdir()
    assert scans.load_scans(spark, str(empty)).count() == 0


def test_a_file_that_ends_early(spark, tmp_path):
    path = write(tmp_path / "a.scan", payload())
    with open(path, "r+b") as f:
        f.truncate((tmp_path / "a.scan").stat().st_size - 8)
    with pytest.raises(Exception, match="ends inside a frame"):
        scans.load_scans(spark, path).count()


def test_filters_choose_the_bytes(spark, tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan

    data = payload(n_time=40, n_pose=2)
    path = write(tmp_path / "a.scan", data)
    reader = scans.ScanReader(path, 1 << 20)
    every = sum(len(p.t_idx) for p in reader.partitions())
    left = list(reader.pushFilters([GreaterThanOrEqual(("time",), 4.0), LessThan(("time",), 6.0), In(("pose",), (1,)), LessThan(("x_idx",), 2)]))
    assert [f.attribute for f in left] == [("x_idx",)]
    assert every == 80 and sum(len(p.t_idx) for p in reader.partitions()) == 5
    rows = scans.load_scans(spark, path)
    some = rows.filter((F.col("time") >= 4.0) & (F.col("time") < 6.0) & (F.col("pose") == 1) & (F.col("x_idx") < 2))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(x_idx" in plan.replace("Filter ((isnotnull", "Filter (isnotnull") or "x_idx" in plan
    t = DT * (np.arange(40) + 1)
    assert some.count() == ((t >= 4.0) & (t < 6.0)).sum() * 3 * 2
    assert rows.filter("t_idx in (3, 9)").agg(F.sum("value")).first()[0] == data[[3, 9]].sum()
    assert rows.filter(F.col("path") == "elsewhere").count() == 0


def test_files_of_different_sizes(spark, tmp_path):
    a, b = payload(), payload(n_time=2, lateral=7)
    (tmp_path / "deep").mkdir()
    write(tmp_path / "a.scan", a)
    write(tmp_path / "deep" / "b.scan", b)
    got = {r["path"][-6:]: r["s"] for r in scans.load_scans(spark, str(tmp_path)).groupBy("path").agg(F.sum("value").alias("s")).collect()}
    assert got == {"a.scan": a.sum(), "b.scan": b.sum()}
    assert scans.load_scans(spark, str(tmp_path / "*.scan")).agg(F.sum("value")).first()[0] == a.sum()
