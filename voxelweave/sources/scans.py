"""Binary scanner files of version 2 as a data source: one frame is one range of bytes, and filters choose the ranges.

A file is a header and float64 frames in the order (time, pose, block repeat), each (depth, elevation, lateral). A row of
the source is a voxel of a frame; path, t_idx, time and pose are the same for a whole frame, so filters on them are
answered from the header alone and frames that they exclude are never read.
"""

from __future__ import annotations

import fnmatch
import json
import math
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .volumes import read_range

FORMAT = "voxel_scan"
ROWS = "path string, t_idx long, pose int, z_idx int, y_idx int, x_idx int, time double, value double"
#: Bytes of frames that a task reads, if a frame isn't larger.
TASK_BYTES = 64 << 20

#: Fixed values of the format: the file's first bytes, and where its numbers stand.
MAGIC = b"scan"
U64_AT = {"header_bytes": 0x20, "payload_bytes": 0x28, "lateral": 0x5C, "elevation": 0x64, "depth": 0x6C, "n_time": 0x74, "n_pose": 0x7C, "n_block": 0x84}
F64_AT = {"dt": 0x94, "lateral_m": 0xA4, "elevation_m": 0xAC, "depth_m": 0xB4}
U32_AT = {"svd_low_cutoff": 0x9C, "power_doppler_integration_window": 0xA0}
TIMES_AT = 0xD4
#: Names of the plain strings in their order; the last plain one before two hex strings is the experimenter.
PLAIN = ["sequence", "project", "subject", "session", "species", "unknown1", "scan", "unknown2", "unknown3"]
#: From (elevation, depth, lateral) to the probe's (lateral, elevation, -depth).
TO_PROBE = np.array([[0, 0, 1, 0], [1, 0, 0, 0], [0, -1, 0, 0], [0, 0, 0, 1]], float)

_PREFIX = re.compile(rb"(?:[\x01-\xff]\0|\0\x01)\0\0", re.DOTALL)
_PRINTABLE = re.compile(rb"[\x20-\x7e]+")


class ScanError(ValueError):
    """A file that isn't a scan, or whose header contradicts itself."""


def list_files(path: str) -> list[str]:
    """A file, or the files of a folder or pattern that end in .scan, in order of their names."""
    if "://" in path:
        from pyarrow import fs

        base, _, last = path.rpartition("/")
        system, place = fs.FileSystem.from_uri(base if any(c in last for c in "*?[") else path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.File:
            return [path]
        scheme = path.split("://", 1)[0]
        wanted = last if any(c in last for c in "*?[") else "*.scan"
        found = system.get_file_info(fs.FileSelector(place, recursive=True))
        return sorted(f"{scheme}://{f.path.lstrip('/')}" if scheme != "file" else f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, wanted))
    path = "/" + path.removeprefix("file:").lstrip("/")
    if os.path.isfile(path):
        return [path]
    import glob

    return sorted(glob.glob(f"{path}/**/*.scan", recursive=True) if os.path.isdir(path) else glob.glob(path))


def read_header(path: str) -> bytes:
    """The whole header of a file; what isn't one raises ScanError."""
    head = read_range(path, 0, TIMES_AT)
    if head[: len(MAGIC)] != MAGIC:
        kind = " (HDF5 files of version 1 aren't read here)" if head[:4] == b"\x89HDF" else ""
        raise ScanError(f"{path} doesn't begin as a scan of version 2{kind}")
    if len(head) < TIMES_AT:
        raise ScanError(f"{path} is shorter than a header")
    return read_range(path, 0, struct.unpack_from("<Q", head, U64_AT["header_bytes"])[0])


def _records(header: bytes, start: int) -> list[tuple[str, bool, int]]:
    """Text, whether it stood as hex, and the byte after it, of each string with its length before it."""
    out, at = [], start
    while found := _PREFIX.search(header, at):
        begin = found.end()
        size = int.from_bytes(found.group(), "little")
        body = _PRINTABLE.fullmatch(header, begin, begin + size) if size <= 256 and begin + size <= len(header) else None
        if body is None:
            at = found.start() + 1
            continue
        text, at = body.group().decode("ascii"), body.end()
        raw = bytes.fromhex(text) if re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", text) else b""
        is_hex = bool(_PRINTABLE.fullmatch(raw))
        out.append((raw.decode("ascii") if is_hex else text, is_hex, at))
    return out


def _at_every_byte(data: bytes, kind: str) -> np.ndarray:
    """The eight-byte number that begins at each byte."""
    if len(data) < 8:
        return np.zeros(0, kind)
    return np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8), (len(data) - 7, 8), (1, 1)).copy().view(kind)[:, 0]


def _depth_range(header: bytes, span: float, step: float) -> tuple[int, float] | None:
    """Where a pair of depths (mm) stands that are as far apart as the voxels say, and its first number."""
    if span <= 0:
        return None
    with np.errstate(all="ignore"):
        first = _at_every_byte(header, "<f8")
        a, b = first[:-8], first[8:]
        fits = np.flatnonzero((a > 0) & (a < b) & (b < 100) & (np.abs(b - a - span) < max(0.1, step)))
    return (int(fits[0]), float(a[fits[0]])) if len(fits) else None


def _pose_affine(header: bytes, at: int) -> np.ndarray | None:
    """From (elevation, depth, lateral) to the laboratory in mm, by a pose of metres and radians; None if it can't be one."""
    pose = np.array(struct.unpack_from("<6d", header, at))
    if not np.isfinite(pose).all() or (np.abs(pose[:3]) >= 1).any() or (np.abs(pose[3:]) > 2 * math.pi).any():
        return None
    probe = np.eye(4)
    for axis, angle in enumerate(pose[3:]):  # about x, then y, then z
        i, j = (axis + 1) % 3, (axis + 2) % 3
        turn = np.eye(4)
        turn[i, i] = turn[j, j] = math.cos(angle)
        turn[i, j], turn[j, i] = -math.sin(angle), math.sin(angle)
        probe = turn @ probe
    probe[:3, 3] = pose[:3]
    out = TO_PROBE.T @ probe @ TO_PROBE
    out[:3, 3] *= 1e3
    return out


@dataclass
class Scan:
    """What a header says."""

    path: str
    sizes: dict[str, int]
    numbers: dict[str, float]
    stored_times: np.ndarray
    depth_start: float
    meta: dict = field(default_factory=dict)

    @property
    def shape(self) -> tuple[int, int, int]:
        """Elevation, depth, lateral: z, y, x."""
        return self.sizes["elevation"], self.sizes["depth"], self.sizes["lateral"]

    @property
    def n_volumes(self) -> int:
        return self.sizes["n_time"] * self.sizes["n_block"]

    @property
    def frame_bytes(self) -> int:
        return 8 * math.prod(self.shape)

    @property
    def times(self) -> np.ndarray:
        """Ends of the volumes: as stored, or every dt where repeats make more volumes than times."""
        return self.stored_times if len(self.stored_times) == self.n_volumes else self.numbers["dt"] * (np.arange(self.n_volumes) + 1)

    def frames(self) -> tuple[np.ndarray, np.ndarray]:
        """t_idx and pose of each frame, in the order of the bytes."""
        t, pose, block = (i.ravel() for i in np.indices([self.sizes[k] for k in ("n_time", "n_pose", "n_block")]))
        return t * self.sizes["n_block"] + block, pose

    def coordinates(self) -> dict[str, tuple[np.ndarray, float]]:
        """Values (mm) and voxel size of each spatial axis: two centred on zero, the depth from where it starts."""
        steps = [1e3 * self.numbers[k] for k in ("elevation_m", "depth_m", "lateral_m")]
        centred = [(np.arange(n) - (n - 1) / 2) * s for n, s in zip(self.shape, steps)]
        centred[1] = self.depth_start + np.arange(self.shape[1]) * steps[1]
        return {d: (v, s) for d, v, s in zip("zyx", centred, steps)}


def parse_header(path: str, header: bytes) -> Scan:
    """All that a header says; numbers that can't be right raise ScanError."""
    if len(header) < TIMES_AT:
        raise ScanError(f"{path} is shorter than a header")
    sizes = {k: struct.unpack_from("<Q", header, at)[0] for k, at in U64_AT.items()}
    times_end = TIMES_AT + 8 * sizes["n_time"]
    if sizes["n_time"] < 1 or times_end > len(header):
        raise ScanError(f"{path} says {sizes['n_time']} times, which its header of {len(header)} bytes can't hold")
    for k in ("lateral", "elevation", "depth", "n_pose", "n_block"):
        if sizes[k] < 1:
            raise ScanError(f"{path} says {k} = {sizes[k]}, which must be positive")
    numbers = {k: struct.unpack_from("<d", header, at)[0] for k, at in F64_AT.items()}
    expected = 8 * math.prod(sizes[k] for k in ("lateral", "elevation", "depth", "n_time", "n_pose", "n_block"))
    if sizes["payload_bytes"] != expected:
        raise ScanError(f"{path} says {sizes['payload_bytes']} bytes of frames, but its sizes make {expected}")
    step = numbers["depth_m"] * 1e3
    found = _depth_range(header, (sizes["depth"] - 1) * step if step > 0 else 0, step)
    scan = Scan(path, sizes, numbers, np.frombuffer(header, "<f8", sizes["n_time"], TIMES_AT).copy(), found[1] if found else 0.0)
    records = _records(header, times_end)
    plain = [r for r in records if not r[1]]
    mode = "2d" if sizes["n_pose"] == 1 else "4d" if scan.n_volumes > 1 else "3d"
    meta: dict = {"format": "v2", "mode": mode, "affines": {}}
    meta |= {k: r[0] for k, r in zip(PLAIN, plain)}
    coded = [i for i, r in enumerate(records) if r[1]]
    if len(coded) > 1:
        meta |= {"device_serial_number": records[coded[-2]][0], "hardware": records[coded[-1]][0]}
        before = [r[0] for r in records[: coded[-2]] if not r[1]]
        if before:
            meta["experimenter"] = before[-1]
    seconds = _at_every_byte(header[plain[4][2] :], "<u8") if len(plain) > 4 else np.zeros(0, "<u8")  # behind the species
    seconds = seconds[(seconds >= 1_420_000_000) & (seconds <= 2_050_000_000)]  # 2015 to 2034
    meta["datetime"] = datetime.fromtimestamp(int(seconds[0]), UTC).isoformat() if len(seconds) else ""
    meta |= {k: struct.unpack_from("<I", header, at)[0] for k, at in U32_AT.items()}
    scan.meta = meta | _acquisition(header, sizes["n_time"], scan.depth_start, meta["affines"])
    return scan


def _acquisition(header: bytes, n_time: int, depth_start: float, affines: dict) -> dict:
    """Settings of probe and sequence behind times and frame numbers, if the depth range beside the probe's name is the one
    found by its span; otherwise nothing, so that a shifted block gives no wrong numbers."""
    pose_at = TIMES_AT + 12 * n_time
    sounds_at, name_at = pose_at + 64, pose_at + 112
    if name_at + 2 > len(header):
        return {}
    size = struct.unpack_from("<H", header, name_at)[0]
    after = name_at + 2 + size
    if not 1 <= size <= 64 or after + 52 > len(header) or not (name := _PRINTABLE.fullmatch(header, name_at + 2, after)):
        return {}
    near, far, transmit, repetition = struct.unpack_from("<4d", header, after)
    if not depth_start or not abs(near - depth_start) <= 0.5:
        return {}
    centre, pitch, _, focus = struct.unpack_from("<4d", header, sounds_at)
    out = {"probe_model": name.group().decode("ascii"), "probe_center_frequency": centre, "probe_pitch": pitch, "probe_focal_depth": focus}
    out |= {"imaging_depth": [near, far], "transmit_frequency": transmit, "pulse_repetition_frequency": repetition}
    angles = struct.unpack_from("<I", header, after + 48)[0]
    if 1 <= angles <= 512 and after + 52 + 8 * angles <= len(header):
        out["plane_wave_angles"] = list(struct.unpack_from(f"<{angles}d", header, after + 52))
    if (affine := _pose_affine(header, pose_at)) is not None:
        affines["physical_to_lab"] = affine.tolist()
    return out


def brain_to_lab_mm(brain_to_lab: np.ndarray) -> np.ndarray:
    """A positioning system's affine into the laboratory (x, y, z in metres) as one into (z, y, x) in mm."""
    return np.linalg.inv(np.diag([1e-3, 1e-3, 1e-3, 1.0]) @ TO_PROBE) @ np.asarray(brain_to_lab, float)


_COMPARE = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}
_PUSHED = {"path", "t_idx", "time", "pose"}


@dataclass
class Frames(InputPartition):
    """Neighbouring frames of one file."""

    path: str
    at: int
    shape: tuple[int, int, int]
    t_idx: np.ndarray
    pose: np.ndarray
    time: np.ndarray


class ScanReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int) -> None:
        self.path, self.task_bytes = path, task_bytes
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of what all voxels of a frame share are answered here, whole; Spark keeps the others."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _PUSHED and (type(f) in _COMPARE or isinstance(f, In)) and (name != "path" or isinstance(f, (EqualTo, In))):
                self.filters.append((type(f), name, tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def _wanted(self, name: str, values: np.ndarray | str) -> np.ndarray | bool:
        out: np.ndarray | bool = True
        for kind, column, value in self.filters:
            if column == name:
                hit = (values in value if kind is In else values == value) if name == "path" else np.isin(values, value) if kind is In else _COMPARE[kind](values, value)
                out = out & hit
        return out

    def partitions(self) -> list[Frames]:
        out = []
        for path in list_files(self.path):
            if not self._wanted("path", path):
                continue
            scan = parse_header(path, read_header(path))
            t, pose = scan.frames()
            time = scan.times[t]
            keep = np.ones(len(t), bool) & self._wanted("t_idx", t) & self._wanted("time", time) & self._wanted("pose", pose)
            chosen = np.flatnonzero(keep)
            most = max(1, self.task_bytes // scan.frame_bytes)
            for run in np.split(chosen, np.flatnonzero(np.diff(chosen) != 1) + 1):
                for k in range(0, len(run), most):
                    mine = run[k : k + most]
                    out.append(Frames(path, scan.sizes["header_bytes"] + int(mine[0]) * scan.frame_bytes, scan.shape, t[mine], pose[mine], time[mine]))
        return out or [Frames("", 0, (0, 0, 0), *(np.zeros(0, int),) * 3)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        z, y, x = (i.ravel() for i in np.indices(partition.shape, np.int32))
        size = len(z)
        for k, (t, pose, time) in enumerate(zip(partition.t_idx, partition.pose, partition.time)):
            raw = read_range(partition.path, partition.at + 8 * size * k, 8 * size)
            if len(raw) < 8 * size:
                raise ScanError(f"{partition.path} ends inside a frame")
            data = np.frombuffer(raw, "<f8").reshape(partition.shape[1], partition.shape[0], partition.shape[2]).transpose(1, 0, 2)
            columns = [pa.array([partition.path] * size), pa.array(np.full(size, t, np.int64)), pa.array(np.full(size, pose, np.int32)), pa.array(z), pa.array(y), pa.array(x), pa.array(np.full(size, time, float)), pa.array(np.ascontiguousarray(data).ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


class ScanSource(DataSource):
    """spark.read.format("voxel_scan").load(path): a file, a folder or a pattern; option task_bytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> ScanReader:
        return ScanReader(self.options["path"], int(self.options.get("task_bytes", TASK_BYTES)))


def load_scans(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows of all scans at a path: path, t_idx, pose, z_idx, y_idx, x_idx, time, value.

    Filters on path, t_idx, time and pose choose the bytes that are read. Only headers come to the driver. A folder
    without scans has no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScanSource)
    return spark.read.format(FORMAT).option("task_bytes", task_bytes).load(path)


def scan_meta(spark: SparkSession, path: str) -> DataFrame:
    """path, n_volumes, n_pose, n_z, n_y, n_x and meta (JSON) of each scan, from headers alone, read in parallel."""
    names = list_files(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_header(p, read_header(p)) for p in batch.column(0).to_pylist()]
            whole = [[s.n_volumes, s.sizes["n_pose"], *s.shape] for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([w[k] for w in whole], pa.int64()) for k in range(5)], pa.array([json.dumps(s.meta) for s in found], pa.string())], names=["path", "n_volumes", "n_pose", "n_z", "n_y", "n_x", "meta"])

    return spark.createDataFrame([(n,) for n in names], "path string").mapInArrow(run, "path string, n_volumes long, n_pose long, n_z long, n_y long, n_x long, meta string")


def load_scan(spark: SparkSession, path: str, brain_to_lab: np.ndarray | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """Samples, coordinates and metadata of one scan; poses stay where there is more than one.

    With a positioning system's affine the metadata has physical_to_brain too, which needs a pose in the header.
    """
    names = list_files(path)
    if len(names) != 1:
        raise ScanError(f"{path} is {len(names)} scans, not one")
    scan = parse_header(names[0], read_header(names[0]))
    meta = scan.meta | {"volume_acquisition_reference": "end", "volume_acquisition_duration": float(scan.times.min())}
    meta.setdefault("scan", os.path.basename(names[0]).removesuffix(".scan"))
    if brain_to_lab is not None:
        if "physical_to_lab" not in meta["affines"]:
            raise ScanError(f"{path} has no pose, so nothing leads from it to the brain")
        lab = np.array(meta["affines"]["physical_to_lab"])
        meta["affines"]["physical_to_brain"] = (np.linalg.inv(brain_to_lab_mm(brain_to_lab)) @ lab).tolist()
    rows = [("time", i, float(v), "s", None) for i, v in enumerate(scan.times)]
    for d, (values, step) in scan.coordinates().items():
        rows += [(d, i, float(v), "mm", float(step)) for i, v in enumerate(values)]
    if scan.sizes["n_pose"] > 1:
        rows += [("pose", i, float(i), None, None) for i in range(scan.sizes["n_pose"])]
    coords = spark.createDataFrame(rows, "dim string, idx int, coord double, units string, voxdim double")
    samples = load_scans(spark, path)
    return (samples if scan.sizes["n_pose"] > 1 else samples.drop("pose")), coords, meta
