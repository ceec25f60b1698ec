"""NIfTI images with their sidecar: recordings from them, and recordings as them.

An image's samples are read and written by ranges of frames (volumes.load_nifti, sinks.save_blocks_of_image); here are
the header, the sidecar, axes and affines, all of them as small as an axis.
"""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .sinks import grid_shape, put, save_blocks_of_image, store_of
from .bids import from_bids, to_bids
from .tables import json_safe, slice_times
from .volumes import NIFTI_TYPES, image_head, load_nifti

#: Units of space and time by their codes in the header.
SPACE, TIME = {"m": 1, "mm": 2, "um": 3}, {"s": 8, "ms": 16, "us": 24}
SECONDS = {"s": 1.0, "ms": 1e-3, "us": 1e-6}
#: From axes z, y, x to x, y, z and back.
SWAP = [2, 1, 0, 3]


def quaternion(rotation: np.ndarray) -> np.ndarray:
    """a, b, c, d of a proper rotation, a not negative: the eigenvector of the largest eigenvalue of Bar-Itzhack's matrix."""
    r = rotation
    k = np.array(
        [
            [r[0, 0] + r[1, 1] + r[2, 2], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]],
            [0, r[0, 0] - r[1, 1] - r[2, 2], r[1, 0] + r[0, 1], r[2, 0] + r[0, 2]],
            [0, 0, r[1, 1] - r[0, 0] - r[2, 2], r[2, 1] + r[1, 2]],
            [0, 0, 0, r[2, 2] - r[0, 0] - r[1, 1]],
        ]
    )
    k = k + np.triu(k, 1).T
    q = np.linalg.eigh(k)[1][:, -1]
    return -q if q[0] < 0 else q


def image_header(shape: tuple[int, ...], dtype: str, spacing: tuple[float, float, float], step: float, qform: np.ndarray, sform: np.ndarray | None, qform_code: int, sform_code: int, version: int = 1, space_units: str = "mm") -> bytes:
    """The header of an image of shape (x, y, z, t), with nothing between it and the data.

    qform is written as the rotation nearest to it, as the format has no shear there.
    """
    if version not in (1, 2):
        raise ValueError(f"version is 1 or 2, not {version!r}")
    if version == 1 and max(shape) > 32767:
        raise ValueError(f"version 1 has sizes up to 32767, not {max(shape)}: write version 2")
    kind = np.dtype(dtype)
    codes = {np.dtype(v): k for k, v in NIFTI_TYPES.items()}
    if kind not in codes:
        raise ValueError(f"images don't hold {kind}")
    zooms = np.sqrt((qform[:3, :3] ** 2).sum(0))
    u, _, v = np.linalg.svd(qform[:3, :3] / np.where(zooms > 0, zooms, 1))
    rotation = u @ v
    side = -1.0 if np.linalg.det(rotation) < 0 else 1.0
    q = quaternion(rotation * [1, 1, side])
    dims = [len(shape), *shape, *[1] * (7 - len(shape))]
    pixdim = [side, *(zooms if (zooms > 0).all() else spacing), step, 1, 1, 1]
    rows = (np.eye(4) if sform is None else sform)[:3].ravel() if sform_code > 0 else np.zeros(12)
    units = SPACE.get(space_units, 0) | TIME["s"]
    if version == 1:
        head = bytearray(352)
        struct.pack_into("<i", head, 0, 348)
        struct.pack_into("<8h", head, 40, *dims)
        struct.pack_into("<2h", head, 70, codes[kind], kind.itemsize * 8)
        struct.pack_into("<8f", head, 76, *pixdim)
        struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
        head[123] = units
        struct.pack_into("<2h", head, 252, qform_code, sform_code)
        struct.pack_into("<6f", head, 256, *q[1:], *qform[:3, 3])
        struct.pack_into("<12f", head, 280, *rows)
        head[344:348] = b"n+1\0"
        return bytes(head)
    head = bytearray(544)
    struct.pack_into("<i8s", head, 0, 540, b"n+2\0\r\n\x1a\n")
    struct.pack_into("<2h", head, 12, codes[kind], kind.itemsize * 8)
    struct.pack_into("<8q", head, 16, *dims)
    struct.pack_into("<8d", head, 104, *pixdim)
    struct.pack_into("<q2d", head, 168, 544, 1.0, 0.0)
    struct.pack_into("<2i", head, 344, qform_code, sform_code)
    struct.pack_into("<6d", head, 352, *q[1:], *qform[:3, 3])
    struct.pack_into("<12d", head, 400, *rows)
    struct.pack_into("<i", head, 500, units)
    return bytes(head)


def zooms_of(affine: np.ndarray) -> np.ndarray:
    """Zooms of an affine without its shears; the first is negative where it mirrors."""
    zooms = np.abs(np.diag(np.linalg.qr(affine[:3, :3])[1]))
    return zooms * [np.sign(np.linalg.det(affine[:3, :3])) or 1, 1, 1]


def sidecar_path(path: str) -> str:
    return path.removesuffix(".gz").removesuffix(".nii") + ".json"


def image_timing(times: list[float], units: str = "s", reference: str = "start", duration: float | None = None) -> tuple[dict, float]:
    """What a sidecar says of times, and the header's step: 0 where steps differ. All in seconds, of volumes' starts."""
    t = np.asarray(times, float) * SECONDS[units]
    lasts = None if duration is None else duration * SECONDS[units]
    if lasts is not None and reference != "start":
        t = t - lasts * {"center": 0.5, "end": 1.0}[reference]
    steps = np.diff(t)
    out: dict = {}
    if len(t) > 1 and steps[0] > 0 and np.allclose(steps, steps[0], rtol=1e-5, atol=1e-9):
        step = float(steps.mean())
        out["RepetitionTime"] = step
        if not np.isclose(t[0], 0):
            out["DelayAfterTrigger"] = float(t[0])
        if lasts is not None and step - lasts > 0 and not np.isclose(step, lasts):
            out["DelayTime"] = step - lasts
        return out, step
    out["VolumeTiming"] = t.tolist()
    if lasts is not None:
        out["FrameAcquisitionDuration"] = lasts
    return out, 0.0


def save_nifti(samples: DataFrame, path: str, coords: DataFrame | None = None, meta: dict | None = None, version: int = 1, qform: str | None = None, sform: str | None = None, qform_code: int | None = None, sform_code: int | None = None, shape: tuple[int, int, int, int] | None = None, dtype: str | None = None, fill: float = 0.0, time_meta: dict | None = None) -> None:
    """samples (t_idx, z_idx, y_idx, x_idx, value) as one image, packed if its name ends in .gz, and a sidecar beside it.

    qform and sform name affines of meta["affines"], from physical coordinates (z, y, x) to the world; by default
    physical_to_qform and physical_to_sform where they are. Without one, the qform has the voxels' places alone and no
    sform is written. Codes are given, or in meta, or 1. Coordinates must be evenly spaced in space; times may not be,
    and the sidecar has them all. time_meta: units, volume_acquisition_reference and _duration of the times.

    No volume comes to the driver. Indices without a sample have `fill`. What is there is replaced when all is written.
    """
    if not path.endswith((".nii", ".nii.gz")):
        raise ValueError(f"{path!r} doesn't end in .nii or .nii.gz")
    meta, time_meta = dict(meta or {}), dict(time_meta or {})
    shape = tuple(shape or grid_shape(samples))
    if not all(shape):
        raise ValueError("there are no samples to say a shape")
    axes: dict[str, list] = {}
    for r in (coords.orderBy("dim", "idx").collect() if coords is not None else []):  # as long as the axes
        axes.setdefault(r["dim"], []).append(r)
    origin, spacing, units = [], [], set()
    for d, n in zip("zyx", shape[1:]):
        rows = axes.get(d)
        at = np.arange(n, dtype=float) if rows is None else np.array([r["coord"] for r in rows])
        if len(at) != n:
            raise ValueError(f"{len(at)} coordinates of {d} for {n} samples")
        steps = np.diff(at)
        if n > 1 and not np.allclose(steps, steps[0], rtol=1e-2):
            raise ValueError(f"coordinates of {d} aren't evenly spaced")
        origin.append(float(at[0]))
        spacing.append(float(steps.mean()) if n > 1 else float(rows[0]["voxdim"] if rows and rows[0]["voxdim"] is not None else 1.0))
        units |= {r["units"] for r in rows or [] if r["units"]}
    if len(units) > 1:
        raise ValueError(f"an image has one unit of space, not {sorted(units)}")
    grid = np.diag([*spacing[::-1], 1.0])
    grid[:3, 3] = origin[::-1]
    affines = {k: np.asarray(v, float) for k, v in meta.pop("affines", {}).items()}
    forms, used = {}, set()
    for form, name, code in (("qform", qform, qform_code), ("sform", sform, sform_code)):
        if name is not None and name not in affines:
            raise ValueError(f"there is no affine {name!r} among {sorted(affines)}")
        name = name or (f"physical_to_{form}" if f"physical_to_{form}" in affines else None)
        told = meta.pop(f"{form}_code", None)
        code = code if code is not None else told if told is not None else 1 if name or form == "qform" else 0
        if code and form == "sform" and name is None:
            raise ValueError("an sform code needs an affine")
        forms[form] = (grid if name is None else affines[name][SWAP][:, SWAP] @ grid, int(code))
        if name is not None and code > 0:
            used.add(name)
    times = axes.get("time")
    timing, step = {}, 0.0
    if times is not None:
        if len(times) != shape[0]:
            raise ValueError(f"{len(times)} times for {shape[0]} volumes")
        timing, step = image_timing([r["coord"] for r in times], time_meta.get("units") or times[0]["units"] or "s", time_meta.get("volume_acquisition_reference", "start"), time_meta.get("volume_acquisition_duration"))
    kind = np.dtype(dtype or ("<c8" if samples.schema["value"].dataType.typeName() == "struct" else "<f8")).newbyteorder("<")
    sizes = shape[:0:-1] + ((shape[0],) if shape[0] > 1 or times is not None else ())
    head = image_header(sizes, kind.newbyteorder("=").str, tuple(spacing[::-1]), step, *[forms[f][0] for f in ("qform", "sform")], *[forms[f][1] for f in ("qform", "sform")], version, next(iter(units), "mm"))
    rest = {k: v.tolist() for k, v in affines.items() if k not in used}
    side = to_bids(json_safe(meta)) | timing | ({"Affines": rest} if rest else {})
    save_blocks_of_image(samples, path, shape, head, kind.str, fill, path.endswith(".gz"))
    put(sidecar_path(path), json.dumps(side, indent=2).encode())


def read_sidecar(path: str) -> dict:
    system, place = store_of(sidecar_path(path))
    if system.get_file_info(place).type.name != "File":
        return {}
    with system.open_input_stream(place) as file:
        return json.loads(file.read())


def image_times(side: dict, step: float, n: int) -> tuple[np.ndarray, float | None]:
    """Starts of n volumes in seconds and how long one lasts: the sidecar's list if it has n, else its period, else the
    header's step, else their numbers. Takes what it uses out of `side`."""
    lasts = side.pop("FrameAcquisitionDuration", None)
    listed, period = side.pop("VolumeTiming", None), side.pop("RepetitionTime", None)
    delay, pause = side.pop("DelayAfterTrigger", 0.0), side.pop("DelayTime", 0.0)
    if listed is not None and len(listed) == n:
        return np.asarray(listed, float), lasts
    if period is not None:
        lasts = lasts if lasts is not None else period - pause if period > pause else None
        return delay + period * np.arange(n), lasts
    return (step if step > 0 else 1.0) * np.arange(n), lasts


def load_image(spark: SparkSession, path: str, complex_as: str | None = None) -> tuple[DataFrame, DataFrame, dict, DataFrame | None]:
    """Samples, coordinates, metadata and slice times (t_idx, z_idx, slice_time; None without them) of one image.

    Places come from the sform, or else the qform, or else the spacing alone; metadata's affines lead from these places
    (z, y, x) to the world. The sidecar's fields are metadata, its timing is in the coordinates.
    """
    head, side = image_head(path), read_sidecar(path)
    affines = head["affines"]
    first = affines.get("sform", affines.get("qform"))
    shape = (*head["shape"][:3], *[1] * (3 - len(head["shape"])))
    spacing = np.array(head["pixdim"][:3]) if first is None else zooms_of(first)
    origin = np.zeros(3)
    meta: dict = {"affines": side.pop("Affines", {})}
    if first is not None:
        # places are where the voxels are along their own axes: what is left of the affine turns and shears them
        origin = first[:3, 3].copy()
        grid = np.diag([*spacing, 1.0])
        grid[:3, 3] = origin
        meta["affines"] |= {f"physical_to_{k}": (v @ np.linalg.inv(grid))[SWAP][:, SWAP].tolist() for k, v in affines.items()}
    meta |= {k: head[k] for k in ("qform_code", "sform_code") if head[k] > 0}
    n = int(np.prod(head["shape"][3:], dtype=int))
    times, lasts = image_times(side, head["step"], n)
    if lasts is not None:
        meta |= {"volume_acquisition_duration": lasts}
    meta["volume_acquisition_reference"] = "start"
    timing, direction = side.pop("SliceTiming", None), side.pop("SliceEncodingDirection", None)
    rows = [("time", i, float(v), "s", None) for i, v in enumerate(times)]
    for d, o, s, m in zip("xyz", origin, spacing, shape):
        rows += [(d, i, float(o + s * i), head["space_units"], float(s)) for i in range(m)]
    coords = spark.createDataFrame(rows, "dim string, idx int, coord double, units string, voxdim double")
    slices = None
    if timing is not None and direction is not None:
        starts = spark.createDataFrame([(i, float(v)) for i, v in enumerate(times)], "t_idx int, time double")
        slices = slice_times(starts, timing, direction)
    return load_nifti(spark, path, pattern="*", complex_as=complex_as), coords, meta | from_bids(side), slices
