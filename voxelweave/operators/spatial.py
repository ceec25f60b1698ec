"""Coordinates, affines, grids, resampling and registration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import splines
from ..functions.affine import compose, decompose, motion_parameters, rotation
from .layout import TIME, VALUE

XYZ = ("x", "y", "z")


def apply_affine(points: DataFrame, affine: np.ndarray, names: tuple[str, str, str] = XYZ) -> DataFrame:
    """Points moved by an affine, in column arithmetic."""
    old = [F.col(n).cast("double") for n in names]
    new = {n: sum((float(affine[r][k]) * old[k] for k in range(3)), F.lit(float(affine[r][3]))) for r, n in enumerate(names)}
    return points.withColumns(new)


def split_affine(affine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zooms and translations that coordinates can take on, and the rest (rotation, shear) that they can't."""
    zooms = np.linalg.norm(affine[:3, :3], axis=0)
    rest = np.eye(4)
    rest[:3, :3] = affine[:3, :3] / zooms
    return zooms, np.linalg.inv(rest[:3, :3]) @ affine[:3, 3], rest


def centers_to_edges(coords: DataFrame, coord: str = "coord") -> DataFrame:
    """idx, edge: midpoints between neighbours, and the two outer edges as far out as the nearest midpoint is in."""
    w = Window.orderBy(coord)  # one row for each index of a dimension
    c = coords.select(F.col(coord).cast("double").alias("c")).withColumns({"i": F.row_number().over(w.partitionBy().orderBy("c")) - 1, "p": F.lag("c").over(Window.orderBy("c")), "n": F.lead("c").over(Window.orderBy("c"))})
    left = F.when(F.col("p").isNull(), F.col("c") - (F.col("n") - F.col("c")) / 2).otherwise((F.col("p") + F.col("c")) / 2)
    last = c.filter("n IS NULL").select((F.col("i") + 1).alias("idx"), (F.col("c") + (F.col("c") - F.col("p")) / 2).alias("edge"))
    return c.select(F.col("i").alias("idx"), left.alias("edge")).union(last)


def nearest_slice(coords: DataFrame, wanted: DataFrame, coord: str = "coord", target: str = "target") -> DataFrame:
    """target with the coordinate nearest to it, the smaller one on a tie; wanted is small."""
    d = F.abs(F.col(coord) - F.col(target))
    return coords.crossJoin(F.broadcast(wanted)).groupBy(target).agg(F.min_by(coord, F.struct(d, F.col(coord))).alias(coord))


def motion_table(affines: DataFrame, time: str = TIME, dims: tuple[str, str, str] = ("z", "y", "x"), grid: tuple | None = None, mask: np.ndarray | None = None) -> DataFrame:
    """t_idx, rot_x..z, trans_x..z of each frame's affine (m: rows), named by the axes that its rows stand for (dims).

    Zooms and shears don't count for the angles. With a grid (shape, spacing, origin) also mean_fd, max_fd, rms_fd: how
    far its points, or those of the mask, move from one frame to the next one; 0 without a next one. Frames are numbered
    without gaps. A batch of frames is held with the points of one frame; the grid itself isn't sent to anyone.
    """
    names = [time, *(f"rot_{d}" for d in XYZ), *(f"trans_{d}" for d in XYZ), *(("mean_fd", "max_fd", "rms_fd") if grid is not None else ())]
    order = [dims.index(d) for d in XYZ]
    kind = affines.schema[time].dataType.simpleString()
    rows = affines.select(time, "m")
    if grid is not None:
        following = rows.select((F.col(time) - 1).cast(kind).alias(time), F.col("m").alias("next"))
        rows = rows.join(following, time, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = None if grid is None else grid_points(*grid)[slice(None) if mask is None else np.asarray(mask, bool).ravel()]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = []
            for k, m in enumerate(batch.column(1).to_pylist()):
                m = np.array(m)
                p = motion_parameters(compose(m[:3, 3], decompose(m)[1], np.ones(3)))
                row = [*p[:3][order], *p[3:][order]]
                if grid is not None:
                    other = batch.column(2)[k].as_py()
                    step = np.zeros((4, 4)) if other is None else np.array(other) - m
                    d = np.linalg.norm(points @ step[:3, :3].T + step[:3, 3], axis=1)
                    row += [d.mean(), d.max(), np.sqrt((d * d).mean())] if len(d) else [np.nan] * 3
                found.append(row)
            table = np.array(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(table.shape[1]))], names=names)

    return rows.mapInArrow(run, ", ".join([f"{time} {kind}", *(f"{n} double" for n in names[1:])]))


def slice_times(times: DataFrame, slices: int, duration: float, sweeps: DataFrame | None = None) -> DataFrame:
    """t_idx, z_idx, slice_time: volumes' onsets plus each slice's share of the volume, in order or by the sweep."""
    order = sweeps if sweeps is not None else times.sparkSession.range(slices).select(F.col("id").alias("z_idx"), F.col("id").alias("rank"))
    return times.crossJoin(F.broadcast(order)).select(TIME, "z_idx", (F.col("time") + F.col("rank") * F.lit(duration / slices)).alias("slice_time"))


def consolidated_times(slice_times_: DataFrame, slice_duration: float) -> DataFrame:
    """t_idx, time, duration: the first slice's onset, and the span to the end of the last one."""
    return slice_times_.groupBy(TIME).agg(F.min("slice_time").alias("time"), (F.max("slice_time") - F.min("slice_time") + slice_duration).alias("duration"))


def consolidate_poses(samples: DataFrame, affines: list[np.ndarray], coords: list[float], rtol: float = 0.01) -> tuple[DataFrame, np.ndarray]:
    """Pose and sweep index as one z index by position in the lab, along the axis on which poses differ most.

    affines: one for each pose, of equal rotation; coords: the sweep coordinate of each z index. The new positions must
    be regularly spaced. Returns the samples with z_idx renumbered, and the affine of the new grid.
    """
    a = np.array(affines, float)
    if np.abs(a[:, :3, :3] - a[0, :3, :3]).max() > 1e-6 * np.abs(a[0, :3, :3]).max():
        raise ValueError("poses must have equal rotations")
    spots = np.array([[m[:3, :3] @ [0, 0, c] + m[:3, 3] for c in coords] for m in a])
    flat = spots.reshape(-1, 3)
    _, _, axes = np.linalg.svd(flat - flat.mean(0), full_matrices=False)
    along = axes[0] if axes[0] @ (a[0, :3, :3] @ [0, 0, 1]) >= 0 else -axes[0]
    place = flat @ along
    order = np.argsort(place, kind="stable")
    gaps = np.diff(place[order])
    if len(gaps) and np.abs(gaps - np.median(gaps)).max() > rtol * abs(np.median(gaps)):
        raise ValueError("positions aren't regularly spaced")
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    rows = [(p, z, int(rank[p * len(coords) + z])) for p in range(len(a)) for z in range(len(coords))]
    table = samples.sparkSession.createDataFrame(rows, "pose int, z_idx int, __z int")
    new = a[0].copy()
    new[:3, 3] = flat[order[0]]
    if len(gaps):
        new[:3, 2] = along
    return samples.join(F.broadcast(table), ["pose", "z_idx"]).drop("pose", "z_idx").withColumnRenamed("__z", "z_idx"), new


# Volumes as one group: a frame is bounded, frames are spread over the tasks.


def sample_linear(volume: np.ndarray, index: np.ndarray, fill: float, nearest: bool = False) -> np.ndarray:
    """Values of a z, y, x volume at fractional indices (n, 3); outside of it the fill value."""
    shape = np.array(volume.shape)
    inside = ((index >= -1e-9) & (index <= shape - 1 + 1e-9)).all(1)
    i = np.clip(index, 0, shape - 1)
    if nearest:
        r = np.floor(i + 0.5).astype(int)
        r = np.minimum(r, shape - 1)
        return np.where(inside, volume[tuple(r.T)], fill)
    low = np.minimum(np.floor(i).astype(int), np.maximum(shape - 2, 0))
    w = i - low
    out = np.zeros(len(i))
    for corner in range(8):
        bit = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])
        at = np.minimum(low + bit, shape - 1)
        out += np.where(bit, w, 1 - w).prod(1) * volume[tuple(at.T)]
    return np.where(inside, out, fill)


def sample_bspline(volume: np.ndarray, index: np.ndarray, fill: float) -> np.ndarray:
    """The same with cubic B-splines through all samples."""
    shape = np.array(volume.shape)
    inside = ((index >= -1e-9) & (index <= shape - 1 + 1e-9)).all(1)
    out = np.full(len(index), fill, float)
    out[inside] = splines.sample(splines.coefficients(volume), np.clip(index[inside], 0, shape - 1))
    return out


SAMPLERS = {"linear": sample_linear, "nearest": lambda volume, index, fill: sample_linear(volume, index, fill, True), "bspline": sample_bspline}


def grid_points(shape: tuple[int, int, int], spacing, origin) -> np.ndarray:
    return np.stack(np.meshgrid(*(o + s * np.arange(n) for n, s, o in zip(shape, spacing, origin, strict=True)), indexing="ij"), -1).reshape(-1, 3)


def displaced(points: np.ndarray, field: np.ndarray, spacing, origin) -> np.ndarray:
    """Points moved by a field (3, z, y, x); one voxel beyond its edge it is continued, further out it is NaN."""
    padded = np.pad(field, ((0, 0), (1, 1), (1, 1), (1, 1)), mode="edge")
    index = (points - np.asarray(origin)) / np.asarray(spacing) + 1
    return points + np.stack([sample_linear(c, index, np.nan) for c in padded], 1)


def bspline_field(control: np.ndarray, shape, spacing, origin, grid_spacing, grid_origin) -> np.ndarray:
    """Dense displacements (3, z, y, x) of cubic B-spline control points (3, z, y, x) on a grid, axis by axis."""
    out = np.asarray(control, float)
    for axis in range(3):
        u = (origin[axis] + spacing[axis] * np.arange(shape[axis]) - grid_origin[axis]) / grid_spacing[axis]
        d = np.abs(u[:, None] - np.arange(out.shape[axis + 1]))
        w = np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
        out = np.moveaxis(np.tensordot(w, out, (1, axis + 1)), 0, axis + 1)
    return out


def invert_at_points(points: np.ndarray, field: np.ndarray, spacing, origin, steps: int = 20, tolerance: float = 1e-6, start: np.ndarray | None = None) -> np.ndarray:
    """Points that the field moves to the given ones, by p <- q - u(p)."""
    p = points.copy() if start is None else start.copy()
    for _ in range(steps):
        new = points - (displaced(p, field, spacing, origin) - p)
        moved = np.nanmax(np.abs(new - p)) if len(p) else 0
        p = new
        if moved <= tolerance:
            break
    return p


def invert_field(field: np.ndarray, spacing, origin, steps: int = 20, tolerance: float = 0.1) -> np.ndarray:
    points = grid_points(field.shape[1:], spacing, origin)
    back = invert_at_points(points, field, spacing, origin, steps, tolerance * min(spacing))
    return np.nan_to_num((back - points).T.reshape(field.shape))


def expand_thin(volume: np.ndarray, least: int = 4) -> np.ndarray:
    """Axes shorter than `least` with their slices repeated."""
    for axis, n in enumerate(volume.shape):
        if n < least:
            volume = np.repeat(volume, -(-least // n), axis)
    return volume


def volume_of(frame: pd.DataFrame, shape: tuple[int, int, int], value: str = VALUE) -> np.ndarray:
    out = np.zeros(shape)
    out[frame["z_idx"], frame["y_idx"], frame["x_idx"]] = frame[value]
    return out


def resample(samples: DataFrame, affine: np.ndarray, source: tuple, target: tuple, interpolation: str = "linear", fill: float | None = None, time: str = TIME, field: np.ndarray | None = None) -> DataFrame:
    """t_idx, z_idx, y_idx, x_idx, value on the target grid: each of its points is pulled from the source.

    source and target are (shape, spacing, origin); the affine takes target points to source points, after the field
    (3 x target shape), if there is one. Outside of the source: fill, or each frame's least value. The interpolation is
    linear, nearest or bspline (cubic, through all samples).
    """
    sampler = SAMPLERS[interpolation]
    (shape, spacing, origin), (new_shape, new_spacing, new_origin) = source, target
    points = grid_points(new_shape, new_spacing, new_origin)
    if field is not None:
        points = points + np.asarray(field).reshape(3, -1).T
    index = (points @ np.asarray(affine)[:3, :3].T + np.asarray(affine)[:3, 3] - np.asarray(origin)) / np.asarray(spacing)
    z, y, x = (a.ravel() for a in np.meshgrid(*map(np.arange, new_shape), indexing="ij"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        volume = volume_of(frame, shape)
        out = sampler(volume, index, float(volume.min()) if fill is None else fill)
        return pd.DataFrame({time: frame[time].iloc[0], "z_idx": z, "y_idx": y, "x_idx": x, VALUE: out})

    kind = samples.schema[time].dataType.simpleString()
    return samples.groupBy(time).applyInPandas(run, f"{time} {kind}, z_idx int, y_idx int, x_idx int, {VALUE} double")


def realign(samples: DataFrame, affines: DataFrame, grid: tuple, interpolation: str = "linear", fill: float | None = None, time: str = TIME) -> DataFrame:
    """Each frame pulled through its own affine (t_idx, m: rows, as register_volumewise gives them) on the same grid.

    A frame without an affine, or an affine without a frame, gives no rows.
    """
    shape, spacing, origin = grid
    points, sampler = grid_points(shape, spacing, origin), SAMPLERS[interpolation]
    z, y, x = (a.ravel() for a in np.meshgrid(*map(np.arange, shape), indexing="ij"))

    def run(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if frame.empty or own.empty:
            return pd.DataFrame({c: [] for c in (time, "z_idx", "y_idx", "x_idx", VALUE)})
        volume, m = volume_of(frame, shape), np.array(own["m"].iloc[0].tolist())
        index = (points @ m[:3, :3].T + m[:3, 3] - np.asarray(origin)) / np.asarray(spacing)
        out = sampler(volume, index, float(volume.min()) if fill is None else fill)
        return pd.DataFrame({time: frame[time].iloc[0], "z_idx": z, "y_idx": y, "x_idx": x, VALUE: out})

    kind = samples.schema[time].dataType.simpleString()
    return samples.groupBy(time).cogroup(affines.select(F.col(time).cast(kind).alias(time), "m").groupBy(time)).applyInPandas(run, f"{time} {kind}, z_idx int, y_idx int, x_idx int, {VALUE} double")


def smoothed(volume: np.ndarray, sigma: float) -> np.ndarray:
    """A volume under a Gaussian of sigma voxels along each axis; near an edge only what is there counts."""
    out = np.asarray(volume, float)
    for axis, n in enumerate(out.shape if sigma > 0 else ()):
        at = np.arange(n)
        w = np.exp(-((at[:, None] - at) ** 2) / (2 * sigma * sigma))
        out = np.moveaxis(np.tensordot(w / w.sum(1, keepdims=True), out, (1, axis)), 0, axis)
    return out


def mutual_information(fixed: np.ndarray, moving: np.ndarray, ends: tuple[float, float], bins: int) -> float:
    """Of two equally long lists of values, fixed ones as bins already, moving ones spread over four bins each.

    Moving values are spread by a cubic B-spline (a Parzen window), so the measure changes smoothly with them. `ends`
    are the least and the largest value that moving ones can have; two bins at each end stay free for the window.
    """
    low, high = ends
    u = 2 + (moving - low) * ((bins - 5) / (high - low)) if high > low else np.full(len(moving), 2.0)
    first = np.floor(u).astype(int) - 1
    joint = np.zeros(bins * bins)
    for k in range(4):
        joint += np.bincount(fixed * bins + np.clip(first + k, 0, bins - 1), splines.kernel(u - first - k), bins * bins)
    p = joint.reshape(bins, bins) / joint.sum()
    alone = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    some = p > 0
    return float((p[some] * np.log(p[some] / alone[some])).sum())


def start_of(initial, moving: np.ndarray, fixed: np.ndarray, spacing) -> np.ndarray:
    """A first affine: None (none), the images' centres or their centres of mass brought together, or a given one."""
    out = np.eye(4)
    if initial is None:
        return out
    if isinstance(initial, str):
        middle = {
            "geometry": lambda v: (np.array(v.shape) - 1) / 2,
            "moments": lambda v: np.array([(v.sum(tuple(b for b in range(3) if b != a)) * np.arange(n)).sum() for a, n in enumerate(v.shape)]) / v.sum(),
        }[initial]
        out[:3, 3] = (middle(moving) - middle(fixed)) * spacing
        return out
    return np.asarray(initial, float)


def register(moving: np.ndarray, fixed: np.ndarray, spacing=(1.0, 1.0, 1.0), transform: str = "translation", steps: int = 100, mask: np.ndarray | None = None, metric: str = "correlation", bins: int = 32, levels: tuple[int, ...] = (1,), initial=None, moving_mask: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """An affine from fixed to moving points by ascent of a measure, from coarse to fine steps.

    translation has three parameters, rigid three angles more, affine three zooms more. The measure is the correlation,
    which needs equal contrasts, or the mutual information, which doesn't; the latter counts points inside of the
    moving volume (and of its mask) only, and a place with less than a quarter of them is never better. At each level
    both volumes are smoothed by half the level's voxels and every so many points are taken; the next level goes on
    from there. Values that aren't finite raise. This is an own optimiser; its paths aren't those of an image toolkit.
    """
    if metric not in ("correlation", "mutual_information"):
        raise ValueError(f"unknown measure {metric!r}")
    if not (np.isfinite(moving).all() and np.isfinite(fixed).all()):
        raise ValueError("volumes hold values that aren't finite")
    if bins < 6:
        raise ValueError("six bins at least: two at each end stay free")
    spacing = np.asarray(spacing, float)
    centre = (np.array(fixed.shape) - 1) * spacing / 2
    first = start_of(initial, moving, fixed, spacing)
    n = {"translation": 3, "rigid": 6, "affine": 9}[transform]
    p = np.zeros(9)
    thick = np.array(fixed.shape) > 1
    free = [k for k in range(n) if k >= 3 or thick[k]]
    trace, status = [], "converged"

    def matrix(p: np.ndarray) -> np.ndarray:
        r = rotation(*p[3:6]) if n > 3 else np.eye(3)
        zooms = np.exp(p[6:9]) if n > 6 else np.ones(3)
        a = compose(np.zeros(3), r, zooms)
        a[:3, 3] = centre + p[:3] - a[:3, :3] @ centre
        return first @ a

    def measure(shrink: int):
        here, there = (smoothed(v, shrink / 2 if shrink > 1 else 0) for v in (fixed, moving))
        steps_of = tuple(slice(None, None, shrink if s >= 4 * shrink else 1) for s in fixed.shape)
        chosen = np.zeros(fixed.shape, bool)
        chosen[steps_of] = True
        if mask is not None:
            chosen &= np.asarray(mask, bool)
        points = grid_points(fixed.shape, spacing, (0, 0, 0))[chosen.ravel()]
        target = here[chosen]
        least = float(there.min())
        index_of = lambda a: (points @ a[:3, :3].T + a[:3, 3]) / spacing

        def correlation(p: np.ndarray) -> float:
            got = sample_linear(there, index_of(matrix(p)), least)
            got, want = got - got.mean(), target - target.mean()
            size = np.sqrt((got @ got) * (want @ want))
            return float(got @ want / size) if size > 0 else 0.0

        wide = target.max() - target.min()
        binned = 2 + np.minimum((target - target.min()) * ((bins - 4) / wide if wide > 0 else 0), bins - 5).astype(int)

        def information(p: np.ndarray) -> float:
            index = index_of(matrix(p))
            got = sample_linear(there, index, np.nan)
            inside = np.isfinite(got)
            if moving_mask is not None:
                inside &= sample_linear(np.asarray(moving_mask, float), index, 0.0) >= 0.5
            if inside.sum() * 4 < len(points):
                return -np.inf
            return mutual_information(binned[inside], got[inside], (least, float(there.max())), bins)

        return correlation if metric == "correlation" else information

    for number, shrink in enumerate(levels):
        score = measure(shrink)
        reach = np.concatenate([spacing * (max(4, shrink) if number == 0 else 2 * shrink), np.full(3, 0.1), np.full(3, 0.1)])
        least = 1e-3 if number == len(levels) - 1 else 0.1 * shrink
        best = score(p)
        for k in range(steps):
            better = False
            for d in free:
                for sign in (1, -1):
                    q = p.copy()
                    q[d] += sign * reach[d]
                    if (m := score(q)) > best + 1e-12:
                        p, best, better = q, m, True
                        break
            trace.append(best)
            if not better:
                reach = reach / 2
                if (reach[:3] < least * spacing).all():
                    break
        else:
            status = "stopped"
    return matrix(p), {"metric": best, "trace": trace, "iterations": len(trace), "status": status}


def register_volumewise(samples: DataFrame, shape: tuple[int, int, int], spacing=(1.0, 1.0, 1.0), reference: int = 0, transform: str = "rigid", time: str = TIME, **options) -> DataFrame:
    """t_idx, m (rows of the affine), metric, status: each frame against the reference frame, which goes to the tasks.

    The options are those of `register`: measure, levels, masks and the rest.
    """
    fixed = volume_of(samples.filter(F.col(time) == reference).toPandas(), shape)  # one frame

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, found = register(volume_of(frame, shape), fixed, spacing, transform, **options)
        return pd.DataFrame({time: [frame[time].iloc[0]], "m": [a.tolist()], "metric": [found["metric"]], "status": [found["status"]]})

    kind = samples.schema[time].dataType.simpleString()
    return samples.groupBy(time).applyInPandas(run, f"{time} {kind}, m array<array<double>>, metric double, status string")


def argmax_location(samples: DataFrame, dims: tuple[str, ...], value: str = VALUE) -> DataFrame:
    """One row: where the largest value is, the first place of several."""
    best = F.max_by(F.struct(*dims), F.struct(F.col(value), *[-F.col(d) for d in dims]))
    return samples.agg(best.alias("at")).select("at.*")


def voxel_key(x: Column, origin: float, spacing: float) -> Column:
    """Index of the voxel nearest to a coordinate."""
    return F.floor((x - origin) / spacing + 0.5).cast("long")


# Pull transforms: an affine (4 x 4) or a dense field of displacements (3, z, y, x) on a grid (shape, spacing, origin)


def validate_bspline(meta: dict, control: np.ndarray) -> None:
    """Control points (3, z, y, x) with the attributes of a B-spline transform."""
    if meta.get("transform_type") != "bspline_transform":
        raise ValueError(f"transform_type must be bspline_transform, not {meta.get('transform_type')!r}")
    missing = [k for k in ("order", "direction") if k not in meta]
    if missing:
        raise ValueError(f"attributes are missing: {missing}")
    if np.ndim(control) != 4 or len(control) != 3:
        raise ValueError("control points have three components and three dimensions")


def field_on(transform, grid: tuple, source: tuple | None = None) -> np.ndarray:
    """Displacements (3, z, y, x) of a transform on a grid: an affine, or a field on its own grid (source)."""
    shape, spacing, origin = grid
    points = grid_points(shape, spacing, origin)
    moved = pulled(points, transform, source)
    return (moved - points).T.reshape(3, *shape)


def pulled(points: np.ndarray, transform, source: tuple | None = None) -> np.ndarray:
    transform = np.asarray(transform, float)
    if transform.shape == (4, 4):
        return points @ transform[:3, :3].T + transform[:3, 3]
    if source is None:
        raise ValueError("a field needs the grid that it is on")
    return displaced(points, transform, source[1], source[2])


def composed(old, new, grid: tuple, old_grid: tuple | None = None, new_grid: tuple | None = None):
    """One pull transform for `new` and then `old`: an affine if both are, else displacements on the grid.

    None stands for the identity.
    """
    if new is None or old is None:
        return old if new is None else new
    if np.shape(old) == np.shape(new) == (4, 4):
        return np.asarray(old, float) @ np.asarray(new, float)
    points = grid_points(*grid)
    return (pulled(pulled(points, new, new_grid), old, old_grid) - points).T.reshape(3, *grid[0])


def linked_affines(poses: dict[str, np.ndarray], key: str, consolidated: np.ndarray) -> dict[str, np.ndarray]:
    """One affine for each name, where some are given by pose (pose, 4, 4): the main one (key) becomes `consolidated`.

    Another one by pose must keep one place to the main affine in all poses, and keeps it to `consolidated`; one that
    doesn't is an error. An affine that has no poses stays as it is.
    """
    main = np.asarray(poses[key], float)
    first = np.linalg.inv(main[0])
    out = {key: np.asarray(consolidated, float)}
    for name, each in poses.items():
        each = np.asarray(each, float)
        if name == key:
            continue
        if each.shape != main.shape:
            out[name] = each
            continue
        link = each[0] @ first
        if not np.allclose(each, link @ main, rtol=1e-6, atol=1e-12):
            raise ValueError(f"{name!r} doesn't keep one place to {key!r} in all poses")
        out[name] = link @ out[key]
    return out


def with_affines_of(meta: dict, reference: dict) -> dict:
    """A result's attributes with the affines of the recording that it is now on; without any there, it has none."""
    rest = {k: v for k, v in meta.items() if k != "affines"}
    return rest | ({"affines": reference["affines"]} if "affines" in reference else {})
