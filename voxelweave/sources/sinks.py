"""Samples as files of dense blocks: chunks of a Zarr store, frames of a NIfTI image.

Rows are shuffled onto the grid of blocks, so that a task holds one block at a time, and written below a stage beside
the target. What makes them visible comes last: the store's metadata and one rename. A job that fails removes its stage,
one that is killed leaves a stage and no store. A task that runs twice writes the same bytes twice.
"""

from __future__ import annotations

import gzip
import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .tables import json_safe

FORMAT = "voxel_blocks"
DIMS = ("t_idx", "z_idx", "y_idx", "x_idx")
#: Long names of axes in stores.
LONG_NAMES = {"time": "Time", "pose": "Pose", "z": "Elevation", "y": "Depth", "x": "Lateral"}
#: Bytes that a partition of blocks has, about.
PARTITION_BYTES = 128 << 20


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the place in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def exists(path: str) -> bool:
    system, place = store_of(path)
    return system.get_file_info(place).type != fs.FileType.NotFound


def remove(path: str) -> None:
    """A file or folder with all that it holds; nothing if there is none."""
    system, place = store_of(path)
    kind = system.get_file_info(place).type
    if kind == fs.FileType.Directory:
        system.delete_dir(place)
    elif kind == fs.FileType.File:
        system.delete_file(place)


def move(source: str, target: str) -> None:
    system, place = store_of(source)
    system.move(place, store_of(target)[1])


def put(path: str, data: bytes) -> None:
    """A whole file, under another name until it is complete."""
    system, place = store_of(path)
    system.create_dir(os.path.dirname(place), recursive=True)
    part = f"{place}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, place)


def grid_shape(samples: DataFrame) -> tuple[int, int, int, int]:
    """Of samples by their greatest indices; without samples, nothing."""
    row = samples.agg(*[F.max(d) for d in DIMS]).first()
    return tuple(0 if v is None else int(v) + 1 for v in row)


@dataclass
class Written(WriterCommitMessage):
    blocks: int
    bytes: int


class BlockWriter(DataSourceArrowWriter):
    """Rows (block, at, re, im), by block and place in it, as one file for each block, or as ranges of one file."""

    def __init__(self, plan: dict) -> None:
        self.plan = plan

    def _emit(self, block: int, data: np.ndarray) -> int:
        p, raw = self.plan, data.tobytes()
        if p["kind"] == "range":  # each block at its own bytes of a file that is there already
            keep = p["item"] * max(0, min(data.size, p["total"] - block * data.size))
            with open(store_of(p["stage"])[1], "r+b") as file:
                file.seek(p["head"] + block * len(raw))
                file.write(raw[:keep])
            return keep
        if p["kind"] == "part":
            raw = raw[: p["item"] * max(0, min(data.size, p["total"] - block * data.size))]
            name = f"{block:012d}"
        else:
            name = ".".join(map(str, np.unravel_index(block, p["grid"])))
        raw = {"zlib": lambda b: zlib.compress(b, 1), "gzip": lambda b: gzip.compress(b, 5, mtime=0), None: bytes}[p["codec"]](raw)
        put(f"{p['stage']}/{p['name']}/{name}", raw)
        return len(raw)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        p, now, data, blocks, total = self.plan, None, None, 0, 0
        kind, filled = np.dtype(p["dtype"]), None
        for batch in iterator:
            block, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            re, im = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            cuts = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(block)]):
                if hi == lo:
                    continue
                if block[lo] != now:
                    if now is not None:
                        total += self._emit(now, data)
                    now, blocks = int(block[lo]), blocks + 1
                    data, filled = np.full(p["size"], p["fill"], kind), np.zeros(p["size"], bool)
                place = at[lo:hi]
                real = place >= 0  # -1: the block's own row, so that blocks without samples are written too
                i = place[real].astype(np.int64)
                if filled[i].any() or len(np.unique(i)) < len(i):
                    raise ValueError("two samples have the same indices")
                filled[i] = True
                data[i] = re[lo:hi][real] + 1j * im[lo:hi][real] if kind.kind == "c" else re[lo:hi][real]
        if now is not None:
            total += self._emit(now, data)
        return Written(blocks, total)

    def commit(self, messages: list[Written | None]) -> None:
        """Metadata, then the rename; ranges and parts of an image are completed by save_nifti."""
        p = self.plan
        if p["kind"] != "chunk":
            return
        if sum(m.blocks for m in messages if m) != math.prod(p["grid"]):
            raise ValueError("chunks are missing")
        for name, text in p["files"].items():
            put(f"{p['stage']}/{name}", text.encode())
        for name, (values, text) in p["axes"].items():
            put(f"{p['stage']}/{name}/0", np.asarray(values, "<f8").tobytes())
            for file, body in text.items():
                put(f"{p['stage']}/{name}/{file}", body.encode())
        if exists(p["target"]):
            if not p["overwrite"]:
                raise FileExistsError(p["target"])
            old = f"{p['stage']}.old"
            move(p["target"], old)
            move(p["stage"], p["target"])
            remove(old)
        else:
            move(p["stage"], p["target"])

    def abort(self, messages: list[Written | None]) -> None:
        remove(self.plan["stage"])


class BlockSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "block long, at long, re double, im double"

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        return BlockWriter(json.loads(self.options["plan"]))


def _write(samples: DataFrame, shape: tuple[int, ...], chunks: tuple[int, ...], item: int, plan: dict) -> None:
    """Shuffle samples (dimensions t, z, y, x; value a number or {re, im}) onto blocks and write them."""
    spark = samples.sparkSession
    spark.dataSource.register(BlockSink)
    grid = [-(-n // c) for n, c in zip(shape, chunks)]
    block: Column = F.lit(0).cast("long")
    at: Column = F.lit(0).cast("long")
    inside = F.lit(True)
    for d, n, c, g in zip(DIMS, shape, chunks, grid):
        i = F.col(d).cast("long")
        inside = inside & F.coalesce((i >= 0) & (i < n), F.lit(False))
        block = block * g + F.floor(i / c)
        at = at * c + i % c
    checked = F.when(inside, block).otherwise(F.raise_error(F.lit("a sample lies outside of the grid")).cast("long"))
    is_complex = samples.schema["value"].dataType.typeName() == "struct"
    re, im = (F.col("value.re"), F.col("value.im")) if is_complex else (F.col("value").cast("double"), F.lit(0.0))
    nan = F.lit(float("nan"))
    rows = samples.select(checked.cast("long").alias("block"), at.cast("long").alias("at"), F.coalesce(re, nan).alias("re"), F.coalesce(im, nan).alias("im"))
    every = spark.range(math.prod(grid)).select(F.col("id").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    size = math.prod(chunks)
    wanted = max(1, min(math.prod(grid), max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.prod(grid) * size * item // PARTITION_BYTES)))
    dealt = rows.unionByName(every).repartition(wanted, "block").sortWithinPartitions("block", "at")
    plan = plan | {"grid": grid, "size": size, "item": item, "total": math.prod(shape)}
    try:
        dealt.write.format(FORMAT).option("plan", json.dumps(plan)).mode("append").save()
    except Exception:
        remove(plan["stage"])
        raise


def _axes(coords: DataFrame | None, shape: tuple[int, ...]) -> dict[str, tuple[list[float], dict]]:
    """Values and attributes of each axis; indices where there are no coordinates. An axis is short: it comes to the driver."""
    out: dict[str, tuple[list[float], dict]] = {}
    if coords is not None:
        for r in coords.orderBy("dim", "idx").collect():
            values, attrs = out.setdefault(r["dim"], ([], {"long_name": LONG_NAMES.get(r["dim"], r["dim"])}))
            values.append(r["coord"])
            attrs |= {k: r[k] for k in ("units", "voxdim") if r[k] is not None}
    for d, n in zip(("time", "z", "y", "x"), shape):
        values, attrs = out.setdefault(d, ([float(i) for i in range(n)], {"long_name": LONG_NAMES[d]}))
        if len(values) != n:
            raise ValueError(f"{len(values)} coordinates of {d} for {n} samples")
    return out


def _json_number(value: complex | float):
    if isinstance(value, complex):
        return [_json_number(value.real), _json_number(value.imag)]
    return "NaN" if math.isnan(value) else ("Infinity" if value > 0 else "-Infinity") if math.isinf(value) else value


def save_zarr(samples: DataFrame, path: str, name: str = "data", coords: DataFrame | None = None, meta: dict | None = None, shape: tuple[int, int, int, int] | None = None, chunks: tuple[int, int, int, int] | None = None, dtype: str | None = None, fill: float = 0.0, codec: str | None = "zlib", overwrite: bool = False, axis_meta: dict[str, dict] | None = None) -> None:
    """samples (t_idx, z_idx, y_idx, x_idx, value) as one array of a version-2 Zarr store, with its axes and metadata.

    A chunk has all of space and as many frames as make about 16 MB, unless `chunks` says otherwise. Indices without a
    sample have `fill`, null values are nan. An existing store raises unless `overwrite`; it stays readable until the
    new one is complete. Samples outside of `shape`, or two with the same indices, raise, and leave no store.
    """
    if codec not in (None, "zlib", "gzip"):
        raise ValueError(f"codec {codec!r} isn't written")
    if exists(path) and not overwrite:
        raise FileExistsError(path)
    shape = tuple(shape or grid_shape(samples))
    if not all(shape):
        raise ValueError("there are no samples to say a shape")
    kind = np.dtype(dtype or ("<c8" if samples.schema["value"].dataType.typeName() == "struct" else "<f8")).newbyteorder("<")
    chunks = tuple(chunks or (max(1, min(shape[0], (16 << 20) // (kind.itemsize * math.prod(shape[1:])))), *shape[1:]))
    axes = _axes(coords, shape)

    def described(dims: tuple[str, ...], sizes, parts, dtype: str, codec, fill, attrs: dict) -> dict[str, str]:
        array = {"zarr_format": 2, "shape": list(sizes), "chunks": list(parts), "dtype": dtype, "compressor": codec and {"id": codec, "level": 1 if codec == "zlib" else 5}, "fill_value": fill, "order": "C", "filters": None}
        return {".zarray": json.dumps(array), ".zattrs": json.dumps({"_ARRAY_DIMENSIONS": list(dims)} | json_safe(attrs))}

    files = {".zgroup": json.dumps({"zarr_format": 2}), ".zattrs": "{}"}
    number = complex(fill) if kind.kind == "c" else float(fill)
    files |= {f"{name}/{k}": v for k, v in described(("time", "z", "y", "x"), shape, chunks, kind.str, codec, _json_number(number), meta or {}).items()}
    texts = {d: described((d,), [len(v)], [max(1, len(v))], "<f8", None, "NaN", a | (axis_meta or {}).get(d, {})) for d, (v, a) in axes.items()}
    every = files | {f"{d}/{k}": v for d, t in texts.items() for k, v in t.items()}
    files[".zmetadata"] = json.dumps({"zarr_consolidated_format": 1, "metadata": {k: json.loads(v) for k, v in every.items()}})
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    plan = {"kind": "chunk", "stage": stage, "target": path.rstrip("/"), "name": name, "dtype": kind.str, "codec": codec, "fill": fill, "overwrite": overwrite, "files": files, "axes": {d: (axes[d][0], t) for d, t in texts.items()}}
    _write(samples, shape, chunks, kind.itemsize, plan)


def convert_blocks(samples: DataFrame, path: str, frames_per_block: int, name: str = "iq", lateral: list[float] | None = None, axial: list[float] | None = None, block_times: list[float] | None = None, sampling_frequency: float | None = None, repetition_frequency: float | None = None, angles: list[float] | None = None, skip_first: int = 0, skip_last: int = 0, frames_per_chunk: int | None = None, overwrite: bool = False, **meta) -> None:
    """Samples of block files (load_autc, load_echoframe) as a Zarr store of complex64 with its axes.

    Times begin at block_times (one for each block that is left, and sampling_frequency is needed), or run through at
    sampling_frequency from the first block that is left, or count frames. Axes without coordinates count voxels. A
    volume lasts as long as its angles. `meta` goes to the array as it is.
    """
    t, z, y, x = grid_shape(samples)
    if not t:
        raise ValueError("there are no blocks")
    blocks = t // frames_per_block - skip_first - skip_last
    if min(skip_first, skip_last) < 0 or blocks < 1:
        raise ValueError("no block is left")
    n, first = blocks * frames_per_block, skip_first * frames_per_block
    if block_times is not None:
        if sampling_frequency is None:
            raise ValueError("times of blocks need a sampling frequency")
        if len(block_times) != blocks:
            raise ValueError(f"{len(block_times)} times for {blocks} blocks")
        times = (np.asarray(block_times, float)[:, None] + np.arange(frames_per_block) / sampling_frequency).ravel()
    else:
        times = (np.arange(n) + first) / sampling_frequency if sampling_frequency is not None else np.arange(n, dtype=float)
    step = lambda v: float(np.diff(v).mean()) if v is not None and len(v) > 1 else 0.0
    axes = {"z": ([0.0] * z, 0.4), "y": (np.arange(y) if axial is None else axial, step(axial)), "x": (np.arange(x) if lateral is None else lateral, step(lateral))}
    rows = [("time", i, float(v), "s", None) for i, v in enumerate(times)] + [(d, i, float(v), "mm", s) for d, (values, s) in axes.items() for i, v in enumerate(values)]
    coords = samples.sparkSession.createDataFrame(rows, "dim string, idx int, coord double, units string, voxdim double")
    about = {"volume_acquisition_reference": "start"}
    if angles is not None and repetition_frequency is not None:
        about["volume_acquisition_duration"] = len(angles) / repetition_frequency
    given = {"plane_wave_angles": angles, "compound_sampling_frequency": sampling_frequency, "pulse_repetition_frequency": repetition_frequency, **meta}
    kept = samples.filter((F.col("t_idx") >= first) & (F.col("t_idx") < first + n)).withColumn("t_idx", F.col("t_idx") - first)
    save_zarr(kept, path, name, coords, {k: v for k, v in given.items() if v is not None}, (n, z, y, x), (frames_per_chunk or frames_per_block, z, y, x), "<c8", overwrite=overwrite, axis_meta={"time": about})


def save_blocks_of_image(samples: DataFrame, target: str, shape: tuple[int, int, int, int], head: bytes, dtype: str, fill: float = 0.0, packed: bool = False) -> None:
    """head and then samples in the order t, z, y, x as one file; each task writes frames at their own bytes.

    Where files can't be written at an offset (packed ones, and other stores than mounted ones), tasks write parts, each
    a member of its own if packed, and one task joins them: one file there is one stream of bytes.
    """
    spark, kind = samples.sparkSession, np.dtype(dtype)
    frames = max(1, min(shape[0], (16 << 20) // (kind.itemsize * math.prod(shape[1:]))))
    stage = f"{target}.stage-{uuid.uuid4().hex}"
    plan = {"stage": stage, "name": "", "dtype": kind.str, "fill": fill, "codec": "gzip" if packed else None, "head": len(head)}
    system, place = store_of(stage)
    if not packed and isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(place), exist_ok=True)
        with open(place, "wb") as file:
            file.write(head)
            file.truncate(len(head) + kind.itemsize * math.prod(shape))
        _write(samples, shape, (frames, *shape[1:]), kind.itemsize, plan | {"kind": "range"})
        move(stage, target)
        return
    _write(samples, shape, (frames, *shape[1:]), kind.itemsize, plan | {"kind": "part"})
    names = [f"{stage}/{k:012d}" for k in range(-(-shape[0] // frames))]
    first = gzip.compress(head, 5, mtime=0) if packed else head

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, place = store_of(f"{stage}/whole")
            with whole.open_output_stream(place, compression=None) as out:
                out.write(first)
                for name in names:
                    with whole.open_input_stream(store_of(name)[1], compression=None) as part:
                        while piece := part.read(8 << 20):
                            out.write(piece)
            yield batch

    try:
        spark.range(1).coalesce(1).mapInArrow(join, "id long").count()
        move(f"{stage}/whole", target)
    finally:
        remove(stage)
