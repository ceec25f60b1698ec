"""Volumes in scientific file formats, read in parallel by block or frame, and written back.

Images and chunks come through Spark's binary file source, one row each, so that any store that Spark reaches will do.
Files of many blocks are far larger than a row may be: Spark lists them, and each task opens its ranges of bytes itself.
A reader turns what it reads into rows of the long encoding inside the task that read it.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.layout import ranked

LONG = "path string, t_idx int, z_idx int, y_idx int, x_idx int, value double"
COMPLEX = "path string, t_idx long, z_idx int, y_idx int, x_idx int, value struct<re:double,im:double>"

#: Fixed values of the NIfTI-1 format: data types by code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8", 32: "c8", 1792: "c16"}


def nifti_header(raw: bytes) -> dict:
    """What the first 544 bytes of an unpacked NIfTI-1 or -2 image say: shape, spacing, affines and codes, and where data stand."""
    if len(raw) < 348:
        raise ValueError("this isn't a NIfTI image")
    order = "<" if struct.unpack("<i", raw[:4])[0] in (348, 540) else ">"
    size = struct.unpack(order + "i", raw[:4])[0]
    if size == 348:
        dim = struct.unpack(order + "8h", raw[40:56])
        code = struct.unpack(order + "h", raw[70:72])[0]
        pixdim = struct.unpack(order + "8f", raw[76:108])
        offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
        units = raw[123]
        qform, sform = struct.unpack(order + "2h", raw[252:256])
        quatern = struct.unpack(order + "6f", raw[256:280])
        srow = np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4)
    elif size == 540 and len(raw) >= 540:
        code = struct.unpack(order + "h", raw[12:14])[0]
        dim = struct.unpack(order + "8q", raw[16:80])
        pixdim = struct.unpack(order + "8d", raw[104:168])
        offset = struct.unpack(order + "q", raw[168:176])[0]
        slope, inter = struct.unpack(order + "2d", raw[176:192])
        qform, sform = struct.unpack(order + "2i", raw[344:352])
        quatern = struct.unpack(order + "6d", raw[352:400])
        srow = np.array(struct.unpack(order + "12d", raw[400:496])).reshape(3, 4)
        units = struct.unpack(order + "i", raw[500:504])[0]
    else:
        raise ValueError("this isn't a NIfTI image")
    shape = tuple(int(n) for n in dim[1 : dim[0] + 1])
    affines = {}
    if sform > 0:
        affines["sform"] = np.vstack([srow, [0, 0, 0, 1]])
    if qform > 0:
        b, c, d = quatern[:3]
        a = np.sqrt(max(0, 1 - b * b - c * c - d * d))
        rot = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c]])
        q = np.eye(4)
        q[:3, :3] = rot * [pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)]
        q[:3, 3] = quatern[3:]
        affines["qform"] = q
    time_factor = {8: 1.0, 16: 1e-3, 24: 1e-6}.get(units & 56, 1.0)
    meta = {"shape": shape, "pixdim": [float(p) for p in pixdim[1:5]], "step": float(pixdim[4]) * time_factor if len(shape) > 3 else 0.0, "affines": affines}
    meta |= {"qform_code": int(qform), "sform_code": int(sform), "space_units": {1: "m", 2: "mm", 3: "um"}.get(units & 7)}
    return meta | {"dtype": np.dtype(order + NIFTI_TYPES[code]), "offset": int(offset), "slope": float(slope), "inter": float(inter)}


def _scaled(data: np.ndarray, head: dict) -> np.ndarray:
    slope, inter = head["slope"], head["inter"]
    return data * slope + inter if slope not in (0, 1) or (slope and inter) else data


def parse_nifti(raw: bytes) -> tuple[dict, np.ndarray]:
    """Header and data (axes as in the file: x, y, z, t) of a NIfTI-1 or -2 image, gzipped or not."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head = nifti_header(raw)
    shape = head["shape"]
    data = np.frombuffer(raw, head["dtype"], int(np.prod(shape)), head["offset"]).reshape(shape, order="F")
    return {k: v for k, v in head.items() if k in ("shape", "pixdim", "step", "affines")}, _scaled(data, head)


def write_nifti(volume: np.ndarray, spacing=(1.0, 1.0, 1.0), step: float = 0.0, affine: np.ndarray | None = None) -> bytes:
    """A NIfTI-1 image of a (t, z, y, x) or (z, y, x) array; booleans become bytes."""
    data = np.asarray(volume)
    data = data.astype(np.uint8) if data.dtype == bool else data
    data = data.transpose(*range(data.ndim)[::-1])  # x, y, z, t
    code = {np.dtype(v): k for k, v in NIFTI_TYPES.items()}[data.dtype.newbyteorder("=")]
    head = bytearray(348)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, data.ndim, *data.shape, *[1] * (7 - data.ndim))
    struct.pack_into("<2h", head, 70, code, data.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *spacing[::-1], step, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[123] = 2 | 8
    a = np.diag([*spacing[::-1], 1.0]) if affine is None else np.asarray(affine)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *a[:3].ravel())
    head[344:348] = b"n+1\0"
    return bytes(head) + b"\0\0\0\0" + data.tobytes(order="F")


def _rows(path: str, data: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Rows of a (t, z, y, x) array."""
    t, z, y, x = (i.ravel() for i in np.indices(data.shape, dtype=np.int32))
    return pa.RecordBatch.from_arrays([pa.array([path] * len(t)), pa.array(t + np.int32(first)), pa.array(z), pa.array(y), pa.array(x), pa.array(data.ravel().astype(float))], names=["path", "t_idx", "z_idx", "y_idx", "x_idx", "value"])


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def _image_rows(name: str, data: np.ndarray, first: int, complex_as: str | None) -> Iterator[pa.RecordBatch]:
    """Rows of an image's frames, axes x, y, z and perhaps t."""
    if np.iscomplexobj(data) and complex_as is None:
        raise ValueError(f"{name} is complex: say whether its parts or its magnitude are wanted")
    data = np.abs(data) if complex_as == "magnitude" else data
    data = data.reshape(*data.shape, *[1] * (4 - data.ndim)).transpose(3, 2, 1, 0)
    for t in range(len(data)):
        yield _complex_rows(name, data[t : t + 1], first + t) if complex_as == "parts" else _rows(name, data[t : t + 1], first + t)


def image_head(path: str) -> dict:
    """The header of an image, from its first bytes alone, packed or not."""
    raw = read_range(path, 0, 1 << 16)
    return nifti_header(zlib.decompressobj(31).decompress(raw, 1024) if raw[:2] == b"\x1f\x8b" else raw[:1024])


def load_nifti(spark: SparkSession, path: str, pattern: str = "*.nii*", complex_as: str | None = None, task_bytes: int = 64 << 20) -> DataFrame:
    """path, t_idx, z_idx, y_idx, x_idx, value of all images below a path.

    Images are read by ranges of frames, of any size; a packed one can't be entered in the middle, so it is one row of
    at most 2 GB. Complex images need complex_as: "parts" gives value {re, im} for all images, "magnitude" their
    magnitudes.
    """
    if complex_as not in (None, "parts", "magnitude"):
        raise ValueError(f"complex_as is parts or magnitude, not {complex_as!r}")
    out = COMPLEX if complex_as == "parts" else LONG
    files = binary_files(spark, path, pattern)
    packed = F.col("path").endswith(".gz")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _image_rows(name, parse_nifti(raw)[1], 0, complex_as)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int, int]] = []
            for name in batch.column(0).to_pylist():
                head = image_head(name)
                frames = int(np.prod(head["shape"][3:], dtype=int))
                step = max(1, task_bytes // max(1, int(np.prod(head["shape"][:3])) * head["dtype"].itemsize))
                found += [(name, k, min(step, frames - k)) for k in range(0, frames, step)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.int64()) for k in (1, 2)]], names=["path", "first", "frames"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, frames in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                head = image_head(name)
                space = tuple(head["shape"][:3]) + (1,) * (3 - len(head["shape"]))
                size = int(np.prod(space)) * head["dtype"].itemsize
                for k in range(first, first + frames):
                    raw = read_range(name, head["offset"] + k * size, size)
                    if len(raw) < size:
                        raise ValueError(f"{name} ends inside a frame")
                    yield from _image_rows(name, _scaled(np.frombuffer(raw, head["dtype"]).reshape(space, order="F"), head), k, complex_as)

    places = files.filter(~packed).select("path").mapInArrow(ranges, "path string, first long, frames long")
    plain = places.repartitionByRange("path", "first").mapInArrow(read, out)
    return plain.unionByName(files.filter(packed).select("path", "content").mapInArrow(whole, out))


def nifti_meta(spark: SparkSession, path: str, pattern: str = "*.nii*") -> DataFrame:
    """path, meta: the header of each image as JSON, from its first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metas = []
            for name in batch.column(0).to_pylist():
                m = {k: v for k, v in image_head(name).items() if k not in ("dtype", "offset", "slope", "inter")}
                metas.append(json.dumps(m | {"affines": {k: v.tolist() for k, v in m["affines"].items()}}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(metas, pa.string())], names=["path", "meta"])

    return binary_files(spark, path, pattern).select("path").mapInArrow(run, "path string, meta string")


def _complex_rows(path: str, data: np.ndarray, first: int = 0) -> pa.RecordBatch:
    """Rows of a complex (t, z, y, x) array."""
    t, z, y, x = (i.ravel() for i in np.indices(data.shape, dtype=np.int32))
    flat = data.ravel()
    value = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], ["re", "im"])
    return pa.RecordBatch.from_arrays([pa.array([path] * len(t)), pa.array(t.astype(np.int64) + first), pa.array(z), pa.array(y), pa.array(x), value], names=["path", "t_idx", "z_idx", "y_idx", "x_idx", "value"])


def read_range(path: str, start: int, length: int) -> bytes:
    """Some bytes of a file, by the file systems that Arrow knows (local, HDFS, S3, GCS)."""
    if path.startswith("file:") or "://" not in path:
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
            file.seek(start)
            return file.read(length)
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(quote(path, safe=":/"))
    with system.open_input_file(place) as file:
        return file.read_at(length, start)


def block_places(spark: SparkSession, path: str, pattern: str, unit: int, header_items: int, header_type: str, number_at: int | None) -> DataFrame:
    """path, at (byte), block (place in the order of all blocks from 0, or in its file without number_at).

    Files are listed without being read. Of each block only its header is read for its number; numbers may have gaps,
    and blocks are counted through in the order of their numbers.
    """
    files = binary_files(spark, path, pattern).select("path", "length").filter(F.col("length") >= unit)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / unit) - 1))
    places = files.select("path", k.alias("k")).select("path", "k", (F.col("k") * unit).alias("at"))
    if number_at is None:
        return places.select("path", "at", F.col("k").alias("block"))
    item = np.dtype(header_type).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [int(np.frombuffer(read_range(p, at + number_at * item, item), header_type)[0]) for p, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=["path", "k", "at", "number"])

    numbered = places.mapInArrow(run, "path string, k long, at long, number long")
    return ranked(numbered, "number", "path", "k").rows.select("path", "at", (F.col("__r") - 1).alias("block"))


def read_blocks(places: DataFrame, shape: tuple[int, ...], axes: tuple[int, int, int, int]) -> DataFrame:
    """Rows of complex64 blocks from where they begin (path, at, block), each read by its own range of bytes."""
    count = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = np.frombuffer(read_range(name, at, count * 8), np.complex64).reshape(shape)
                data = data.transpose([a for a in axes if a >= 0])
                for k, a in enumerate(axes):
                    data = np.expand_dims(data, k) if a < 0 else data
                yield _complex_rows(name, data, block * data.shape[0])

    return places.select("path", "at", "block").repartitionByRange("path", "at").mapInArrow(run, COMPLEX)


def load_blocks(spark: SparkSession, path: str, pattern: str, header_items: int, header_type: str, shape: tuple[int, ...], axes: tuple[int, int, int, int], padding: int = 0, number_at: int | None = None) -> DataFrame:
    """Rows of .dat files of complex64 blocks, each behind a header of its own.

    shape: of a block as stored; axes: which of its axes are t, z, y, x (-1: there is none). Blocks are in order of the
    number in their header (number_at), whatever its gaps, or of their place in the file; empty files have no rows.
    """
    head = header_items * np.dtype(header_type).itemsize
    places = block_places(spark, path, pattern, head + int(np.prod(shape)) * 8 + padding, header_items, header_type, number_at)
    return read_blocks(places.withColumn("at", F.col("at") + head), shape, axes)


def headers(spark: SparkSession, path: str, pattern: str, kind: str, names: list[str], at_least: int = 1) -> DataFrame:
    """path, length and the first numbers of each file, by name; files that are shorter than these have no row."""
    item = np.dtype(kind).itemsize
    files = binary_files(spark, path, pattern).select("path", "length").filter(F.col("length") >= max(at_least, item * len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(read_range(p, 0, item * len(names)), kind).astype(np.int64) for p in batch.column(0).to_pylist()]
            columns = [pa.array([int(f[k]) for f in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["path", "length", *names])

    return files.mapInArrow(run, "path string, length long, " + ", ".join(f"{n} long" for n in names))


def load_autc(spark: SparkSession, root: str, pattern: str = "bf*part*.dat") -> DataFrame:
    """Part files of blocks (x, z, frame), each behind ten int32: its number from 1, items, n_z, n_x, frames, and five more.

    Sizes come from the headers and must be the same in all files; without any block there are no rows.
    """
    found = headers(spark, root, pattern, "<i4", ["number", "items", "n_z", "n_x", "n_frames"], 40).select("n_x", "n_z", "n_frames").distinct().limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"files have blocks of different sizes: {found}")
    if not found:
        return spark.createDataFrame([], COMPLEX)
    return load_blocks(spark, root, pattern, 10, "<i4", tuple(found[0]), (2, -1, 1, 0), number_at=0)


def load_echoframe(spark: SparkSession, path: str, n_volumes: int, n_x: int, n_z: int, pattern: str = "*.dat") -> DataFrame:
    """Files of blocks (volume, x, 1, z) behind one header of five uint64: its size, the number of blocks, the padding.

    n_volumes, n_x and n_z are in the acquisition's own metadata. Padding stands after each block. Blocks that a file
    promises but lacks are an error.
    """
    size = n_volumes * n_x * n_z * 8
    files = headers(spark, path, pattern, "<u8", ["version", "header_size", "n_blocks", "data_size", "padding"]).filter("n_blocks > 0")
    step = F.lit(size) + F.col("padding")
    whole = F.col("length") >= F.col("header_size") + F.col("n_blocks") * step - F.col("padding")
    ok = F.when(whole, F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).otherwise(F.raise_error(F.concat(F.lit("blocks are missing in "), "path")).cast("array<bigint>"))
    places = files.withColumn("block", F.explode(ok)).select("path", (F.col("header_size") + F.col("block") * step).alias("at"), "block")
    return read_blocks(places, (n_volumes, n_x, 1, n_z), (0, 2, 3, 1))


def small_file(spark: SparkSession, path: str) -> str:
    """A small text file of any store that Spark reaches; hidden ones too, which Spark's readers pass over."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def load_zarr(spark: SparkSession, path: str, name: str, complex_as: str | None = None) -> DataFrame:
    """Rows of a version-2 array with up to four dimensions (t, z, y, x, the last ones if fewer), a task for each chunk.

    Chunks may be raw, zlib or gzip; other codecs raise. A chunk that isn't there has no rows, as for a fill value.
    Complex arrays need complex_as: "parts" gives value {re, im}, "magnitude" the magnitude.
    """
    meta = json.loads(small_file(spark, f"{path}/{name}/.zarray"))
    codec = (meta.get("compressor") or {}).get("id")
    if codec not in (None, "zlib", "gzip") or meta.get("filters"):
        raise ValueError(f"codec {codec!r} and filters {meta.get('filters')!r} aren't read")
    if np.dtype(meta["dtype"]).kind == "c" and complex_as not in ("parts", "magnitude"):
        raise ValueError(f"{name} is complex: say whether its parts or its magnitude are wanted")
    shape, chunks, separator = meta["shape"], meta["chunks"], meta.get("dimension_separator", ".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = file.rsplit(f"/{name}/", 1)[1].split(separator)
                if not all(k.isdigit() for k in key):
                    continue
                raw = {"zlib": zlib.decompress, "gzip": gzip.decompress, None: bytes}[codec](raw)
                start = [int(k) * c for k, c in zip(key, chunks, strict=True)]
                data = np.frombuffer(raw, meta["dtype"]).reshape(chunks, order=meta.get("order", "C"))
                data = data[tuple(slice(0, max(0, n - s)) for n, s in zip(shape, start, strict=True))]
                lead = 4 - data.ndim
                data = np.abs(data) if complex_as == "magnitude" else data
                out = (_complex_rows if complex_as == "parts" else _rows)(file, data.reshape((1,) * lead + data.shape))
                shift = [0] * lead + start
                yield pa.RecordBatch.from_arrays([out.column(0), *[pa.array(out.column(k + 1).to_numpy() + out.column(k + 1).to_numpy().dtype.type(shift[k])) for k in range(4)], out.column(5)], names=out.schema.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{path}/{name}")
    return files.select("path", "content").mapInArrow(run, COMPLEX if complex_as == "parts" else LONG)


def save_recording(samples: DataFrame, path: str, meta: dict | None = None) -> None:
    """Samples as Parquet, dealt and sorted by ranges of time so that files can be passed over, with the metadata beside."""
    order = [c for c in ("recording_id", "t_idx", "voxel_id") if c in samples.columns]
    samples = samples.repartitionByRange(*order).sortWithinPartitions(*order) if order else samples
    samples.write.parquet(f"{path}/samples", mode="overwrite")
    samples.sparkSession.createDataFrame([(json.dumps(meta or {}),)], "meta string").write.parquet(f"{path}/meta", mode="overwrite")


def load_recording(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/samples"), json.loads(spark.read.parquet(f"{path}/meta").first()[0])


READERS = {".nii": load_nifti, ".nii.gz": load_nifti}


def load(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """A reader by suffix: .nii and .nii.gz, .zarr with a variable, or a saved recording."""
    if path.rstrip("/").endswith(".zarr"):
        if variable is None:
            raise ValueError("a variable of the store is needed")
        return load_zarr(spark, path, variable)
    for suffix, reader in READERS.items():
        if path.endswith(suffix):
            return reader(spark, path)
    if path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        return load_recording(spark, path)[0]
    raise ValueError(f"no reader for {path!r}")


def create_recording(spark: SparkSession, data: np.ndarray, dt: float = 1.0, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """Samples and coordinates of an array (t, z, y, x); fewer dimensions get single slices in front.

    A complex array's samples have value {re, im}.
    """
    data = np.asarray(data)
    data = data.reshape((1,) * (4 - data.ndim) + data.shape)
    t, z, y, x = (i.ravel() for i in np.indices(data.shape))
    voxel = (z * data.shape[2] + y) * data.shape[3] + x
    columns = {"t_idx": t, "z_idx": z, "y_idx": y, "x_idx": x, "voxel_id": voxel}
    flat = data.ravel()
    value = pa.StructArray.from_arrays([pa.array(flat.real.astype(float)), pa.array(flat.imag.astype(float))], ["re", "im"]) if np.iscomplexobj(flat) else pa.array(flat.astype(float))
    table = pa.table({k: pa.array(v.astype(np.int64)) for k, v in columns.items()} | {"value": value})
    coords = [(d, i, float(o + s * i), "s" if d == "time" else "mm", float(s)) for d, n, s, o in zip(("time", "z", "y", "x"), data.shape, (dt, *spacing), (0.0, *origin), strict=True) for i in range(n)]
    samples = spark.createDataFrame(table).withColumns({c: F.col(c).cast("int") for c in ("t_idx", "z_idx", "y_idx", "x_idx")})
    return samples, spark.createDataFrame(coords, "dim string, idx int, coord double, units string, voxdim double")


def create_iq(spark: SparkSession, data: np.ndarray, dt: float = 1.0, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), transmit_frequency: float | None = None, sound_velocity: float | None = None, duration: float | None = None, reference: str = "start") -> tuple[DataFrame, DataFrame, dict]:
    """Complex samples, coordinates and attributes of an array (t, z, y, x) of demodulated echoes."""
    if not np.iscomplexobj(data):
        raise ValueError("echoes must be complex")
    samples, coords = create_recording(spark, data, dt, spacing, origin)
    given = {"transmit_frequency": transmit_frequency, "sound_velocity": sound_velocity, "volume_acquisition_duration": duration, "volume_acquisition_reference": reference}
    return samples, coords, {k: v for k, v in given.items() if v is not None}


def to_array(values: DataFrame, grid: DataFrame, shape: tuple[int, int, int], value: str = "value", fill: float = 0.0) -> np.ndarray:
    """One map (voxel_id, value) as an array (z, y, x) on the driver; voxels without a value have the fill."""
    rows = values.join(grid.select("voxel_id", "z_idx", "y_idx", "x_idx"), "voxel_id").select("z_idx", "y_idx", "x_idx", value).toPandas()  # one volume
    out = np.full(shape, fill)
    out[rows["z_idx"], rows["y_idx"], rows["x_idx"]] = rows[value]
    return out
