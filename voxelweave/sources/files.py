"""Load and save by suffix."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from . import images, scans, sinks, volumes


def variables(spark: SparkSession, path: str) -> list[str]:
    """Names of a Zarr store's arrays that aren't axes."""
    found = json.loads(volumes.small_file(spark, f"{path.rstrip('/')}/.zmetadata"))["metadata"]
    dims = {k.removesuffix("/.zattrs"): v.get("_ARRAY_DIMENSIONS", []) for k, v in found.items() if k.endswith("/.zattrs")}
    return [k for k, v in dims.items() if v != [k]]


def load(spark: SparkSession, path: str, variable: str | None = None, **how) -> DataFrame:
    """Samples of .nii, .nii.gz, .scan, .zarr (its first array, or the one named) or a saved recording."""
    if path.endswith(".scan"):
        return scans.load_scans(spark, path, **how)
    if path.rstrip("/").endswith(".zarr"):
        return volumes.load_zarr(spark, path.rstrip("/"), variable or variables(spark, path)[0], **how)
    if path.endswith((".nii", ".nii.gz")):
        return volumes.load_nifti(spark, path, pattern="*", **how)
    return volumes.load(spark, path, variable)


def save(samples: DataFrame, path: str, coords: DataFrame | None = None, meta: dict | None = None, **how) -> None:
    """Samples with their coordinates and metadata as .nii, .nii.gz (with a sidecar) or .zarr, or as a Parquet recording."""
    if path.endswith((".nii", ".nii.gz")):
        images.save_nifti(samples, path, coords, meta, **how)
    elif path.rstrip("/").endswith(".zarr"):
        sinks.save_zarr(samples, path, coords=coords, meta=meta, **how)
    elif "." in path.rstrip("/").rsplit("/", 1)[-1] and not path.endswith(".parquet"):
        raise ValueError(f"nothing writes {path!r}")
    else:
        volumes.save_recording(samples, path, meta)
