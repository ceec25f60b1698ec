"""An atlas as one object: voxels, structures, meshes and transforms, with the hierarchy's operators as methods."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import atlas, spatial, validate

NAMES = ("reference", "annotation", "hemisphere")


@dataclass
class Atlas:
    """voxels: voxel_id, z_idx, y_idx, x_idx, reference, annotation, hemisphere; structures: id, acronym, name, path.

    meshes: region, vertices (micrometres, flat), faces (flat), one row for each region. grid: shape, spacing, origin.
    to_base takes points of this grid to those of the atlas as published, as an affine or a field on its grid.
    """

    voxels: DataFrame
    structures: DataFrame
    grid: tuple
    meshes: DataFrame | None = None
    to_base: np.ndarray | None = None
    base_grid: tuple | None = None
    meta: dict = field(default_factory=dict)

    def validate(self) -> Atlas:
        validate.validate_atlas(self.voxels, self.structures)
        return self

    def search(self, pattern: str, field: str = "all") -> DataFrame:
        return atlas.search(self.structures, pattern, field)

    def ancestors(self, region: int | str) -> DataFrame:
        return atlas.ancestors(self.structures, self.id_of(region))

    def descendants(self, region: int | str) -> DataFrame:
        return atlas.descendants(self.structures, self.id_of(region))

    def lookup(self) -> DataFrame:
        return atlas.lookup(self.structures)

    def show_tree(self) -> str:
        rows = atlas.tree_lines(self.structures).orderBy("path").collect()  # a region hierarchy
        return "\n".join(r.line for r in rows)

    def id_of(self, region: int | str) -> int:
        """A region's id from itself or its acronym."""
        if not isinstance(region, str):
            return int(region)
        found = self.structures.filter(F.col("acronym") == region).select("id").limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{len(found) or 'no'} structures have the acronym {region!r}")
        return found[0].id

    def masks(self, regions: list[int | str], side: str = "both") -> DataFrame:
        """voxel_id, region, layer of the regions with their descendants."""
        return atlas.region_masks(self.voxels, self.structures, [self.id_of(r) for r in regions], side)

    def mesh(self, region: int | str, side: str = "both", clip: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Vertices (in the grid's units) and faces of a region's surface; a side keeps that half along the last axis."""
        if self.meshes is None:
            raise ValueError("the atlas has no meshes")
        row = self.meshes.filter(F.col("region") == self.id_of(region)).select("vertices", "faces").first()
        if row is None:
            raise ValueError(f"no mesh of {region!r}")
        affine = np.eye(4) if self.to_base is None else np.asarray(self.to_base)
        if affine.shape != (4, 4):
            v = spatial.invert_at_points(np.reshape(row.vertices, (-1, 3)) / 1000, affine, *self.base_grid[1:])
            v, f = atlas.drop_outside(v, np.reshape(row.faces, (-1, 3)), *self.grid) if clip else (v, np.reshape(row.faces, (-1, 3)))
        else:
            v, f = atlas.mesh(np.reshape(row.vertices, (-1, 3)), np.reshape(row.faces, (-1, 3)), affine, self.grid, clip)
        if side == "both":
            return v, f
        shape, spacing, origin = self.grid
        middle = origin[2] + spacing[2] * (shape[2] - 1) / 2
        keep = v[:, 2] <= middle if side == "left" else v[:, 2] >= middle
        number = np.cumsum(keep) - 1
        whole = keep[f].all(1) if len(f) else np.zeros(0, bool)
        return v[keep], number[f[whole]]

    def resample(self, transform, shape, spacing, origin, interpolation: str = "linear") -> Atlas:
        """This atlas on another grid; the pull transform takes its points to this grid's: an affine or a field on it.

        The reference is interpolated, annotations and hemispheres are those of the nearest voxel, and 0 outside.
        """
        target = (tuple(shape), tuple(spacing), tuple(origin))
        affine, moved = (np.asarray(transform), None) if np.shape(transform) == (4, 4) else (np.eye(4), np.asarray(transform))
        parts = []
        for name in NAMES:
            volume = self.voxels.select(F.lit(0).alias("t_idx"), "z_idx", "y_idx", "x_idx", F.col(name).cast("double").alias("value"))
            how = interpolation if name == "reference" else "nearest"
            parts.append(spatial.resample(volume, affine, self.grid, target, how, 0.0, field=moved).select("z_idx", "y_idx", "x_idx", F.col("value").alias(name)))
        out = parts[0].join(parts[1], ["z_idx", "y_idx", "x_idx"]).join(parts[2], ["z_idx", "y_idx", "x_idx"])
        place = (F.col("z_idx") * shape[1] + F.col("y_idx")) * shape[2] + F.col("x_idx")
        out = out.select(place.cast("long").alias("voxel_id"), "z_idx", "y_idx", "x_idx", "reference", *[F.round(n).cast("int").alias(n) for n in NAMES[1:]])
        base = spatial.composed(self.to_base, transform, target, self.base_grid, target)
        return replace(self, voxels=out, grid=target, to_base=base, base_grid=target if np.shape(base) != (4, 4) else None)

    def resample_like(self, reference: tuple, transform, interpolation: str = "linear") -> Atlas:
        """resample on the grid (shape, spacing, origin) of another recording."""
        return self.resample(transform, *reference, interpolation)

    def save(self, path: str) -> None:
        """Four Parquet tables: voxels, structures, meshes if there are any, and one row of everything else as JSON."""
        spark = self.voxels.sparkSession
        self.voxels.write.mode("overwrite").parquet(f"{path}/voxels")
        self.structures.write.mode("overwrite").parquet(f"{path}/structures")
        if self.meshes is not None:
            self.meshes.write.mode("overwrite").parquet(f"{path}/meshes")
        rest = {"grid": self.grid, "to_base": None if self.to_base is None else np.asarray(self.to_base).tolist(), "base_grid": self.base_grid, "meshes": self.meshes is not None, "meta": self.meta}
        spark.createDataFrame(pd.DataFrame({"rest": [json.dumps(rest)]})).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Atlas:
        rest = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        grid = lambda g: None if g is None else tuple(map(tuple, g))
        meshes = spark.read.parquet(f"{path}/meshes") if rest["meshes"] else None
        return cls(spark.read.parquet(f"{path}/voxels"), spark.read.parquet(f"{path}/structures"), grid(rest["grid"]), meshes, None if rest["to_base"] is None else np.array(rest["to_base"]), grid(rest["base_grid"]), rest["meta"])
