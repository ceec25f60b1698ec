"""Region hierarchies: search, ancestors, descendants and masks; points under transforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .layout import VOXEL
from .spatial import displaced, invert_at_points

# structures: id, acronym, name, path (ids from the root down to the structure itself)


def search(structures: DataFrame, pattern: str, field: str = "all") -> DataFrame:
    """Structures that match a regular expression whatever the case: within either field, or the whole of one field."""
    if field == "all":
        return structures.filter(F.col("acronym").rlike(f"(?i){pattern}") | F.col("name").rlike(f"(?i){pattern}"))
    return structures.filter(F.col(field).cast("string").rlike(f"(?i)^(?:{pattern})$"))


def with_paths(tree: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """key, path from the root down, from parent links, by a recursive query."""
    name = f"tree_{abs(hash((key, parent))) % 10**8}"
    tree.select(F.col(key).alias("id"), F.col(parent).alias("parent_id")).createOrReplaceTempView(name)
    return tree.sparkSession.sql(
        f"WITH RECURSIVE p AS (SELECT id, array(id) AS path FROM {name} WHERE parent_id IS NULL "
        f"UNION ALL SELECT t.id, concat(p.path, array(t.id)) FROM p JOIN {name} t ON t.parent_id = p.id) SELECT id AS {key}, path FROM p"
    )


def descendants(structures: DataFrame, region: int) -> DataFrame:
    """Structures of a subtree, its root included."""
    return structures.filter(F.array_contains("path", F.lit(region).cast(structures.schema["path"].dataType.elementType)))


def ancestors(structures: DataFrame, region: int) -> DataFrame:
    """depth, id from the root down, without the region itself."""
    own = structures.filter(F.col("id") == region).select(F.posexplode("path").alias("depth", "ancestor"))
    return own.filter(F.col("ancestor") != region).select("depth", F.col("ancestor").alias("id"))


def lookup(structures: DataFrame) -> DataFrame:
    return structures.select("id", "acronym", "name", *[c for c in ("rgb",) if c in structures.columns])


def region_masks(voxels: DataFrame, structures: DataFrame, regions: list[int], side: str = "both") -> DataFrame:
    """voxel_id, region, layer: a row for each voxel of a region or its descendants; voxels may be in several regions.

    voxels: voxel_id, annotation, hemisphere (1 left, 2 right). Every voxel's structure is looked up once, and its path
    tells the regions that it belongs to.
    """
    wanted = structures.filter(F.col("id").isin(regions)).select(F.col("id").alias("region"), F.col("acronym").alias("layer"))
    members = structures.select(F.col("id").alias("annotation"), F.explode("path").alias("region")).join(F.broadcast(wanted), "region")
    held = voxels
    if side != "both":
        held = voxels.filter(F.col("hemisphere") == {"left": 1, "right": 2}[side])
        members = members.withColumn("layer", F.concat("layer", F.lit({"left": "_L", "right": "_R"}[side])))
    return held.join(members, "annotation").select(VOXEL, "region", "layer")


def tree_lines(structures: DataFrame) -> DataFrame:
    """line, path: the hierarchy as text, a row for each structure; sorted by path it reads from the root down."""
    return structures.select(F.concat(F.repeat(F.lit("  "), F.size("path") - 1), "acronym", F.lit(" ("), F.col("id").cast("string"), F.lit(")")).alias("line"), "path")


def transform_points(points: np.ndarray, affine: np.ndarray | None = None, field: np.ndarray | None = None, spacing=(1, 1, 1), origin=(0, 0, 0), inverse: bool = False) -> np.ndarray:
    """Points under an affine or a displacement field, or under its inverse."""
    if affine is not None:
        a = np.linalg.inv(affine) if inverse else np.asarray(affine)
        return points @ a[:3, :3].T + a[:3, 3]
    if field is not None:
        return invert_at_points(points, field, spacing, origin) if inverse else displaced(points, field, spacing, origin)
    return points


def drop_outside(vertices: np.ndarray, faces: np.ndarray, shape, spacing, origin) -> tuple[np.ndarray, np.ndarray]:
    """A mesh without the vertices that are more than a voxel outside of a grid; faces need all three."""
    low = np.asarray(origin) - spacing
    high = np.asarray(origin) + np.asarray(spacing) * np.asarray(shape)
    keep = ((vertices >= low) & (vertices <= high)).all(1)
    number = np.cumsum(keep) - 1
    ok = keep[faces].all(1) if len(faces) else np.zeros(0, bool)
    return vertices[keep], number[faces[ok]]


def mesh(vertices_um: np.ndarray, faces: np.ndarray, affine: np.ndarray, grid: tuple, clip: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A region's mesh from micrometres to the grid's millimetres, by the inverse of the stored pull transform."""
    v = transform_points(np.asarray(vertices_um, float) / 1000, affine, inverse=True)
    return drop_outside(v, np.asarray(faces), *grid) if clip else (v, np.asarray(faces))


def nearest_voxels(vertices: DataFrame, voxels: DataFrame, spacing: tuple[float, float, float], origin: tuple[float, float, float]) -> DataFrame:
    """vertices with the voxel that each one is nearest to: an equi join on rounded indices."""
    names = ("z", "y", "x")
    keyed = vertices.withColumns({f"{n}_idx": F.floor((F.col(n) - o) / s + 0.5).cast("int") for n, s, o in zip(names, spacing, origin, strict=True)})
    return keyed.join(voxels, [f"{n}_idx" for n in names], "left")
