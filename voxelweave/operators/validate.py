"""Rules that recordings must keep, checked by aggregates: each check is one pass and one small row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .layout import TIME, VALUE, VOXEL

CORE = ("time", "pose", "z", "y", "x")


class Invalid(ValueError):
    """A recording breaks a rule."""


def check(condition: bool, message: str) -> None:
    if not condition:
        raise Invalid(message)


def coordinate_problems(coords: DataFrame) -> DataFrame:
    """dim, rule of each broken rule of coordinates (dim, idx, coord, units?, voxdim?)."""
    w = Window.partitionBy("dim").orderBy("idx")
    x = F.col("coord")
    marked = coords.withColumn("__d", x - F.lag("coord").over(w))
    rules = marked.groupBy("dim").agg(
        F.max(F.isnan("coord") | (F.abs("coord") == float("inf")) | x.isNull()).alias("not finite"),
        F.max(F.coalesce(F.col("__d") <= 0, F.lit(False))).alias("not increasing"),
        *([F.max(F.col("units").isNull()).alias("no units")] if "units" in coords.columns else []),
        *([((F.count(F.lit(1)) == 1) & F.max(F.col("voxdim").isNull())).alias("single slice without voxdim")] if "voxdim" in coords.columns else []),
    )
    names = [c for c in rules.columns if c != "dim"]
    pairs = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(False)).alias("broken")) for n in names]), lambda r: r["broken"]))
    return rules.select("dim", pairs.alias("r")).select("dim", "r.rule")


def validate_recording(coords: DataFrame, require_time: bool = False, tolerance: float | None = None) -> None:
    found = coordinate_problems(coords).collect()  # a row for each dimension and rule at most
    check(not found, "; ".join(f"{r.dim}: {r.rule}" for r in found))
    dims = {r.dim for r in coords.select("dim").distinct().collect()}
    check({"z", "y", "x"} <= dims, f"dimensions are missing: {sorted({'z', 'y', 'x'} - dims)}")
    check(not require_time or "time" in dims, "time is missing")
    if tolerance is not None and "time" in dims:
        validate_uniform(coords.filter("dim = 'time'"), tolerance)


def validate_uniform(coords: DataFrame, tolerance: float = 0.01, coord: str = "coord") -> float:
    from .series import representative_step

    row = representative_step(coords, coord, tolerance).first()
    check(row is not None, "two samples or more are needed")
    check(not row["non_uniform"], "steps aren't uniform")
    return row["step"]


def validate_matching_coordinates(left: DataFrame, right: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> None:
    """Equal coordinates (dim, idx, coord) within tolerances, joined on dimension and index, never on floats."""
    both = left.select("dim", "idx", F.col("coord").alias("a")).join(right.select("dim", "idx", F.col("coord").alias("b")), ["dim", "idx"], "full_outer")
    bad = both.filter("a IS NULL OR b IS NULL").limit(1).count()
    check(not bad, "coordinates are missing on one side")
    check(not both.filter(F.abs(F.col("a") - F.col("b")) > atol + rtol * F.abs("b")).limit(1).count(), "coordinates differ")


def validate_mask(mask: DataFrame, samples: DataFrame, value: str = "value") -> DataFrame:
    """voxel_id of a mask whose values are boolean or have one label beside 0; its voxels must be among the samples'."""
    if value in mask.columns:
        if mask.schema[value].dataType.simpleString() != "boolean":
            check(mask.filter(F.col(value) != 0).select(value).distinct().limit(2).count() <= 1, "a mask has one label at most")
            mask = mask.filter(F.col(value) != 0)
        else:
            mask = mask.filter(value)
    check(not mask.join(samples.select(VOXEL).distinct(), VOXEL, "left_anti").limit(1).count(), "the mask has voxels that the data lack")
    return mask.select(VOXEL)


def validate_labels(labels: DataFrame) -> None:
    check(labels.schema["region"].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint"), "labels must be integers")


def validate_iq(samples: DataFrame, meta: dict | None = None, velocity: bool = False) -> None:
    kind = samples.schema[VALUE].dataType.simpleString()
    check(kind == "struct<re:double,im:double>" or kind == "struct<re:float,im:float>", f"values must be complex (struct re, im), not {kind}")
    check(not velocity or {"transmit_frequency", "sound_velocity"} <= set(meta or {}), "transmit_frequency and sound_velocity are needed")


def validate_time_series(samples: DataFrame, time: str = TIME) -> None:
    """Each voxel has every time once, and there are two times or more."""
    n = samples.select(time).distinct().count()
    check(n > 1, "two samples or more are needed")
    bad = samples.groupBy(VOXEL).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(time).alias("d")).filter((F.col("n") != n) | (F.col("d") != n))
    check(not bad.limit(1).count(), "voxels lack times or have them twice")


def spacings(coords: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """dim, spacing, origin: the median step (null if not uniform, voxdim for a single slice) and the first coordinate."""
    w = Window.partitionBy("dim").orderBy("idx")
    steps = coords.withColumn("d", F.col("coord") - F.lag("coord").over(w))
    typical = steps.groupBy("dim").agg(F.median("d").alias("step"), F.min_by("coord", "idx").alias("origin"), *([F.first("voxdim", True).alias("voxdim")] if "voxdim" in coords.columns else [F.lit(None).cast("double").alias("voxdim")]))
    off = steps.join(typical.select("dim", "step"), "dim").groupBy("dim").agg(F.max(F.abs(F.col("d") - F.col("step")) > tolerance * F.abs("step")).alias("off"))
    return typical.join(off, "dim").select("dim", F.when(F.col("step").isNull(), F.col("voxdim")).when(~F.col("off"), F.col("step")).alias("spacing"), F.coalesce("origin", F.lit(0.0)).alias("origin"))


def consensus(metas: list[dict]) -> dict:
    """Attributes that all have with equal values."""
    return {k: v for k, v in metas[0].items() if all(k in m and m[k] == v for m in metas[1:])} if metas else {}


def ensure_recording(samples: DataFrame, coords: DataFrame, **rules) -> DataFrame:
    """samples with all spatial dimensions, once their coordinates keep the rules."""
    from .layout import restore_singletons

    validate_recording(coords, **rules)
    return restore_singletons(samples)


def ensure_iq(samples: DataFrame, coords: DataFrame, meta: dict | None = None, velocity: bool = False) -> DataFrame:
    """Complex samples with all spatial dimensions, once they and their coordinates keep the rules."""
    validate_iq(samples, meta, velocity)
    return ensure_recording(samples, coords, require_time=True)


def validate_atlas(voxels: DataFrame, structures: DataFrame, affines: DataFrame | None = None) -> None:
    """Voxels (voxel_id, reference, annotation, hemisphere) of an atlas, and affines (name, m) that agree by name."""
    check({VOXEL, "reference", "annotation", "hemisphere"} <= set(voxels.columns), "reference, annotation and hemisphere are needed")
    for name in ("annotation", "hemisphere"):
        check(voxels.schema[name].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint"), f"{name} must be integers")
    check(voxels.schema["reference"].dataType.simpleString() in ("float", "double"), "the reference must be floating point")
    check(not voxels.filter(~F.col("hemisphere").isin(0, 1, 2)).limit(1).count(), "hemispheres are 1 (left), 2 (right) or 0")
    unknown = voxels.filter("annotation <> 0").select(F.col("annotation").cast("long").alias("id")).distinct().join(structures.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
    check(not unknown.limit(1).count(), "annotations name structures that aren't there")
    if affines is not None:
        check(not affines.groupBy("name").agg(F.count_distinct("m").alias("n")).filter("n > 1").limit(1).count(), "affines of one name differ")


def validate_matching_units(coords: list[DataFrame]) -> dict[str, str]:
    """Units by spatial dimension, which all recordings must share; a recording may lack them."""
    every = None
    for c in coords:
        part = c.filter(F.col("dim").isin("z", "y", "x") & F.col("units").isNotNull()).select("dim", "units").distinct()
        every = part if every is None else every.union(part)
    rows = every.groupBy("dim").agg(F.collect_set("units").alias("units")).collect()  # three dimensions
    check(all(len(r.units) == 1 for r in rows), f"units differ: {sorted((r.dim, sorted(r.units)) for r in rows)}")
    return {r.dim: r.units[0] for r in rows}


def grid_info(coords: DataFrame, dims: tuple[str, ...] = ("z", "y", "x")) -> dict:
    """shape, spacing, origin and dims of a recording's grid; a dimension without one step is an error."""
    counts = {r[0]: r[1] for r in coords.groupBy("dim").count().collect()}
    found = {r.dim: r for r in spacings(coords).collect()}
    missing = [d for d in dims if d not in found or found[d].spacing is None]
    check(not missing, f"no spacing is defined for {missing}")
    return {"shape": tuple(counts[d] for d in dims), "spacing": tuple(found[d].spacing for d in dims), "origin": tuple(found[d].origin for d in dims), "dims": dims}


def validate_whole_time(samples: DataFrame) -> None:
    """Operators that need all of a voxel's times at once take the series encoding, where a row has them."""
    check("series" in samples.columns and samples.schema["series"].dataType.simpleString().startswith("array"), "the series encoding is needed: see to_series")


def validate_confounds(samples: DataFrame, confounds: DataFrame, time: str = TIME) -> list[str]:
    """Names of the confounds (a row for each time, a column for each): they must have just the samples' times, finite."""
    names = [c for c in confounds.columns if c != time]
    check(bool(names), "there are no confounds")
    check(not confounds.groupBy(time).count().filter("count > 1").limit(1).count(), "a time has several rows of confounds")
    mine, theirs = samples.select(time).distinct(), confounds.select(time)
    check(not mine.join(theirs, time, "left_anti").limit(1).count() and not theirs.join(mine, time, "left_anti").limit(1).count(), "the times of confounds and samples differ")
    bad = [F.max(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in names]
    row = confounds.agg(*bad).first()
    check(not any(row), f"confounds aren't finite: {[c for c, b in zip(names, row, strict=True) if b]}")
    return names


def validate_mask_layers(layers: DataFrame, layer: str = "layer", value: str = "region") -> None:
    """Each layer of stacked masks has one value beside 0."""
    found = layers.groupBy(layer).agg(F.count_distinct(F.when(F.col(value) != 0, F.col(value))).alias("n"))
    check(not found.filter("n <> 1").limit(1).count(), "a layer has no value beside 0, or several")


def energy_cutoffs(low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """Cutoffs as numbers: none are 0 and infinity; not negative, the low one below the high one."""
    a, b = 0.0 if low is None else float(low), float("inf") if high is None else float(high)
    check(a >= 0 and b >= 0, "energy cutoffs aren't negative")
    check(a < b, f"the low cutoff {a} must be below the high one {b}")
    return a, b


def validate_targets(targets: DataFrame, samples: DataFrame, time: str = TIME) -> None:
    """Targets have each of the samples' times once, and no null."""
    mine = samples.select(time).distinct()
    check(not targets.groupBy(time).count().filter("count > 1").limit(1).count(), "a time has several targets")
    check(not targets.filter(F.col("target").isNull()).limit(1).count(), "a target is null")
    check(not mine.join(targets, time, "full_outer").filter(F.col("target").isNull()).limit(1).count() and mine.count() == targets.count(), "the times of targets and samples differ")
