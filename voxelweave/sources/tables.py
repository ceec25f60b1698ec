"""Tables that describe recordings: events, physiological signals, slice times."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scale import normalize_trial_type
from .bids import load_sidecars

def load_events(spark: SparkSession, path: str) -> DataFrame:
    """onset, duration, trial_type, extras of tab-separated files; onset and duration must be numbers, duration not negative."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="n/a")
    missing = {"onset", "duration"} - set(raw.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    kind = normalize_trial_type(F.col("trial_type")) if "trial_type" in raw.columns else F.lit("dummy")
    extras = [c for c in raw.columns if c not in ("onset", "duration", "trial_type")]
    out = raw.select(number("onset").alias("onset"), number("duration").alias("duration"), kind.alias("trial_type"), *extras)
    if out.filter("onset IS NULL OR duration IS NULL OR duration < 0").limit(1).count():
        raise ValueError("onset and duration must be numbers, and durations not negative")
    return out


def save_events(events: DataFrame, path: str) -> None:
    """Sorted by onset, tab-separated, missing values as n/a."""
    first = [c for c in ("onset", "duration", "trial_type") if c in events.columns]
    events.select(*first, *[c for c in events.columns if c not in first]).orderBy("onset").write.csv(path, sep="\t", header=True, nullValue="n/a", mode="overwrite")


def load_physio(spark: SparkSession, path: str, sidecar: dict | None = None) -> DataFrame:
    """path, i, time and the sidecar's columns of tables without a header; time from StartTime and SamplingFrequency if absent.

    Without `sidecar`, each file's own one lies beside it as .json; all of them name the same columns, while starts and
    rates may differ. Rows are numbered within their file: block by block, from counts of the blocks before. A row of
    another width, or with what isn't a number, raises when it is read.
    """
    plain = lambda c: F.regexp_replace(c, r"(\.tsv(\.gz)?|\.json)$", "")
    files = None
    if sidecar is None:
        told = load_sidecars(spark, re.sub(r"\.tsv(\.gz)?$", ".json", path))
        files = told.select(plain("path").alias("__file"), F.from_json("text", "Columns array<string>, StartTime double, SamplingFrequency double").alias("s")).select("__file", "s.*")
        names = [list(r.Columns or []) for r in files.select("Columns").distinct().limit(2).collect()]
        if len(names) != 1:
            raise ValueError("the sidecars name different columns")
        columns = names[0]
    else:
        columns = list(sidecar.get("Columns") or [])
    if not columns:
        raise ValueError("the sidecar names no columns")
    schema = ", ".join(f"`{c}` double" for c in columns)
    rows = spark.read.csv(path, sep="\t", header=False, schema=schema, nullValue="n/a", mode="FAILFAST")
    rows = rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__m"))
    if files is not None and rows.select(plain("path").alias("__file")).distinct().join(files, "__file", "left_anti").limit(1).count():
        raise FileNotFoundError("a table has no sidecar")
    counts = rows.groupBy("path", "__block").agg(F.count(F.lit(1)).alias("n"))  # a row for each block, not for each sample
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = F.row_number().over(Window.partitionBy("path", "__block").orderBy("__m")) - 1
    numbered = rows.withColumn("__here", here).join(counts.select("path", "__block", before.alias("__before")), ["path", "__block"])
    numbered = numbered.withColumn("i", F.col("__before") + F.col("__here"))
    if "time" in columns:
        return numbered.select("path", "i", *[F.col(f"`{c}`") for c in columns])
    if files is None:
        rate, start = sidecar.get("SamplingFrequency"), sidecar.get("StartTime", 0.0)
        if isinstance(rate, bool) or not isinstance(rate, (int, float)) or rate <= 0 or not isinstance(start, (int, float)):
            raise ValueError("without a column of times, SamplingFrequency must be a positive number and StartTime a number")
        time = F.lit(float(start)) + F.col("i") / float(rate)
    else:
        if files.filter("SamplingFrequency IS NULL OR SamplingFrequency <= 0").limit(1).count():
            raise ValueError("without a column of times, SamplingFrequency must be a positive number")
        numbered = numbered.withColumn("__file", plain("path")).join(files.drop("Columns"), "__file")
        time = F.coalesce("StartTime", F.lit(0.0)) + F.col("i") / F.col("SamplingFrequency")
    return numbered.select("path", "i", time.alias("time"), *[F.col(f"`{c}`") for c in columns])


def json_safe(value):
    """Numpy values as JSON has them; what JSON can't hold raises TypeError."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    json.dumps(value)
    return value


def restore_affines(attrs: dict) -> dict:
    """Nested lists of the affines as arrays again."""
    return {**attrs, "affines": {k: np.asarray(v, float) for k, v in attrs.get("affines", {}).items()}}


def slice_times(times: DataFrame, timing: list[float], direction: str = "z") -> DataFrame:
    """t_idx, z_idx, slice_time: the volume's time plus the slice's; a direction with - counts from the end."""
    order = timing[::-1] if direction.endswith("-") else timing
    table = times.sparkSession.createDataFrame(list(enumerate(map(float, order))), "z_idx int, shift double")
    return times.crossJoin(F.broadcast(table)).select("t_idx", "z_idx", (F.col("time") + F.col("shift")).alias("slice_time"))


def slice_timing(slice_times_: DataFrame, times: DataFrame, tolerance: float = 1e-6) -> list[float]:
    """The way back: one shift for each slice, which must be the same in all volumes."""
    d = slice_times_.join(times, "t_idx").groupBy("z_idx").agg(F.min(F.col("slice_time") - F.col("time")).alias("a"), F.max(F.col("slice_time") - F.col("time")).alias("b"))
    rows = sorted(d.collect())  # one row for each slice
    if any(r.b - r.a > tolerance for r in rows):
        raise ValueError("slice timings differ between volumes")
    return [r.a for r in rows]


def structures_to_json(structures: DataFrame) -> str:
    rows = structures.select("id", "acronym", "name", "path").orderBy("id").collect()  # a region hierarchy
    return json.dumps([{"id": r.id, "acronym": r.acronym, "name": r.name, "structure_id_path": list(r.path)} for r in rows])


def structures_from_json(spark: SparkSession, blob: str) -> DataFrame:
    rows = [(x["id"], x["acronym"], x["name"], x["structure_id_path"]) for x in json.loads(blob)]
    return spark.createDataFrame(rows, "id long, acronym string, name string, path array<long>")
