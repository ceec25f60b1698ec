"""Elementwise functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NAN = float("nan")
#: Aliases of time units and their factors to seconds; where in a volume its time stands.
SECONDS = {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "ms": 1e-3, "millisecond": 1e-3, "milliseconds": 1e-3, "us": 1e-6, "µs": 1e-6, "microsecond": 1e-6, "microseconds": 1e-6}
REFERENCE = {"start": 0.0, "center": 0.5, "end": 1.0}


def log_scale(x: Column) -> Column:
    """Natural logarithm; 0 gives -inf, negative values NaN."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN))


def power_scale(x: Column, exponent: float = 0.5) -> Column:
    return F.pow(F.abs(x), F.lit(exponent))


def magnitude(z: Column) -> Column:
    """Absolute value of a struct re, im."""
    return F.hypot(z["re"], z["im"])


def db_scale(df: DataFrame, value: str = "value", factor: float = 10.0, out: str = "db") -> DataFrame:
    """factor * log10(|x| / largest |x|); 0 gives -inf. The largest value is one row, which is broadcast."""
    top = df.agg(F.max(F.abs(value)).alias("__top"))
    ratio = F.abs(F.col(value)) / F.col("__top")
    return df.crossJoin(F.broadcast(top)).withColumn(out, F.when(ratio > 0, factor * F.log10(ratio)).otherwise(F.lit(float("-inf")))).drop("__top")


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def scale_min_max(df: DataFrame, value: str = "value", out: str = "scaled") -> DataFrame:
    """(x - min) / (max - min) over finite values; a flat input gives 0, infinities the ends, NaN stays."""
    x = F.col(value)
    ends = df.filter(is_finite(x)).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    inside = F.when(F.col("__hi") == F.col("__lo"), F.lit(0.0)).otherwise((x - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    scaled = F.when(F.isnan(x), x).when(x == float("inf"), F.lit(1.0)).when(x == float("-inf"), F.lit(0.0)).otherwise(inside)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def time_factor(unit: str, strict: bool = False) -> float:
    """Factor to seconds; an unknown unit has 1 unless strict."""
    if unit not in SECONDS and strict:
        raise ValueError(f"unknown time unit {unit!r}; known: {', '.join(SECONDS)}")
    return SECONDS.get(unit, 1.0)


def convert_time_units(x: Column, from_unit: str, to_unit: str = "s", strict: bool = False) -> Column:
    return x * (time_factor(from_unit, strict) / time_factor(to_unit, strict))


def convert_time_reference(time: Column, duration: Column | float, from_reference: str, to_reference: str) -> Column:
    step = REFERENCE[to_reference] - REFERENCE[from_reference]
    return time + F.lit(step) * duration


def normalize_trial_type(x: Column, default: str = "dummy") -> Column:
    """Blank and missing labels become the default one."""
    bare = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    return F.when(bare.isin("", "n/a", "N/A", "nan", "NaN"), F.lit(default)).otherwise(bare)


def threshold_value(x: Column, threshold: float, keep: str = "above") -> Column:
    """x where |x| is at least (above) or at most (below) the threshold, otherwise null."""
    return F.when(F.abs(x) >= threshold if keep == "above" else F.abs(x) <= threshold, x)


def in_triangle(i: Column, j: Column, part: str = "lower") -> Column:
    """Whether cell i, j belongs to a part of a matrix: full, lower, upper, diag_lower or diag_upper."""
    return {"full": F.lit(True), "lower": i > j, "upper": i < j, "diag_lower": i >= j, "diag_upper": i <= j}[part]
