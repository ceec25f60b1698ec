"""Reductions over time, voxels and regions: SQL aggregates and windows over samples, products of matrices over series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .layout import TIME, VALUE, VOXEL, checkpointed, exact_quantile, matrix_of, over_time, to_series, whole

#: Region reductions by name; spreads have the number of voxels as divisor.
REDUCTIONS = {"mean": F.avg, "sum": F.sum, "median": F.median, "min": F.min, "max": F.max, "var": F.var_pop, "std": F.stddev_pop}


def ratio(a: Column, b: Column) -> Column:
    """a / b as floating point has it: over zero, infinity or NaN."""
    zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(a / b)


def extract_with_labels(samples: DataFrame, labels: DataFrame, reduction: str = "mean", time: str = TIME, value: str = VALUE) -> DataFrame:
    """t_idx, region, value: each region's reduction at each time.

    labels has voxel_id, region; region 0 is background. Regions may overlap: a voxel counts in each one. The join
    is on the voxel; Spark broadcasts the labels only where their size allows, and the aggregate is partial before
    its shuffle, so a region with most of the voxels doesn't end in one task.
    """
    if reduction not in REDUCTIONS:
        raise ValueError(f"unknown reduction {reduction!r}; known: {', '.join(REDUCTIONS)}")
    held = samples.join(labels.filter(F.col("region") != 0).select(VOXEL, "region"), VOXEL)
    return held.groupBy(time, "region").agg(REDUCTIONS[reduction](value).alias(value))


def compute_tsnr(samples: DataFrame, value: str = VALUE) -> DataFrame:
    """Mean over standard deviation in time of each voxel."""
    return samples.groupBy(VOXEL).agg(ratio(F.avg(value), F.stddev_pop(value)).alias("tsnr"))


def compute_cv(samples: DataFrame, value: str = VALUE) -> DataFrame:
    """Standard deviation over mean in time of each voxel."""
    return samples.groupBy(VOXEL).agg(ratio(F.stddev_pop(value), F.avg(value)).alias("cv"))


def remove_zero_variance(samples: DataFrame, tolerance: float = 1e-10, value: str = VALUE) -> DataFrame:
    """Samples of the voxels whose standard deviation (n - 1) is above the tolerance."""
    kept = samples.groupBy(VOXEL).agg(F.stddev_samp(value).alias("sd")).filter(F.col("sd") > tolerance).select(VOXEL)
    return samples.join(kept, VOXEL, "left_semi")


def ar1_coefficients(samples: DataFrame, value: str = VALUE, time: str = TIME) -> DataFrame:
    """voxel_id, ar1, sigma2 by Yule-Walker with autocovariances over n; without variance 0 and NaN."""
    x = F.col(value) - F.avg(value).over(whole())
    centred = samples.select(VOXEL, time, x.alias("c")).withColumn("before", F.lag("c").over(over_time(time=time)))
    sums = centred.groupBy(VOXEL).agg(F.sum(F.col("c") * F.col("c")).alias("c0"), F.sum(F.col("c") * F.col("before")).alias("c1"), F.count("c").alias("n"))
    rho = F.when(F.col("c0") == 0, 0.0).otherwise(F.coalesce("c1", F.lit(0.0)) / F.col("c0"))
    sigma = F.when(F.col("c0") == 0, F.lit(float("nan"))).otherwise((F.col("c0") - rho * F.coalesce("c1", F.lit(0.0))) / F.col("n"))
    return sums.select(VOXEL, rho.alias("ar1"), sigma.alias("sigma2"))


def _lower_quantile(q: float, value: str) -> Column:
    """The sample at position floor(q (n - 1)) in order; as many values as a recording has times."""
    ordered = F.array_sort(F.collect_list(value))
    return F.element_at(ordered, (F.floor(F.lit(q) * (F.size(ordered) - 1)) + 1).cast("int"))


#: Distance of the quartiles of a normal distribution of unit deviation.
NORMAL_QUARTILES = 1.3489795003921634


def robust_deviation(samples: DataFrame, value: str = VALUE) -> DataFrame:
    """voxel_id, sd: the distance of the lower quartiles of each voxel's samples, as a normal deviation."""
    apart = _lower_quantile(0.75, value) - _lower_quantile(0.25, value)
    return samples.groupBy(VOXEL).agg((apart / NORMAL_QUARTILES).alias("sd"))


def compute_dvars(samples: DataFrame, standardize: bool = True, normalization: float = 1000.0, tolerance: float | None = 1e-10, value: str = VALUE, time: str = TIME) -> DataFrame:
    """t_idx, dvars: root mean square over voxels of the change from the time before; the first is the least other one.

    Voxels whose robust deviation isn't above the tolerance are left out. Not standardised, values are scaled so that
    the median over all samples is `normalization`. Standardised, DVARS is divided by the mean over voxels of
    sqrt(2 (1 - ar1)) times the robust deviation.
    """
    data = samples.select(VOXEL, time, F.col(value).alias("v"))
    spread = robust_deviation(data, "v")
    if tolerance is not None:
        spread = spread.filter(F.col("sd") > tolerance)
        data = data.join(spread.select(VOXEL), VOXEL, "left_semi")
    steps = data.withColumn("d", F.col("v") - F.lag("v").over(over_time(time=time)))
    raw = steps.groupBy(time).agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("dvars"))
    if standardize:
        factor = spread.join(ar1_coefficients(data, "v", time), VOXEL).agg((1 / F.avg(F.sqrt(2 * (1 - F.col("ar1"))) * F.col("sd"))).alias("f"))
    else:
        factor = None
    least = raw.agg(F.min("dvars").alias("least"))  # null at the first time is left out
    out = raw.crossJoin(F.broadcast(least))
    if factor is None:
        out = out.withColumn("f", F.lit(normalization / exact_quantile(data, "v", 0.5)))
    else:
        out = out.crossJoin(F.broadcast(factor))
    return out.select(time, (F.coalesce("dvars", "least") * F.col("f")).alias("dvars"))


#: Numbers of seed signals that are sent to all tasks; more are joined by time.
SEED_VALUES = 4_000_000


def seed_correlation(samples: DataFrame, seeds: DataFrame, value: str = VALUE, time: str = TIME) -> DataFrame:
    """region, voxel_id, r: correlation in time of every voxel with every seed signal (t_idx, region, value).

    Both sides are centred; a signal without variance has correlation 0. Times that either side lacks don't count. Seed
    signals are counted first: as one small matrix they meet each batch of voxels in one product. If they are many, or
    voxels differ in their times, each voxel's sample meets each seed's value of the same time instead.
    """
    x = samples.select(VOXEL, F.col(time).alias("t"), F.col(value).cast("double").alias("v"))
    s = checkpointed(seeds.select("region", F.col(time).alias("t"), F.col("value").cast("double").alias("v")))
    n, regions, times = s.agg(F.count("v"), F.countDistinct("region"), F.countDistinct("t")).first()
    if n <= SEED_VALUES and n == regions * times:
        table = s.toPandas().pivot(index="region", columns="t", values="v")
        packed = checkpointed(x.groupBy(VOXEL).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("p")).select(VOXEL, F.col("p.t").alias("t"), F.col("p.v").alias("v")))
        ends = packed.agg(F.min("t"), F.max("t"), F.bool_and(F.forall("v", lambda y: y.isNotNull()))).first()
        if ends[0] is not None and list(ends[0]) == list(ends[1]) == table.columns.tolist() and ends[2] and not table.isna().any(axis=None):
            return _seed_products(packed.select(VOXEL, "v"), table)
    x = x.withColumn("v", F.col("v") - F.avg("v").over(whole()))
    s = s.select("region", "t", (F.col("v") - F.avg("v").over(Window.partitionBy("region"))).alias("s"))
    sums = x.join(s, "t").groupBy("region", VOXEL).agg(F.sum(F.col("v") * F.col("s")).alias("xs"), F.sum(F.col("v") * F.col("v")).alias("xx"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    norm = F.sqrt(F.col("xx") * F.col("ss"))
    return sums.select("region", VOXEL, F.when(norm == 0, 0.0).otherwise(F.col("xs") / norm).alias("r"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows without their mean, over their length; 0 where nothing is left."""
    c = x - x.mean(1, keepdims=True)
    size = np.sqrt((c * c).sum(1, keepdims=True))
    return c / np.where(size > 0, size, 1)


def _seed_products(series: DataFrame, table: pd.DataFrame) -> DataFrame:
    seeds, regions = _unit(table.to_numpy(float)), pa.array(table.index.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = _unit(matrix_of(batch.column(1))) @ seeds.T
                voxel = batch.column(0).take(pa.array(np.repeat(np.arange(len(r)), len(seeds))))
                yield pa.RecordBatch.from_arrays([regions.take(pa.array(np.tile(np.arange(len(seeds)), len(r)))), voxel, pa.array(r.ravel())], names=["region", VOXEL, "r"])

    kinds = {"i": "int" if table.index.dtype.itemsize <= 4 else "long"}.get(table.index.dtype.kind, "string")
    return series.mapInArrow(run, f"region {kinds}, {VOXEL} {series.schema[VOXEL].dataType.simpleString()}, r double")


def seed_based_maps(samples: DataFrame, seed_masks: DataFrame, reduction: str = "mean", mask: DataFrame | None = None) -> DataFrame:
    """seed_correlation with the signals of labelled regions; voxels outside of the mask have 0."""
    seeds = extract_with_labels(samples, seed_masks, reduction)
    out = seed_correlation(samples, seeds)
    if mask is None:
        return out
    inside = mask.select(VOXEL, F.lit(True).alias("__in")).distinct()
    return out.join(inside, VOXEL, "left").select("region", VOXEL, F.when(F.col("__in"), F.col("r")).otherwise(0.0).alias("r"))


#: Voxels of a block whose products with another block one task makes.
BLOCK = 512


def covariance(samples: DataFrame, value: str = VALUE, time: str = TIME, kind: str = "covariance", block: int = BLOCK) -> DataFrame:
    """i, j, value: covariance (over n) or correlation of every pair of voxels or regions in time, both halves.

    Each one becomes an array of its samples. Voxels are dealt into blocks, each pair of blocks meets once in one task
    and is one product of matrices, so a sample is sent once for each block and not for each other voxel. Voxels must
    have the same times.
    """
    s = to_series(samples.select(VOXEL, F.col(time).alias(TIME), F.col(value).alias(VALUE)))
    s = checkpointed(s)
    n = s.count()
    count = max(1, -(-n // block))
    mine = F.pmod(F.xxhash64(VOXEL), F.lit(count))
    other = F.sequence(F.lit(0), F.lit(count - 1))
    sent = s.select(VOXEL, "series", mine.alias("b"), F.explode(other).alias("o"))
    sent = sent.select(VOXEL, "series", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        def side(k: int) -> tuple[np.ndarray, np.ndarray]:
            part = frame[frame["b"] == k]
            m = np.array(part["series"].tolist(), float).reshape(len(part), -1)
            return part[VOXEL].to_numpy(), m - m.mean(1, keepdims=True) if len(part) else m

        x, y = int(frame["x"].iloc[0]), int(frame["y"].iloc[0])
        (a, p), (b, q) = side(x), side(y)
        if not len(a) or not len(b):
            return pd.DataFrame({"i": [], "j": [], "value": []}).astype({"value": float})
        found = pd.DataFrame({"i": np.repeat(a, len(b)), "j": np.tile(b, len(a)), "value": (p @ q.T / p.shape[1]).ravel()})
        return found if x == y else pd.concat([found, found.rename(columns={"i": "j", "j": "i"})])[["i", "j", "value"]]

    id_ = s.schema[VOXEL].dataType.simpleString()
    cells = sent.groupBy("x", "y").applyInPandas(run, f"i {id_}, j {id_}, value double")
    return covariance_to_correlation(checkpointed(cells)) if kind == "correlation" else cells


def covariance_to_correlation(cells: DataFrame) -> DataFrame:
    """value over the square root of both diagonal cells; the diagonal is 1."""
    diagonal = cells.filter("i = j")
    a, b = diagonal.select("i", F.col("value").alias("a")), diagonal.select("j", F.col("value").alias("b"))
    return cells.join(a, "i").join(b, "j").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("value") / F.sqrt(F.col("a") * F.col("b"))).alias("value"))


def precision_to_partial_correlation(cells: DataFrame) -> DataFrame:
    out = covariance_to_correlation(cells)
    return out.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(-F.col("value")).alias("value"))


def vectorize_triangle(cells: DataFrame, discard_diagonal: bool = False) -> DataFrame:
    """k, value: the lower triangle row by row; the diagonal over sqrt(2), unless it is left out."""
    i, j = F.col("i"), F.col("j")
    if discard_diagonal:
        return cells.filter("i > j").select((i * (i - 1) / 2 + j).cast("long").alias("k"), "value")
    return cells.filter("i >= j").select((i * (i + 1) / 2 + j).cast("long").alias("k"), F.when(i == j, F.col("value") / F.sqrt(F.lit(2.0))).otherwise(F.col("value")).alias("value"))


def framewise_displacement(affines: DataFrame, points: DataFrame, time: str = TIME) -> DataFrame:
    """t_idx, mean_fd, max_fd, rms_fd: how far points move from each frame's affine to the next one's; the last is 0.

    affines: t_idx, m (rows of a 4x4 matrix); points: px, py, pz. Frames are few and points many: each frame's pair
    of matrices is joined to all points, which is the result's own work, and summed before the shuffle.
    """
    w = Window.orderBy(time)  # frames of one recording
    pairs = affines.select(time, "m", F.lead("m").over(w).alias("next"))
    p = [F.col("px"), F.col("py"), F.col("pz")]
    both = points.crossJoin(F.broadcast(pairs))

    def moved(row: int) -> Column:
        here, there = (sum((F.col(c)[row][k] * p[k] for k in range(3)), F.col(c)[row][3]) for c in ("m", "next"))
        return there - here

    d2 = sum((moved(r) * moved(r) for r in range(1, 3)), moved(0) * moved(0))
    d = F.sqrt(F.coalesce(d2, F.lit(0.0)))
    return both.groupBy(time).agg(F.avg(d).alias("mean_fd"), F.max(d).alias("max_fd"), F.sqrt(F.avg(d * d)).alias("rms_fd"))
