"""The two encodings of a recording, and how to get from one to the other.

long: a row for each sample (recording_id?, voxel_id, t_idx, value). series: a row for each voxel with its whole time
course as an array, in order of t_idx. Operators that need only neighbours, windows or groups take the long one and stay
in SQL functions; linear algebra along time takes the series one, whose rows are spread over the cluster by voxel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

VOXEL, TIME, VALUE, SERIES = "voxel_id", "t_idx", "value", "series"


def to_series(samples: DataFrame, keys: tuple[str, ...] = (VOXEL,), time: str = TIME, value: str = VALUE) -> DataFrame:
    """One row for each voxel: its samples in order of time. A recording's length bounds a row."""
    packed = F.array_sort(F.collect_list(F.struct(time, value)))
    return samples.groupBy(*keys).agg(F.transform(packed, lambda x: x[value].cast("double")).alias(SERIES))


def to_long(series: DataFrame, time: str = TIME, value: str = VALUE) -> DataFrame:
    rest = [c for c in series.columns if c != SERIES]
    return series.select(*rest, F.posexplode(SERIES).alias(time, value))


def restore_singletons(samples: DataFrame, dims: tuple[str, ...] = ("z_idx", "y_idx", "x_idx")) -> DataFrame:
    """Missing spatial dimensions as one slice each."""
    return samples.withColumns({d: F.lit(0) for d in dims if d not in samples.columns})


def over_time(keys: tuple[str, ...] = (VOXEL,), time: str = TIME):
    return Window.partitionBy(*keys).orderBy(time)


def whole(keys: tuple[str, ...] = (VOXEL,)):
    return Window.partitionBy(*keys)


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def rows_of(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(0, n * width + 1, max(width, 1), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32), pa.array(np.ascontiguousarray(matrix).ravel(), pa.float64()))


def map_series(series: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], column: str = SERIES) -> DataFrame:
    """kernel(rows x time) -> rows x new time on batches of voxels; other columns stay. Voxels share one length."""
    names = series.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                new = rows_of(np.asarray(kernel(matrix_of(batch.column(at))), float))
                yield pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(len(names))], names=names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in series.schema)
    return series.mapInArrow(run, fields)


def apply_projection(series: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each voxel's time course times a small shared matrix (new time x time), which is sent to the tasks."""
    return map_series(series, lambda x: x @ matrix.T)


def temporal_gram(series: DataFrame, center: bool = False) -> np.ndarray:
    """Sum over voxels of series outer series: time x time on the driver, whatever the number of voxels.

    Each task sums its own voxels, and the sums are added up by cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                x = x - x.mean(1, keepdims=True) if center else x
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), rows_of(total)], names=["i", "row"])

    parts = series.select(SERIES).mapInArrow(run, "i long, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    found = cells.toPandas()  # time x time, bounded by the length of a window
    out = np.zeros((int(found["i"].max()) + 1,) * 2)
    out[found["i"], found["j"]] = found["x"]
    return out


def time_blocks(series: DataFrame, t: int, block: int):
    """Groups of all voxels over a block of times: b, voxel_id, x."""
    cut = F.transform(F.sequence(F.lit(0), F.lit((t - 1) // block)), lambda b: F.slice(SERIES, b * block + 1, F.lit(block)))
    return series.select(VOXEL, F.posexplode(cut).alias("b", "x")).groupBy("b")


def _block(frame: pd.DataFrame, mean: np.ndarray, block: int) -> np.ndarray:
    x = np.array(frame.sort_values(VOXEL)["x"].tolist(), float)
    start = int(frame["b"].iloc[0]) * block
    return x - mean[start : start + x.shape[1]]


def spatial_gram(series: DataFrame, mean: np.ndarray, block: int = 1024) -> np.ndarray:
    """Sum over times of voxels outer voxels, less the mean of each time: voxels in order, on the driver.

    For fewer voxels than times: the products of each block of times are added up by cell.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = _block(frame, mean, block)
        return pd.DataFrame({"i": np.arange(len(x)), "row": list(x @ x.T)})

    parts = time_blocks(series, len(mean), block).applyInPandas(run, "i long, row array<double>")
    found = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros((int(found["i"].max()) + 1,) * 2)
    out[found["i"], found["j"]] = found["x"]
    return out


def weighted_sum(series: DataFrame, mean: np.ndarray, weights: np.ndarray, block: int = 1024) -> np.ndarray:
    """Components x time: voxels in order, less the mean of each time, summed by weights (voxels x components)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = weights.T @ _block(frame, mean, block)
        return pd.DataFrame({"b": frame["b"].iloc[0], "i": np.arange(len(rows)), "row": list(rows)})

    found = time_blocks(series, len(mean), block).applyInPandas(run, "b int, i long, row array<double>").toPandas()
    out = np.zeros((weights.shape[1], len(mean)))
    for b, i, row in found.itertuples(index=False):
        out[i, b * block : b * block + len(row)] = row
    return out


#: Times or voxels up to which their own square matrix is small enough for the driver.
DIRECT = 1024


def gram_product(series: DataFrame, q: np.ndarray) -> np.ndarray:
    """Sum over voxels of x (x . q) for q of times x few: as large as q, whatever the numbers of voxels and times.

    Each task adds up its voxels, and the sums are added by time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0))
                part = x.T @ (x @ q)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), rows_of(total)], names=["t", "row"])

    parts = series.select(SERIES).mapInArrow(run, "t long, row array<double>")
    sums = parts.groupBy("t").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(q.shape[1])])
    found = sums.toArrow()
    out = np.zeros(q.shape)
    out[found.column("t").to_numpy()] = np.column_stack([found.column(f"c{j}").to_numpy() for j in range(q.shape[1])])
    return out


def top_eigenvectors(apply: Callable[[np.ndarray], np.ndarray], t: int, n: int, tolerance: float = 1e-10, passes: int = 200, blocks: int = 6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n largest eigenvalues and their vectors of a positive matrix that is known by its products alone.

    A block Krylov space with full orthogonalisation, restarted from its best vectors: 2 * blocks * (n + 4) columns at
    most. It ends when the residuals are below the tolerance times the largest eigenvalue, and raises if they stay above.
    """
    width = min(n + 4, t)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((t, width)))[0]
    basis, images = np.zeros((t, 0)), np.zeros((t, 0))
    for _ in range(passes):
        basis, images = np.hstack([basis, q]), np.hstack([images, apply(q)])
        small = basis.T @ images
        values, mix = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:width]
        values, mix = values[order], mix[:, order]
        best, moved = basis @ mix, images @ mix
        left = moved - best * values
        if basis.shape[1] >= t or np.linalg.norm(left[:, :n], axis=0).max() <= tolerance * max(abs(values[0]), 1e-300):
            return np.maximum(values[:n], 0), best[:, :n]
        if basis.shape[1] + width > blocks * width:
            basis, images = best, moved
        new = left
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        size = np.linalg.norm(new, axis=0)
        new = new[:, size > 1e-14 * max(abs(values[0]), 1e-300)]
        if not new.shape[1]:
            return np.maximum(values[:n], 0), best[:, :n]
        q = np.linalg.qr(new)[0]
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    raise ValueError(f"components didn't settle in {passes} passes")


def time_components(series: DataFrame, n: int, center: str | np.ndarray | None = None, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray, float]:
    """The n largest eigenvalues and vectors (times x n) of the sum over voxels of series outer series, and its trace.

    center: voxel takes off each voxel's mean in time, an array takes off a mean for each time. The smaller one of times
    and voxels has its square matrix on the driver while it is at most `direct`; beyond it, products with few columns
    are summed over voxels, and what the driver holds grows with the times alone.
    """
    mean = center if isinstance(center, np.ndarray) else None
    ready = series
    if center is not None:
        ready = map_series(series, (lambda x: x - mean) if mean is not None else (lambda x: x - x.mean(1, keepdims=True)))
    squares = F.aggregate(SERIES, F.lit(0.0), lambda a, x: a + x * x)
    voxels, t, trace = ready.agg(F.count(F.lit(1)), F.max(F.size(SERIES)), F.sum(squares)).first()
    if not voxels:
        raise ValueError("there are no voxels")
    n = min(n, t)
    if t <= direct:
        values, vectors = np.linalg.eigh(temporal_gram(ready))
        order = np.argsort(-values)[:n]
        return np.maximum(values[order], 0), vectors[:, order], float(trace)
    if voxels <= direct and n <= voxels:
        zero = np.zeros(t)
        values, weights = np.linalg.eigh(spatial_gram(ready, zero))
        order = np.argsort(-values)[:n]
        scale = np.sqrt(np.maximum(values[order], 0))
        vectors = weighted_sum(ready, zero, weights[:, order] / np.where(scale > 0, scale, 1)).T
        return np.maximum(values[order], 0), vectors, float(trace)
    kept = checkpointed(ready)
    values, vectors = top_eigenvectors(lambda q: gram_product(kept, q), t, n)
    return values, vectors, float(trace)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names; a private one only in local mode, where it names none."""
    import tempfile

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if place is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


class Ranks:
    """Rows dealt by ranges of an order: __range, __at (place in it) and __r (rank from 1), total rows in all."""

    def __init__(self, rows: DataFrame, counts: list[tuple[int, int]]) -> None:
        self.spark, self.ranges = rows.sparkSession, [k for k, _ in counts]
        self.total = sum(n for _, n in counts)
        before = np.concatenate([[0], np.cumsum([n for _, n in counts])[:-1]]).astype(int).tolist() if counts else []
        self.rows = self.carried(rows, "__before", before, "long").withColumn("__r", F.col("__before") + F.col("__at") + 1).drop("__before")

    def carried(self, rows: DataFrame, name: str, values: list, kind: str) -> DataFrame:
        """rows with one value for each range; there are as many ranges as partitions."""
        small = self.spark.createDataFrame(list(zip(self.ranges, values, strict=True)), f"__range int, {name} {kind}")
        return rows.join(F.broadcast(small), "__range", "left")

    def running(self, x, out: str, upward: bool) -> DataFrame:
        """The largest x so far in rising order, or the least so far in falling order."""
        rows = self.rows.withColumn("__x", x)
        best = F.max if upward else F.min
        each = dict(rows.groupBy("__range").agg(best("__x")).collect())  # a row for each range
        carried, so_far = {}, None
        for k in self.ranges if upward else self.ranges[::-1]:
            carried[k] = so_far
            so_far = each[k] if so_far is None else max(so_far, each[k]) if upward else min(so_far, each[k])
        rows = self.carried(rows, "__carried", [carried[k] for k in self.ranges], "double")
        inside = Window.partitionBy("__range").orderBy(F.col("__at") if upward else F.col("__at").desc())
        here = best("__x").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(out, (F.greatest if upward else F.least)(here, "__carried")).drop("__x", "__carried")


def ranked(df: DataFrame, *order: str) -> Ranks:
    """df in a global order without a single partition: sorted by ranges, whose sizes say where each one begins."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the partition above bit 33, the place in it below
    rows = checkpointed(rows.withColumns({"__range": F.shiftright(place, 33).cast("int"), "__at": place.bitwiseAND((1 << 33) - 1)}))
    return Ranks(rows, sorted((r[0], r[1]) for r in rows.groupBy("__range").count().collect()))


def order_statistics(df: DataFrame, column: str, ranks: list[int], few: int = 200_000, bins: int = 1024) -> list[float]:
    """Values of these ranks (from 0) among the finite values of a column, in rising order.

    Each round counts the values by bins of the range that is left and goes on with the bin that holds the rank, until
    few are left or all are equal; only those are sorted. A pass needs no more room than its bins.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    out = []
    for rank in ranks:
        part, left = values, rank
        while True:
            low, high, n = part.agg(F.min("x"), F.max("x"), F.count("x")).first()
            if not 0 <= left < n:
                raise ValueError(f"rank {rank} is beyond the values")
            if low == high:
                out.append(low)
                break
            if n <= few:
                out.append(part.agg(F.sort_array(F.collect_list("x")).alias("s")).select(F.element_at("s", left + 1)).first()[0])
                break
            width = (high - low) / bins
            place = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int") if width > 0 else (F.col("x") == F.lit(high)).cast("int")
            counts = sorted(part.groupBy(place.alias("k")).count().collect())  # `bins` rows at most
            for k, m in counts:
                if left < m:
                    break
                left -= m
            part = part.filter(place == F.lit(k))
    return out


def exact_quantile(df: DataFrame, column: str, q: float, few: int = 200_000) -> float | None:
    """The q-quantile of a column's finite values, on the line between neighbours; None without any."""
    x = F.col(column).cast("double")
    n = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))).count()
    if not n:
        return None
    at = q * (n - 1)
    low = int(np.floor(at))
    values = order_statistics(df, column, [low] if at == low else [low, low + 1], few)
    return values[0] + (values[-1] - values[0]) * (at - low)
