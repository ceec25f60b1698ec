"""Centroid clustering whose result is exact although it multiplies in float32.

A vector's components are integers. A float32 matrix product gives every squared distance up to a rounding error that
has a proven bound, so each distance lies in an interval. Centroids whose interval meets the least one are the
shortlist; where more than one is left, exact integers decide, and of equal distances the lowest number wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, plain_reads

#: Components below this in size have distances to each other that fit 64 bits for up to 256 dimensions.
SMALL = 1 << 26
#: Vectors with a component of this size or more aren't kept: their distances don't fit a long.
LARGE = 1 << 52
#: Unit roundoff of float32, and one part in a thousand for the float64 arithmetic of the bounds themselves.
ROUNDOFF, SLACK = 2.0**-24, 1.001
#: Rows that are compared with the centroids at once.
ROWS = 4096


def intervals(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of |c|^2 - 2 x.c, the squared distance but for |x|^2, from one float32 product.

    Rounding both factors to float32 and adding up `dim` products in any order leaves an error of at most
    gamma = m u / (1 - m u) times |x|.|c|, with m = dim + 2, which is at most gamma times the product of their norms.
    The norms and the last two operations are float64; SLACK covers them many times over.
    """
    m = x.shape[1] + 2
    gamma = m * ROUNDOFF / (1 - m * ROUNDOFF)
    product = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    xf, cf = x.astype(np.float64), centroids.astype(np.float64)
    squares = (cf**2).sum(1)
    middle = squares - 2 * product
    norms = np.sqrt((xf**2).sum(1))[:, None] * np.sqrt(squares)
    error = SLACK * (2 * gamma * norms + 2.0**-48 * (squares + 2 * norms) + 2.0**-100)
    return middle - error, middle + error


def exact_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to the row of centroids beside it: 64 bits where they suffice, else Python integers."""
    if x.size and max(np.abs(x).max(), np.abs(centroids).max()) >= SMALL or x.shape[1] > 256:
        x, centroids = x.astype(object), centroids.astype(object)
    return ((x - centroids) ** 2).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row's nearest centroid, and how many rows exact integers had to decide."""
    low, high = intervals(x, centroids)
    listed = low <= high.min(1)[:, None]
    best = listed.argmax(1)
    open_rows = np.flatnonzero(listed.sum(1) > 1)
    if len(open_rows):
        row, number = np.nonzero(listed[open_rows])  # in order of row, then number
        d = exact_distances(x[open_rows[row]], centroids[number])
        least: dict[int, tuple[int, int]] = {}
        for r, k, v in zip(row.tolist(), number.tolist(), d.tolist()):
            if r not in least or v < least[r][0]:  # of equal distances the first number stays
                least[r] = (v, k)
        best[open_rows] = [least[r][1] for r in range(len(open_rows))]
    return best, len(open_rows)


def _packed(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `dim` finite components below LARGE, and these rows as integers."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    fit = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(fit)).flatten().cast(pa.float64())
    v = values.to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null component becomes nan
    with np.errstate(invalid="ignore", over="ignore"):
        v = np.floor(scale * v)
        good = (np.abs(v) < LARGE).all(1)
    return fit[good], v[good].astype(np.int64)


def kept_vectors(vectors: DataFrame, dim: int, scale: int, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and x, the integers of each kept vector as bytes of 4 or 8 each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _packed(batch.column(1), dim, scale)
            narrow = (np.abs(x) < 1 << 31).all(1)
            data = [(r.astype("<i4") if s else r.astype("<i8")).tobytes() for r, s in zip(x, narrow)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(data, pa.binary())], names=["vec_id", "x"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("x")).mapInArrow(run, f"vec_id {kind}, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most ROWS rows with their integers."""
    for whole in batches:
        for k in range(0, whole.num_rows, ROWS):
            batch = whole.slice(k, ROWS)
            data = batch.column(1).to_pylist()
            if all(len(b) == 4 * dim for b in data):
                x = np.frombuffer(b"".join(data), "<i4").reshape(-1, dim).astype(np.int64)
            else:
                x = np.array([np.frombuffer(b, "<i4" if len(b) == 4 * dim else "<i8") for b in data], np.int64).reshape(-1, dim)
            yield batch, x


def first_centroids(kept: DataFrame, k: int, seed: str, dim: int) -> np.ndarray:
    """The k vectors whose ids hash lowest; of rows with one id the smallest bytes go first."""
    rows = kept.filter(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([np.frombuffer(bytes(r["x"]), "<i4" if len(r["x"]) == 4 * dim else "<i8") for r in rows], np.int64).reshape(-1, dim)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's mean of its vectors, rounded down; one that has none stays. Each task adds up its own first."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for _, x in _blocks(batches, dim):
            best, _ = nearest(x, centroids)
            counts += np.bincount(best, minlength=len(centroids))
            for c in np.unique(best):  # below LARGE * ROWS, so 64 bits hold a block's sum only after a split
                mine = x[best == c]
                sums[c] += (mine >> 26).sum(0).astype(object) * (1 << 26) + (mine & (SMALL - 1)).sum(0).astype(object)
        full = np.flatnonzero(counts)
        c, i = np.repeat(full, dim), np.tile(np.arange(dim), len(full))
        total = pa.array([Decimal(int(v)) for v in sums[full].ravel()], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), total, pa.array(np.repeat(counts[full], dim), pa.int64())], names=["c", "i", "s", "n"])

    out = centroids.copy()
    for r in kept.mapInArrow(run, "c int, i int, s decimal(38,0), n long").groupBy("c", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():  # k * dim rows
        out[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return out


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance (null where a long can't hold it) of each kept vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, dim):
            best, _ = nearest(x, centroids)
            d = exact_distances(x, centroids[best])
            if d.dtype == object:
                d = [int(v) if v < 1 << 63 else None for v in d]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Kept are vectors of `dim` components, none of them null or not finite; each component becomes floor(scale * x).
    The first centroids are the vectors whose `seed` and id hash lowest. Every round assigns all vectors and moves all
    centroids; then all are assigned once more. Only k centroids and k * dim sums come to the driver, whatever the rows.

    Vectors without an id are assigned, but start no centroid. Rows with one id each count. Where fewer than k vectors
    are kept, there are as many centroids; equal vectors give equal centroids, of which the lowest number has all.
    Vectors with a component of 2^52 or more after scaling aren't kept; a distance or sum beyond 64 bits is null. No
    kept vectors with an id give no rows. Other columns aren't looked at.
    """
    spark = vectors.sparkSession
    plain_reads(spark)
    kept = cut(kept_vectors(vectors, dim, scale))
    centroids = first_centroids(kept, k, seed, dim)
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids, before = moved(kept, centroids), centroids
        if np.array_equal(centroids, before):  # nothing moves any more
            break
    rows = assigned(kept, centroids)
    big = F.sum(F.col("distance").cast("decimal(38,0)"))
    complete = F.count("distance") == F.count(F.lit(1))
    sums = {r["cluster"]: (int(r["s"]) if r["whole"] else None) for r in rows.groupBy("cluster").agg(big.alias("s"), complete.alias("whole")).collect()}  # k rows
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    total = None if None in sums.values() else sum(sums.values())
    names = [(int(c), fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
