"""Operator 11 against a plain exact version in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.llm import centroids as op


def plain(rows, k=8, rounds=10, dim=64, scale=1024, seed="3:"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), b in zip(kept, of) if b == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    of = [near(v) for _, v in kept]
    d = [far(v, c[b]) for (_, v), b in zip(kept, of)]
    return sorted((i, b, x, sum(y for y, e in zip(d, of) if e == b), sum(d), hashlib.sha256(",".join(map(str, c[b])).encode()).hexdigest()) for (i, _), b, x in zip(kept, of, d))


def found(spark, rows, kind="float", **how):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"x": F.lit("q"), "cluster": F.lit("other"), "distance": F.lit(None).cast("string")})
    return sorted(tuple(r) for r in op.cluster(df.repartition(3), **how).collect())


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1 + i % 3, 6).astype(np.float32).tolist()) for i in range(200)]
    assert found(spark, rows, k=5, dim=6, rounds=4) == plain(rows, k=5, dim=6, rounds=4)


def test_ties_repeats_and_rows_that_are_not_kept(spark):
    rows = [(i, [float(i % 2), float(i % 3)]) for i in range(40)] + [(7, [1.0, 1.0])] * 3
    bad = [(100, None), (101, [1.0]), (102, [1.0, None]), (103, [1.0, float("nan")]), (104, [float("inf"), 0.0]), (105, [1.0, 2.0, 3.0]), (106, [])]
    got = found(spark, rows + bad, k=6, dim=2, rounds=3)
    assert got == plain(rows, k=6, dim=2, rounds=3)


def test_few_and_no_vectors(spark):
    assert found(spark, [(1, [0.5, -0.5]), (2, [0.5, -0.5])], k=8, dim=2) == plain([(1, [0.5, -0.5]), (2, [0.5, -0.5])], k=8, dim=2)
    assert found(spark, [], k=8, dim=2) == []
    assert found(spark, [(1, [0.5])], k=8, dim=2) == []


def test_without_id(spark):
    rows = [(1, [0.0, 0.0]), (2, [9.0, 9.0]), (None, [8.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["cluster"] for r in op.cluster(df, k=3, dim=2).collect()}
    assert got[None] == got[2] != got[1]


def test_large_components(spark):
    rows = [(i, [2.0**20 * (i % 5), -(2.0**30) - i, 3.0]) for i in range(30)]
    assert found(spark, rows, "double", k=3, dim=3, rounds=3) == plain(rows, k=3, dim=3, rounds=3)
    assert found(spark, [(1, [1e300, 0.0, 0.0])], "double", k=3, dim=3) == []


@pytest.mark.parametrize("size", [10, 10**4, 10**7, 10**9])
def test_intervals_hold_the_exact_distance(size):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-size, size, (300, 64)), rng.integers(-size, size, (9, 64))
    low, high = op.intervals(x, c)
    exact = (c.astype(object) ** 2).sum(1)[None, :] - 2 * (x.astype(object) @ c.astype(object).T)
    assert ((low.astype(object) <= exact) & (exact <= high.astype(object))).all()


def test_overlapping_intervals_are_decided_exactly():
    base = np.random.default_rng(2).integers(10**5, 10**6, 64)
    c = np.stack([base, base + 0, base + 1])
    c[1, 0] += 1  # nearer than float32 can tell
    x = np.stack([c[1], c[0], c[2], c[1]])
    best, opened = op.nearest(x, c)
    assert best.tolist() == [1, 0, 2, 1] and opened >= 2
    assert op.nearest(base[None, :], np.stack([base, base]))[0].tolist() == [0]  # a tie


def test_result_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 4).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    runs = [sorted(tuple(r) for r in op.cluster(df.repartition(n), k=4, dim=4).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
