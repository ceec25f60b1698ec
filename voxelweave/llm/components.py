"""Connected components of links, by contraction on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Links that one task labels; more are contracted on the cluster.
TASK_LINKS = 500_000


def joined(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """Each node's top: one node of its component, by union with path halving."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := top.setdefault(x, x)) != x:
            top[x] = x = top[up]
        return x

    for a, b in pairs:
        top[find(a)] = find(b)
    return {x: find(x) for x in list(top)}


def in_one_task(links: DataFrame) -> DataFrame:
    """node, comp of the nodes of links that are counted few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = joined([p for batch in batches for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (found, found.values())], names=["node", "comp"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, comp long")


def components(links: DataFrame, labels: DataFrame | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """node and comp of all nodes of the links (a, b: long), comp being one node of the component.

    Up to `task_links` links that are left between parts are labelled by one task. Beyond that, each round gives every
    part the first part that it has a link with, in an order by hash, as its parent, lets it go up four parents at
    most, and puts these in place of parts in the links; links within a part go. By that order about a third of the
    parts of any chain are first among their neighbours and few trees of parents are deeper, so rounds are about as
    many as the logarithm of a chain's length. `labels` are the node, comp rows of earlier links,
    which stay joined. Nothing reaches the driver but how many links are left.
    """
    keyed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    apart = lambda e, x, y: e.filter(F.col(x) != F.col(y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if labels is None:
        labels = ends.select("node", F.col("node").alias("comp"))
        edges = links
    else:
        at, to = labels.toDF("a", "x"), labels.toDF("b", "y")
        edges = links.join(at, "a", "left").join(to, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
        labels = labels.unionByName(ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp")))
    edges = cut(apart(edges.select(keyed("a").alias("x"), keyed("b").alias("y")), "x", "y"))
    while left := edges.count():
        if left <= task_links:
            found = in_one_task(edges.select(F.col("a.n").alias("a"), F.col("b.n").alias("b")))
            labels = labels.join(found.toDF("comp", "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
            break
        parent = edges.groupBy("a").agg(F.min("b").alias("up"))
        for _ in range(2):
            parent = cut(parent)
            parent = parent.join(parent.toDF("up", "top"), "up", "left").select("a", F.coalesce("top", "up").alias("up"))
        parent = cut(parent)
        labels = labels.join(parent.select(F.col("a.n").alias("comp"), F.col("up.n").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp"))
        at, to = parent.toDF("a", "x"), parent.toDF("b", "y")
        edges = edges.join(at, "a").join(to, "b", "left").select("x", F.coalesce("y", "b").alias("y"))  # each a has a parent
        edges = cut(apart(edges, "x", "y"))
    return cut(labels)
