"""Selection by masks, scatter back to a grid, and array idioms over the long encoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .layout import TIME, VALUE, VOXEL, checkpointed, exact_quantile, ranked


def extract_with_mask(samples: DataFrame, mask: DataFrame) -> DataFrame:
    """Samples of the mask's voxels."""
    return samples.join(mask.select(VOXEL).distinct(), VOXEL, "left_semi")


def unmask(signals: DataFrame, grid: DataFrame, fill: float = 0.0, time: str = TIME, value: str = VALUE) -> DataFrame:
    """A value for each voxel of the grid (voxel_id) at each time of the signals: the signal's, or the fill value."""
    times = signals.select(time).distinct()
    full = grid.select(VOXEL).distinct().crossJoin(F.broadcast(times))
    return full.join(signals.select(VOXEL, time, value), [VOXEL, time], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def label_slice(df: DataFrame, dim: str, low, high) -> DataFrame:
    """Rows whose coordinate is between two labels, both included."""
    return df.filter(F.col(dim).between(low, high))


def position(df: DataFrame, dim: str, index: int) -> DataFrame:
    return df.filter(F.col(dim) == index)


def reduce(df: DataFrame, keep: list[str], how: str = "avg", value: str = VALUE) -> DataFrame:
    """Reduction over all dimensions but those to keep."""
    return df.groupBy(*keep).agg(getattr(F, how)(value).alias(value))


def where(df: DataFrame, condition, value: str = VALUE) -> DataFrame:
    return df.withColumn(value, F.when(condition, F.col(value)).otherwise(F.lit(float("nan"))))


def quantile_cut(df: DataFrame, q: float, value: str = VALUE) -> DataFrame:
    """Rows at or above an exact quantile."""
    cut = exact_quantile(df, value, q)
    return df.filter(F.col(value) >= F.lit(cut))


def concat_mean(frames: list[DataFrame], keys: list[str], value: str = VALUE) -> DataFrame:
    """Mean over a new dimension along which equal grids are put together."""
    both = frames[0].select(*keys, value)
    for f in frames[1:]:
        both = both.unionByName(f.select(*keys, value))
    return both.groupBy(*keys).agg(F.avg(value).alias(value))


def stack_lags(maps: dict[float, DataFrame]) -> DataFrame:
    out = None
    for lag, m in maps.items():
        m = m.withColumn("lag", F.lit(lag))
        out = m if out is None else out.unionByName(m)
    return out


def merge_on_time(frames: dict[str, DataFrame], time: str = "time", value: str = VALUE) -> DataFrame:
    """One column for each frame, on all times of any of them."""
    out = None
    for name, f in frames.items():
        f = f.select(time, F.col(value).alias(name))
        out = f if out is None else out.join(f, time, "full_outer")
    return out


def sync_plan(remote: DataFrame, local: DataFrame, refresh: bool = False) -> DataFrame:
    """path, reason of the remote files to fetch: those that aren't there, and on refresh those with another hash."""
    new = remote.join(local.select("path"), "path", "left_anti").select("path", F.lit("missing").alias("reason"))
    if not refresh:
        return new
    there = local.select("path", F.col("hash").alias("__h"))
    return new.union(remote.join(there, "path").filter(~F.col("hash").eqNullSafe(F.col("__h"))).select("path", F.lit("changed").alias("reason")))


def merge_indexes(*indexes: DataFrame, key: str = "path") -> DataFrame:
    """key, the columns of any index, and source (from 0): each key with its row of the last index that has it.

    One aggregate over all rows, of which tasks send one row for each key that they have. Of rows of one index with
    equal keys the largest one counts, column by column, nulls last; a null key is a key like others. A column that
    an index lacks is null for its rows. Indexes without rows add nothing.
    """
    names = list(dict.fromkeys(c for x in indexes for c in x.columns if c != key))
    rows = None
    for k, x in enumerate(indexes):
        x = x.withColumn("__source", F.lit(k))
        rows = x if rows is None else rows.unionByName(x, allowMissingColumns=True)
    best = rows.groupBy(key).agg(F.max(F.struct("__source", *names)).alias("__best"))
    return best.select(key, *(F.col("__best")[c].alias(c) for c in names), F.col("__best")["__source"].alias("source"))


def index_downloads(members: DataFrame, present: DataFrame, previous: DataFrame, refresh: bool = False) -> DataFrame:
    """path, reason of the members (path, hash) to fetch: those that aren't among the present paths, and on refresh
    present ones whose hash isn't the one they were fetched with, as the previous index (path, hash) has it.

    A present member that the previous index doesn't have, or has without a hash, is fetched again on refresh. Present
    paths may repeat; of repeated ones of the previous index the largest hash counts. Members without a path are missing.
    """
    there = present.select("path").distinct()
    if refresh:
        there = there.join(merge_indexes(previous.select("path", "hash")).drop("source"), "path", "left")
    return sync_plan(members, there, refresh)


def group_spans(df: DataFrame, order: str, group: str) -> DataFrame:
    """group, first, last, n of each run of equal groups in order.

    Rows are dealt by ranges of the order; what a range ends with and how many runs begin before it go on to the next.
    """
    ranks = ranked(df.select(order, group), order)
    inside = Window.partitionBy("__range").orderBy("__at")
    last = dict(ranks.rows.groupBy("__range").agg(F.max_by(F.struct(F.col(group).alias("g")), "__at")).collect())  # a row for each range
    before = [None, *(last[k].g for k in ranks.ranges)][: len(ranks.ranges)]
    rows = ranks.carried(ranks.rows, "__g", before, df.schema[group].dataType.simpleString())
    earlier = F.when(F.col("__at") == 0, F.col("__g")).otherwise(F.lag(group).over(inside))
    begins = (F.col("__r") == 1) | ~F.col(group).eqNullSafe(earlier)
    rows = checkpointed(rows.withColumn("__n", F.sum(begins.cast("long")).over(inside)))
    most = dict(rows.groupBy("__range").agg(F.max("__n")).collect())
    shift = np.concatenate([[0], np.cumsum([most[k] for k in ranks.ranges])])[: len(ranks.ranges)].astype(int).tolist()
    marked = ranks.carried(rows, "__s", shift, "long").withColumn("__run", F.col("__n") + F.col("__s"))
    return marked.groupBy("__run", group).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def filter_files(files: DataFrame, **entities: str | list[str] | None) -> DataFrame:
    """Files (path) whose entities, as in sub-01_ses-02, are among those asked for.

    A file without an entity isn't left out by it, and files at the top level always stay.
    """
    name = F.element_at(F.split("path", "/"), -1)
    keep = F.lit(True)
    for entity, wanted in entities.items():
        if wanted is not None:
            found = F.regexp_extract("path", rf"(?:^|[/_]){entity}-([A-Za-z0-9]+)", 1)
            keep = keep & ((found == "") | found.isin([wanted] if isinstance(wanted, str) else list(wanted)))
    return files.filter(keep | (name == F.col("path")))
