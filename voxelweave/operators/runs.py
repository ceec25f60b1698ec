"""First-level models of any number of runs in one plan.

Everything is keyed by run: volume times, events and confounds are tables, each condition of a run is convolved in a
group of its own, a design is the columns that one run has, and voxels meet the design of their run. Contrasts are
resolved against each run's own columns and pooled over runs, so a thousand runs are no more plan than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import glm, masks
from .layout import SERIES, TIME, VALUE, VOXEL, rows_of, to_series
from .series import cosine_drift, smooth_volume

RUN = "run"
#: Numbers in designs up to which all designs go to all tasks; beyond it voxels are grouped by run.
DESIGN_VALUES = 8_000_000
#: Groups that the voxels of a run are dealt into beyond that.
GROUPS = 64

COLUMNS = "run {run}, place int, regressor string, x array<double>"
FITTED = "run {run}, voxel_id {voxel}, columns array<string>, theta array<double>, covariance array<double>, dispersion double, dof double"


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def condition_columns(times: DataFrame, events: DataFrame, model="glover", fir_delays: list[int] | None = None, oversampling: int = 50, min_onset: float = -24.0) -> DataFrame:
    """run, place, regressor, x: the response of each condition of each run, in order of the conditions' names.

    times: run, t_idx, time; events: run, onset, duration, and perhaps trial_type and modulation. One task holds the
    events of one condition of one run. A run without events of a condition that others have has no such column.
    """
    one = glm.dedup_events(events, (RUN,))
    packed = one.groupBy(RUN, "trial_type").agg(F.array_sort(F.collect_list(F.struct("onset", "duration", "modulation"))).alias("e"))
    clock = times.groupBy(RUN).agg(F.transform(F.array_sort(F.collect_list(F.struct(TIME, "time"))), lambda x: x["time"].cast("double")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name, t = batch.column(1)[k].as_py(), np.array(batch.column(3)[k].as_py(), float)
                found = glm.condition_regressors(pd.DataFrame(batch.column(2)[k].as_py()), t, model, fir_delays, oversampling, min_onset)
                names = [f"{name}_delay_{(fir_delays or [0])[j]}" if model == "fir" else name for j in range(len(found))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(found))), pa.array([0] * len(found), pa.int32()), pa.array(names), rows_of(np.array(found))], names=[RUN, "place", "regressor", "x"])

    return packed.join(clock, RUN).select(RUN, "trial_type", "e", "t").mapInArrow(run, COLUMNS.format(run=_kind(times, RUN)))


def drift_columns(times: DataFrame, drift: str | None = "cosine", low_cutoff: float = 0.01, drift_order: int = 1) -> DataFrame:
    """run, place, regressor, x: slow drifts and the constant of each run, by its own length and step."""
    if drift not in (None, "cosine", "polynomial"):
        raise ValueError(f"unknown drift {drift!r}; known: cosine, polynomial, None")
    clock = times.groupBy(RUN).agg(F.transform(F.array_sort(F.collect_list(F.struct(TIME, "time"))), lambda x: x["time"].cast("double")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                t = np.array(batch.column(1)[k].as_py(), float)
                rows: list[tuple[int, str, np.ndarray]] = []
                if drift == "cosine":
                    d = cosine_drift(len(t), low_cutoff, glm.sampling_interval(t))
                    rows = [(2, f"drift_{j + 1}", d[:, j]) for j in range(d.shape[1] - 1)]
                elif drift == "polynomial":
                    p = glm.orthogonalize(np.vander(np.linspace(-0.5, 0.5, len(t)), drift_order + 1, increasing=True))
                    rows = [(2, f"drift_{j}", p[:, j]) for j in range(1, drift_order + 1)]
                rows.append((3, "constant", np.ones(len(t))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows))), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), rows_of(np.array([r[2] for r in rows]))], names=[RUN, "place", "regressor", "x"])

    return clock.mapInArrow(run, COLUMNS.format(run=_kind(times, RUN)))


def confound_columns(confounds: DataFrame) -> DataFrame:
    """run, place, regressor, x: each other column of confounds (run, t_idx, ...), in its run's order of time."""
    names = [c for c in confounds.columns if c not in (RUN, TIME)]
    long = confounds.select(RUN, TIME, F.explode(F.array(*[F.struct(F.lit(c).alias("regressor"), F.col(f"`{c}`").cast("double").alias("v")) for c in names])).alias("c")).select(RUN, TIME, "c.*")
    bad = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    sure = F.when(bad, F.raise_error(F.lit("a confound isn't finite")).cast("double")).otherwise(F.col("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct(TIME, "v"))), lambda x: x["v"])
    return long.withColumn("v", sure).groupBy(RUN, "regressor").agg(packed.alias("x")).select(RUN, F.lit(1).alias("place"), "regressor", "x")


def designs(times: DataFrame, events: DataFrame | None = None, confounds: DataFrame | None = None, model="glover", drift: str | None = "cosine", low_cutoff: float = 0.01, drift_order: int = 1, **response) -> DataFrame:
    """run, columns (names), x (as many arrays along time): the design of each run.

    Conditions by name, then confounds by name, drifts, the constant. Two columns of one name in a run, or columns of
    different lengths, raise.
    """
    rows = drift_columns(times, drift, low_cutoff, drift_order)
    if events is not None:
        rows = rows.unionByName(condition_columns(times, events, model, **response))
    if confounds is not None:
        rows = rows.unionByName(confound_columns(confounds))
    number = F.coalesce(F.regexp_extract("regressor", r"^drift_(\d+)$", 1).try_cast("int"), F.lit(0))
    late = F.coalesce(F.regexp_extract("regressor", r"_delay_(-?\d+)$", 1).try_cast("int"), F.lit(0))
    stem = F.regexp_replace("regressor", r"_delay_-?\d+$|^drift_\d+$", "")
    packed = rows.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct("place", stem.alias("stem"), number.alias("n"), late.alias("late"), "regressor", "x"))).alias("c"))
    columns, x = F.col("c.regressor"), F.col("c.x")
    checked = (
        F.when(F.size(F.array_distinct(columns)) < F.size(columns), F.raise_error(F.concat(F.lit("two regressors have one name: "), F.array_join(columns, ", "))))
        .when(F.size(F.array_distinct(F.transform(x, lambda v: F.size(v)))) > 1, F.raise_error(F.lit("regressors of one run have different lengths")))
        .otherwise(columns)
    )
    return packed.select(RUN, checked.cast("array<string>").alias("columns"), x.alias("x"))


def given_designs(table: DataFrame) -> DataFrame:
    """run, columns, x from a table of designs: run, t_idx, and a column for each regressor, in the table's order."""
    names = [c for c in table.columns if c not in (RUN, TIME)]
    packed = F.array_sort(F.collect_list(F.struct(TIME, *[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(names)])))
    by = table.groupBy(RUN).agg(packed.alias("p"))
    return by.select(RUN, F.array(*[F.lit(c) for c in names]).alias("columns"), F.array(*[F.col(f"p.c{k}") for k in range(len(names))]).alias("x"))


def _fit_block(d: glm.Design, y: np.ndarray) -> list[pa.Array]:
    if y.shape[1] != len(d.x):
        raise ValueError(f"a series of {y.shape[1]} times meets a design of {len(d.x)}")
    theta, cov, dispersion = d.fit(y)
    return [rows_of(theta), rows_of(cov.reshape(len(y), -1)), pa.array(dispersion), pa.array(np.full(len(y), float(d.dof)))]


def fit(series: DataFrame, design: DataFrame, noise: str = "ols", few: int = DESIGN_VALUES) -> DataFrame:
    """run, voxel_id, columns, theta, covariance (flat), dispersion, dof of each series (run, voxel_id, series).

    Up to `few` numbers, all designs go to all tasks and series stay where they are; beyond it, series are grouped by run
    and a hash of the voxel, and each group meets the one design of its run. A run without a design is an error.
    """
    order = glm.noise_order(noise)
    kinds = {"run": _kind(series, RUN), "voxel": _kind(series, VOXEL)}
    size = design.select(F.sum(F.size("columns") * F.size(F.get("x", F.lit(0))))).first()[0] or 0
    if size <= few:
        # by run: (columns, matrix); counted above
        known = {r[RUN]: (list(r["columns"]), np.array([list(c) for c in r["x"]], float).T) for r in design.collect()}
        made: dict = {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = np.array([str(k) for k in batch.column(0).to_pylist()])
                for key in dict.fromkeys(batch.column(0).to_pylist()):
                    if key not in known:
                        raise ValueError(f"run {key!r} has no design")
                    columns, x = known[key]
                    if key not in made:
                        made.clear()  # batches come by run, so one design at a time is enough
                        made[key] = glm.Design(x, order)
                    at = pa.array(np.flatnonzero(keys == str(key)))
                    part = batch.take(at)
                    y = np.array(part.column(2).to_pylist(), float)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([columns] * len(y), pa.list_(pa.string())), *_fit_block(made[key], y)], names=[RUN, VOXEL, "columns", "theta", "covariance", "dispersion", "dof"])

        return series.select(RUN, VOXEL, SERIES).mapInArrow(run, FITTED.format(**kinds))
    lacking = F.when(F.col("columns").isNull(), F.raise_error(F.concat(F.lit("a run has no design: "), F.col(RUN).cast("string")))).otherwise(F.col("columns"))
    seen = series.select(RUN).distinct().join(design, RUN, "left").select(F.col(RUN).alias("r"), lacking.cast("array<string>").alias("columns"), "x")
    dealt = seen.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1))))
    voxels = series.select(RUN, VOXEL, SERIES).withColumn("g", F.pmod(F.xxhash64(VOXEL), F.lit(GROUPS)).cast("int"))

    def both(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c: [] for c in (RUN, VOXEL, "columns", "theta", "covariance", "dispersion", "dof")}, dtype=object)
        d = glm.Design(np.array(right["x"].iloc[0].tolist(), float).T, order)
        theta, cov, dispersion, dof = (a.to_pylist() for a in _fit_block(d, np.array(left[SERIES].tolist(), float)))
        return pd.DataFrame({RUN: left[RUN], VOXEL: left[VOXEL], "columns": [list(right["columns"].iloc[0])] * len(left), "theta": theta, "covariance": cov, "dispersion": dispersion, "dof": dof})

    return voxels.groupBy(RUN, "g").cogroup(dealt.groupBy("r", "h")).applyInPandas(both, FITTED.format(**kinds))


def contrast(fitted: DataFrame, definition, kind: str | None = None) -> DataFrame:
    """run, voxel_id, effects, variance, dof of a contrast in each run, resolved against the run's own columns.

    One row gives one effect; several rows, or kind F, give effects whitened so that the sum of their squares over their
    number and the variance is F.
    """
    names = [RUN, VOXEL, "effects", "variance", "dof"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = ["\0".join(c) for c in batch.column(2).to_pylist()]
            for one in dict.fromkeys(lists):
                part = batch.take(pa.array([i for i, c in enumerate(lists) if c == one]))
                columns = one.split("\0")
                c = np.atleast_2d(glm.contrast_vector(definition, columns))
                theta = np.array(part.column(3).to_pylist(), float)
                cov = np.array(part.column(4).to_pylist(), float).reshape(len(theta), len(columns), len(columns))
                dispersion = part.column(5).to_numpy()
                spread = c @ cov @ c.T
                if len(c) == 1 and kind != "F":
                    effects, variance = theta @ c.T, spread[:, 0, 0] * dispersion
                else:
                    effects, variance = np.einsum("vpq,vp->vq", np.linalg.cholesky(np.linalg.pinv(spread)), theta @ c.T), dispersion
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), rows_of(effects), pa.array(variance, pa.float64()), part.column(6)], names=names)

    columns = fitted.select(RUN, VOXEL, "columns", "theta", "covariance", "dispersion", "dof")
    return columns.mapInArrow(run, f"run {_kind(fitted, RUN)}, voxel_id {_kind(fitted, VOXEL)}, effects array<double>, variance double, dof double")


def pooled(contrasts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Fixed effects over runs: effects summed over their number, variances over its square, degrees of freedom summed.

    keys: columns besides the voxel, such as a subject, whose runs are pooled apart. A voxel must be in all runs of its
    keys; others are left out.
    """
    runs = contrasts.select(RUN, *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    each = contrasts.select(RUN, VOXEL, *keys, "variance", "dof", F.posexplode("effects").alias("row", "e"))
    rows = each.groupBy(VOXEL, *keys, "row").agg(F.sum("e").alias("e"), F.sum("variance").alias("v"), F.sum("dof").alias("dof"), F.count(F.lit(1)).alias("k"))
    both = rows.join(F.broadcast(runs), list(keys)) if keys else rows.crossJoin(F.broadcast(runs))  # one row, or one for each key
    whole = both.filter(F.col("k") == F.col("n"))
    effects = F.transform(F.array_sort(F.collect_list(F.struct("row", (F.col("e") / F.col("n")).alias("e")))), lambda x: x["e"])
    return whole.groupBy(VOXEL, *keys).agg(effects.alias("effects"), (F.first("v") / F.first(F.col("n") * F.col("n"))).alias("variance"), F.first("dof").alias("dof"))


def predictions(series: DataFrame, fitted: DataFrame, design: DataFrame) -> DataFrame:
    """run, voxel_id, t_idx, predicted, residual: what the design says of each sample, and what it leaves."""
    cells = design.select(RUN, F.posexplode("x").alias("k", "c")).select(RUN, "k", F.posexplode("c").alias(TIME, "x"))
    theta = fitted.select(RUN, VOXEL, F.posexplode("theta").alias("k", "b"))
    said = theta.join(cells, [RUN, "k"]).groupBy(RUN, VOXEL, TIME).agg(F.sum(F.col("b") * F.col("x")).alias("predicted"))
    samples = series.select(RUN, VOXEL, F.posexplode(SERIES).alias(TIME, VALUE))
    return samples.join(said, [RUN, VOXEL, TIME]).select(RUN, VOXEL, TIME, "predicted", (F.col(VALUE) - F.col("predicted")).alias("residual"))


class RunsModel:
    """Designs, fits and contrasts of any number of runs.

    model, drift, low_cutoff, drift_order, noise and response options as in the functions above. smoothing (fwhm in the
    units of `spacing`) needs samples with z_idx, y_idx, x_idx and the grid's shape.
    """

    def __init__(self, model="glover", drift: str | None = "cosine", low_cutoff: float = 0.01, drift_order: int = 1, noise: str = "ar1", smoothing: float | None = None, shape: tuple[int, int, int] | None = None, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), **response) -> None:
        self.model, self.drift, self.low_cutoff, self.drift_order, self.noise = model, drift, low_cutoff, drift_order, noise
        self.smoothing, self.shape, self.spacing, self.response = smoothing, shape, spacing, response

    def fit(self, samples: DataFrame, times: DataFrame | None = None, events: DataFrame | None = None, confounds: DataFrame | None = None, given: DataFrame | None = None, mask: DataFrame | None = None) -> RunsModel:
        """samples: run, voxel_id, t_idx, value; times: run, t_idx, time; given: whole designs in place of all else.

        mask (voxel_id, keep) is applied after smoothing, so that voxels outside still smooth into those inside.
        """
        if given is not None and (events is not None or confounds is not None):
            raise ValueError("given designs leave no place for events or confounds")
        if given is None and times is None:
            raise ValueError("designs need the volumes' times")
        if self.smoothing:
            if self.shape is None:
                raise ValueError("smoothing needs the grid's shape")
            place = samples.select(VOXEL, "z_idx", "y_idx", "x_idx").distinct()
            samples = smooth_volume(samples, self.shape, self.smoothing, self.spacing, keys=(RUN, TIME)).join(place, ["z_idx", "y_idx", "x_idx"])
        if mask is not None:
            samples = masks.extract_with_mask(samples, mask)
        self.series = to_series(samples, (RUN, VOXEL))
        self.designs = given_designs(given) if given is not None else designs(times, events, confounds, self.model, self.drift, self.low_cutoff, self.drift_order, **self.response)
        self.results = fit(self.series, self.designs, self.noise)
        return self

    def contrast(self, definition, kind: str | None = None, baseline: float = 0.0, keys: DataFrame | None = None) -> DataFrame:
        """voxel_id, effect (F: effects), variance, dof, statistic, p, one_minus_p, z over all runs; kind: t or F.

        keys: run and what its runs are pooled by, such as the subject; by default all runs are pooled.
        """
        each = contrast(self.results, definition, kind)
        by = tuple(c for c in keys.columns if c != RUN) if keys is not None else ()
        both = pooled(each.join(F.broadcast(keys), RUN) if keys is not None else each, by)  # one row for each run
        rows = 1 if isinstance(definition, str) else len(np.atleast_2d(np.asarray(definition, float)))
        if kind == "F" or rows > 1:
            if by:
                raise ValueError("F over keys isn't pooled apart: filter the runs of one key")
            return glm.f_statistic(both, baseline)
        one = both.withColumn("effect", F.get("effects", F.lit(0))).drop("effects")
        return glm.with_tails(glm.statistic(one.select(VOXEL, *by, "effect", "variance", "dof"), baseline))

    def compute_contrast(self, definition, kind: str | None = None, output: str = "zscore", baseline: float = 0.0) -> DataFrame:
        """voxel_id, value: the named map of a contrast."""
        return glm.contrast_map(self.contrast(definition, kind, baseline), output)

    def predictions(self) -> DataFrame:
        return predictions(self.series, self.results, self.designs)
