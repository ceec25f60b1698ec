"""General linear models over voxels.

A design is small (times x regressors) and is built on the driver; voxels are many and are fitted in batches of rows,
each with one matrix product. Estimates stay with their voxels: theta as an array, the dispersion, and contrasts as
columns, so that fixed effects over runs and group models are unions and aggregates.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import hrf, tails
from ..functions.scale import normalize_trial_type
from .layout import SERIES, TIME, VALUE, VOXEL, matrix_of, rows_of
from .series import cosine_drift

# Events


def dedup_events(events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """onset, duration, trial_type, modulation: defaults filled in, equal events (of equal keys `by`) with their modulation summed."""
    typed = events.select(
        *by,
        F.col("onset").cast("double").alias("onset"),
        F.col("duration").cast("double").alias("duration"),
        (normalize_trial_type(F.col("trial_type")) if "trial_type" in events.columns else F.lit("dummy")).alias("trial_type"),
        (F.coalesce(F.col("modulation").cast("double"), F.lit(1.0)) if "modulation" in events.columns else F.lit(1.0)).alias("modulation"),
    )
    return typed.groupBy(*by, "trial_type", "onset", "duration").agg(F.sum("modulation").alias("modulation"))


def boxcar(events: DataFrame, grid: DataFrame, time: str = "time") -> DataFrame:
    """trial_type, time, value: the sum of amplitudes of the events that are on, at each time of the grid.

    Each event adds its modulation at the first time at or after its onset and takes it off at the first one at or after
    its end (a later one, if both are the same); a running sum over events and grid together gives the value, so no
    event meets a grid time other than in the sort.
    """
    order = Window.orderBy(time)
    numbered = grid.select(time).distinct().withColumn("i", F.row_number().over(order))
    kinds = events.select("trial_type").distinct()
    ends = events.select("trial_type", F.explode(F.array(F.struct(F.col("onset").alias("at"), F.col("modulation").alias("d"), F.lit(0).alias("end")), F.struct((F.col("onset") + F.col("duration")).alias("at"), (-F.col("modulation")).alias("d"), F.lit(1).alias("end")))).alias("e"), (F.col("duration") == 0).alias("point"))
    marks = ends.select("trial_type", F.col("e.at").alias(time), F.col("e.d").alias("d"), "point", F.col("e.end").alias("end"))
    both = marks.select("trial_type", time, "d", "point", "end", F.lit(None).cast("int").alias("i")).unionByName(kinds.crossJoin(F.broadcast(numbered)).select("trial_type", time, F.lit(0.0).alias("d"), F.lit(False).alias("point"), F.lit(2).alias("end"), "i"))
    ahead = Window.partitionBy("trial_type").orderBy(F.col(time).desc(), F.col("end").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("k", F.last("i", True).over(ahead) + F.when(F.col("point") & (F.col("end") == 1), 1).otherwise(0))
    steps = placed.filter("k IS NOT NULL").groupBy("trial_type", "k").agg(F.sum("d").alias("d"))
    running = steps.withColumn("value", F.sum("d").over(Window.partitionBy("trial_type").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    return running.join(numbered.withColumnRenamed("i", "k"), "k").select("trial_type", time, "value")


def active_events(frames: DataFrame, events: DataFrame, width: float) -> DataFrame:
    """frame_id with the events that overlap [start, end): onset < end and start < onset + duration, or an onset inside
    of it for events without duration. Both sides are cut into buckets of `width`, and only equal buckets meet.
    """
    f = frames.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    stop = F.col("onset") + F.col("duration")
    e = events.withColumn("b", F.explode(F.sequence(F.floor(F.col("onset") / width), F.floor(stop / width))))
    hit = F.when(F.col("duration") > 0, (F.col("onset") < F.col("end")) & (F.col("start") < stop)).otherwise((F.col("start") <= F.col("onset")) & (F.col("onset") < F.col("end")))
    # An overlap may lie in several common buckets; it counts in the first one.
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("onset") / width))
    return f.join(e, "b").filter(hit & (F.col("b") == first)).drop("b")


# Designs, on the driver


def sampling_interval(times: np.ndarray, tolerance: float = 0.01) -> float:
    d = np.diff(np.asarray(times, float))
    if len(d) == 0 or (d <= 0).any():
        raise ValueError("volume times must be two or more, in increasing order")
    if np.abs(d - np.median(d)).max() > tolerance * np.median(d):
        raise ValueError("volume times must be uniform")
    return float(np.median(d))


def condition_regressors(events: pd.DataFrame, times: np.ndarray, model="glover", fir_delays: list[int] | None = None, oversampling: int = 50, min_onset: float = -24.0) -> list[np.ndarray]:
    """One column for each kernel: events on a fine grid, convolved, and taken at the volume times."""
    dt = sampling_interval(times)
    fine = dt / oversampling
    high = np.arange(int(round((times[-1] - (times[0] + min_onset)) / fine)) + oversampling + 1) * fine + times[0] + min_onset
    signal = np.zeros(len(high) + 1)
    usable = events[events["onset"] >= high[0]]
    on = np.minimum(np.searchsorted(high, usable["onset"]), len(high))
    off = np.minimum(np.searchsorted(high, usable["onset"] + usable["duration"]), len(high))
    off = np.where(off == on, np.minimum(on + 1, len(high)), off)
    np.add.at(signal, on, usable["modulation"])
    np.add.at(signal, off, -usable["modulation"].to_numpy())
    signal = np.cumsum(signal)[: len(high)]
    out = []
    for h in hrf.kernels(model, dt, oversampling, fir_delays):
        out.append(np.interp(times, high, np.convolve(signal, h)[: len(high)]))
    return out


def orthogonalize(x: np.ndarray) -> np.ndarray:
    """Each column without its projection on those before it."""
    x = np.array(x, float)
    for k in range(1, x.shape[1]):
        x[:, k] -= x[:, :k] @ np.linalg.pinv(x[:, :k]) @ x[:, k]
    return x


def first_level_design(times: np.ndarray, events: pd.DataFrame | None = None, model="glover", drift: str | None = "cosine", low_cutoff: float = 0.01, drift_order: int = 1, confounds: pd.DataFrame | None = None, fir_delays: list[int] | None = None, oversampling: int = 50, min_onset: float = -24.0) -> pd.DataFrame:
    """Regressors of each trial type in order of appearance, confounds, drift, constant; the index is the volume time."""
    times = np.asarray(times, float)
    columns: dict[str, np.ndarray] = {}
    if events is not None:
        for kind in dict.fromkeys(events["trial_type"]):
            found = condition_regressors(events[events["trial_type"] == kind], times, model, fir_delays, oversampling, min_onset)
            for k, x in enumerate(found):
                columns[f"{kind}_delay_{(fir_delays or [0])[k]}" if model == "fir" else str(kind)] = x
    if confounds is not None:
        if len(confounds) != len(times) or confounds.isna().any().any():
            raise ValueError("confounds need a finite row for each volume")
        for c in confounds.columns:
            if c in columns:
                raise ValueError(f"two regressors are named {c!r}")
            columns[str(c)] = confounds[c].to_numpy(float)
    n = len(times)
    if drift == "cosine":
        d = cosine_drift(n, low_cutoff, sampling_interval(times))
        columns |= {f"drift_{k + 1}": d[:, k] for k in range(d.shape[1] - 1)}
    elif drift == "polynomial":
        p = orthogonalize(np.vander(np.linspace(-0.5, 0.5, n), drift_order + 1, increasing=True))
        columns |= {f"drift_{k}": p[:, k] for k in range(1, drift_order + 1)}
    elif drift is not None:
        raise ValueError(f"unknown drift {drift!r}; known: cosine, polynomial, None")
    columns["constant"] = np.ones(n)
    return pd.DataFrame(columns, index=pd.Index(times, name="time"))


def second_level_design(n: int, confounds: pd.DataFrame | None = None) -> pd.DataFrame:
    out = pd.DataFrame(index=range(n)) if confounds is None else confounds.reset_index(drop=True).copy()
    return out.assign(intercept=1.0)


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def contrast_vector(definition: str | np.ndarray, columns: list[str]) -> np.ndarray:
    """A vector or rows of vectors over the columns: from an expression of names and numbers, or padded with zeros."""
    if not isinstance(definition, str):
        c = np.atleast_2d(np.asarray(definition, float))
        if c.shape[1] > len(columns):
            raise ValueError(f"the contrast has {c.shape[1]} entries, the design {len(columns)} columns")
        c = np.pad(c, ((0, 0), (0, len(columns) - c.shape[1])))
        return c[0] if np.ndim(definition) == 1 else c
    if definition in columns:
        return np.eye(len(columns))[columns.index(definition)]

    def value(node):
        if isinstance(node, ast.Name) and node.id in columns:
            return np.eye(len(columns))[columns.index(node.id)]
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](value(node.left), value(node.right))
        raise ValueError(f"{definition!r} isn't a sum of columns {columns}")

    out = value(ast.parse(definition, mode="eval").body)
    if np.ndim(out) != 1:
        raise ValueError(f"{definition!r} names no column")
    return out


# Fits, by batches of voxels


def yule_walker(residuals: np.ndarray, order: int) -> np.ndarray:
    """AR coefficients of each row."""
    r = residuals - residuals.mean(1, keepdims=True)
    n = r.shape[1]
    c = np.stack([(r[:, : n - k] * r[:, k:]).sum(1) / n for k in range(order + 1)], 1)
    out = np.zeros((len(r), order))
    some = c[:, 0] > 0
    lags = np.abs(np.arange(order)[:, None] - np.arange(order))
    out[some] = (np.linalg.pinv(c[some][:, lags], hermitian=True) @ c[some, 1:, None])[..., 0]
    return out


def whitened(x: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Rows (or columns of a design as rows) minus their own past times rho: one for all, or one row for each."""
    out = np.array(x, float)
    for k in range(1, rho.shape[-1] + 1):
        out[..., k:] -= rho[..., k - 1 : k] * x[..., :-k]
    return out


class Design:
    """A design's part of all fits on it: its pseudo-inverse, and the products of its columns with their own past.

    A voxel with AR coefficients r has the normal matrix sum of a_i a_j G_ij over lags i and j, with a = (1, -r) and
    G_ij the products of the columns i and j steps late; so each voxel has its own exact whitened fit, and no design is
    whitened more than once.
    """

    def __init__(self, x: np.ndarray, order: int = 0) -> None:
        self.x, self.order = np.asarray(x, float), order
        n, k = self.x.shape
        if order >= n:
            raise ValueError(f"order {order} needs more than {n} times")
        self.pinv = np.linalg.pinv(self.x)
        self.dof = n - int(np.linalg.matrix_rank(self.x))
        self.late = np.stack([np.vstack([np.zeros((i, k)), self.x[: n - i]]) for i in range(order + 1)])  # lags x times x columns
        self.gram = np.einsum("itk,jtl->ijkl", self.late, self.late)

    def fit(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """theta, covariance (voxels x columns x columns) and dispersion of rows; nan dispersion without degrees of freedom."""
        theta = y @ self.pinv.T
        left = y - theta @ self.x.T
        cov = np.broadcast_to(self.pinv @ self.pinv.T, (len(y), *self.gram.shape[2:]))
        if self.order:
            rho = yule_walker(left, self.order)
            a = np.hstack([np.ones((len(y), 1)), -rho])
            white = whitened(y, rho)
            normal = np.einsum("vi,vj,ijkl->vkl", a, a, self.gram)
            right = np.einsum("vi,vik->vk", a, np.einsum("vt,itk->vik", white, self.late))
            cov = np.linalg.pinv(normal, hermitian=True)
            theta = np.einsum("vkl,vl->vk", cov, right)
            left = white - whitened(theta @ self.x.T, rho)
        rss = (left**2).sum(1)
        return theta, cov, rss / self.dof if self.dof > 0 else np.full(len(y), np.nan)


def noise_order(noise: str) -> int:
    """0 for ols, N for arN."""
    if noise == "ols":
        return 0
    if noise[:2] != "ar" or not noise[2:].isdigit() or int(noise[2:]) < 1:
        raise ValueError(f"noise is ols or arN, not {noise!r}")
    return int(noise[2:])


def fit(series: DataFrame, design: pd.DataFrame | np.ndarray, noise: str = "ols") -> DataFrame:
    """voxel_id, theta, covariance (flat), dispersion, dof for each voxel; noise: ols or arN.

    OLS has one pseudo-inverse for all voxels. For arN, residuals of OLS give each voxel's own coefficients, and the voxel
    is fitted again with its design and its samples whitened by them.
    """
    d = Design(np.asarray(design, float), noise_order(noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            theta, cov, dispersion = d.fit(matrix_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows_of(theta), rows_of(cov.reshape(len(theta), -1)), pa.array(dispersion), pa.array(np.full(len(theta), float(d.dof)))], names=[VOXEL, "theta", "covariance", "dispersion", "dof"])

    kind = series.schema[VOXEL].dataType.simpleString()
    return series.select(VOXEL, SERIES).mapInArrow(run, f"{VOXEL} {kind}, theta array<double>, covariance array<double>, dispersion double, dof double")


def contrast(fitted: DataFrame, c: np.ndarray) -> DataFrame:
    """voxel_id, effect, variance, dof of a one-row contrast, in SQL functions over the estimates."""
    c = np.asarray(c, float)
    k = len(c)
    effect = sum((F.col("theta")[i] * float(v) for i, v in enumerate(c) if v), F.lit(0.0))
    variance = sum((F.col("covariance")[i * k + j] * float(c[i] * c[j]) for i in range(k) for j in range(k) if c[i] * c[j]), F.lit(0.0))
    return fitted.select(VOXEL, effect.alias("effect"), (variance * F.col("dispersion")).alias("variance"), "dof")


def f_effects(fitted: DataFrame, c: np.ndarray) -> DataFrame:
    """voxel_id, effects (one for each row of the contrast), variance, dof: effects whitened so that the sum of their
    squares over their number and the variance is F. Runs are independent, so these can be summed over runs."""
    c = np.atleast_2d(np.asarray(c, float))
    q, k = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            theta, cov = matrix_of(batch.column(1)), matrix_of(batch.column(2)).reshape(-1, k, k)
            lower = np.linalg.cholesky(np.linalg.pinv(c @ cov @ c.T))
            white = np.einsum("vpq,vp->vq", lower, theta @ c.T)
            yield pa.RecordBatch.from_arrays([batch.column(0), rows_of(white), batch.column(3), batch.column(4)], names=[VOXEL, "effects", "variance", "dof"])

    kind = fitted.schema[VOXEL].dataType.simpleString()
    return fitted.select(VOXEL, "theta", "covariance", "dispersion", "dof").mapInArrow(run, f"{VOXEL} {kind}, effects array<double>, variance double, dof double")


def f_fixed_effects(runs: list[DataFrame]) -> DataFrame:
    """f_effects of several runs: effects, variances and degrees of freedom summed, then effects over n."""
    n, both = len(runs), runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    each = both.select(VOXEL, "variance", "dof", F.posexplode("effects").alias("row", "e"))
    rows = each.groupBy(VOXEL, "row").agg(F.sum("e").alias("e"), F.sum("variance").alias("v"), F.sum("dof").alias("dof"), F.count(F.lit(1)).alias("k")).filter(F.col("k") == n)
    effects = F.transform(F.array_sort(F.collect_list(F.struct("row", "e"))), lambda x: x["e"] / n)
    return rows.groupBy(VOXEL).agg(effects.alias("effects"), (F.first("v") / (n * n)).alias("variance"), F.first("dof").alias("dof"))


def f_statistic(effects: DataFrame, baseline: float = 0.0, tiny: float = 1e-50) -> DataFrame:
    """effects with statistic, its upper tail p, 1 - p and the normal score z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e, v, d = matrix_of(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                q = e.shape[1]
                f = ((e - baseline) ** 2).sum(1) / q / np.maximum(v, tiny)
                p, rest = tails.f_sf(f, q, d), tails.beta_cdf(q / 2, d / 2, q * f / (q * f + d))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (f, p, rest, tails.zscore(p, rest)))], names=[VOXEL, "effects", "variance", "dof", "statistic", "p", "one_minus_p", "z"])

    kind = effects.schema[VOXEL].dataType.simpleString()
    return effects.select(VOXEL, "effects", "variance", "dof").mapInArrow(run, f"{VOXEL} {kind}, effects array<double>, variance double, dof double, statistic double, p double, one_minus_p double, z double")


def f_contrast(fitted: DataFrame, c: np.ndarray) -> DataFrame:
    """voxel_id, statistic, p of a contrast of several rows."""
    return f_statistic(f_effects(fitted, c)).select(VOXEL, "statistic", "p")


OUTPUTS = {"zscore": "z", "statistic": "statistic", "pvalue": "p", "effect": "effect", "variance": "variance"}


def contrast_map(found: DataFrame, output: str = "zscore") -> DataFrame:
    """voxel_id, value: one map of a contrast by name; an F contrast's effects are one array for each voxel."""
    if output not in OUTPUTS:
        raise ValueError(f"unknown output {output!r}; known: {', '.join(OUTPUTS)}")
    name = "effects" if output == "effect" and "effects" in found.columns else OUTPUTS[output]
    return found.select(VOXEL, F.col(name).alias("value"))


def scaled(contrasts: DataFrame, by: float) -> DataFrame:
    """A contrast times a number: its effect times it, its variance times its square."""
    effect = {"effects": F.transform("effects", lambda x: x * by)} if "effects" in contrasts.columns else {"effect": F.col("effect") * by}
    return contrasts.withColumns(effect | {"variance": F.col("variance") * (by * by)})


def statistic(contrasts: DataFrame, baseline: float = 0.0, tiny: float = 1e-50) -> DataFrame:
    """t of each effect over its standard error; 0 without variance."""
    t = F.when(F.col("variance") <= 0, 0.0).otherwise((F.col("effect") - baseline) / F.sqrt(F.greatest("variance", F.lit(tiny))))
    return contrasts.withColumn("statistic", t)


def with_tails(contrasts: DataFrame) -> DataFrame:
    """statistic with its upper tail p, 1 - p, and the normal score z."""
    names = contrasts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, d = batch.column(names.index("statistic")).to_numpy(), batch.column(names.index("dof")).to_numpy()
            p, q = tails.t_sf(t, d), tails.t_sf(-t, d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(q), pa.array(tails.zscore(p, q))], names=[*names, "p", "one_minus_p", "z"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contrasts.schema)
    return contrasts.mapInArrow(run, f"{fields}, p double, one_minus_p double, z double")


def fixed_effects(runs: list[DataFrame]) -> DataFrame:
    """Contrasts of several runs: effects, variances and degrees of freedom summed, then the effect over n."""
    n = len(runs)
    both = runs[0]
    for r in runs[1:]:
        both = both.unionByName(r)
    out = both.groupBy(VOXEL).agg(F.sum("effect").alias("e"), F.sum("variance").alias("v"), F.sum("dof").alias("dof"), F.count(F.lit(1)).alias("k"))
    return out.filter(F.col("k") == n).select(VOXEL, (F.col("e") / n).alias("effect"), (F.col("v") / (n * n)).alias("variance"), "dof")


def ols_sql(samples: DataFrame, design: DataFrame, regressors: list[str], value: str = VALUE, time: str = TIME) -> DataFrame:
    """voxel_id and coefficients of up to two regressors and a constant, by sums alone: the normal equations by hand."""
    both = samples.join(F.broadcast(design), time)
    y = F.col(value)
    if len(regressors) == 1:
        a = F.col(regressors[0])
        beta = F.covar_pop(y, a) / F.var_pop(a)
        return both.groupBy(VOXEL).agg(beta.alias(regressors[0]), (F.avg(y) - beta * F.avg(a)).alias("constant"))
    a, b = (F.col(r) for r in regressors)
    saa, sbb, sab, say, sby = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b), F.covar_pop(a, y), F.covar_pop(b, y)
    det = saa * sbb - sab * sab
    b1, b2 = (say * sbb - sby * sab) / det, (sby * saa - say * sab) / det
    return both.groupBy(VOXEL).agg(b1.alias(regressors[0]), b2.alias(regressors[1]), (F.avg(y) - b1 * F.avg(a) - b2 * F.avg(b)).alias("constant"))


class FirstLevelModel:
    """Designs of one or several runs, their fit, and contrasts over all of them."""

    def __init__(self, model="glover", drift: str | None = "cosine", low_cutoff: float = 0.01, noise: str = "ar1", **options) -> None:
        self.model, self.drift, self.low_cutoff, self.noise, self.options = model, drift, low_cutoff, noise, options

    def fit(self, runs: list[DataFrame], times: list[np.ndarray], events: list[pd.DataFrame] | None = None, confounds: list[pd.DataFrame] | None = None) -> FirstLevelModel:
        self.designs = [first_level_design(t, events[k] if events else None, self.model, self.drift, self.low_cutoff, confounds=confounds[k] if confounds else None, **self.options) for k, t in enumerate(times)]
        if len({tuple(d.columns) for d in self.designs}) > 1:
            raise ValueError("runs must have the same regressors")
        self.results = [fit(r, d, self.noise) for r, d in zip(runs, self.designs, strict=True)]
        return self

    def contrast(self, definition, kind: str | None = None, baseline: float = 0.0) -> DataFrame:
        """effect (F: effects), variance, dof, statistic, p, one_minus_p and z over all runs; kind: t or F."""
        vectors = [contrast_vector(definition, list(d.columns)) for d in self.designs]
        if kind == "F" or np.ndim(vectors[0]) == 2 and len(vectors[0]) > 1:
            return f_statistic(f_fixed_effects([f_effects(r, c) for r, c in zip(self.results, vectors, strict=True)]), baseline)
        runs = [contrast(r, np.ravel(c)) for r, c in zip(self.results, vectors, strict=True)]
        return with_tails(statistic(fixed_effects(runs), baseline))

    def compute_contrast(self, definition, kind: str | None = None, output: str = "zscore", baseline: float = 0.0) -> DataFrame:
        """voxel_id, value: the named map of a contrast."""
        return contrast_map(self.contrast(definition, kind, baseline), output)


class SecondLevelModel:
    """OLS over the maps of subjects: a series of one value for each subject."""

    def fit(self, maps: DataFrame, confounds: pd.DataFrame | None = None) -> SecondLevelModel:
        """maps: voxel_id, subject, value."""
        from .layout import to_series

        n = maps.select("subject").distinct().count()
        self.design = second_level_design(n, confounds)
        self.results = fit(to_series(maps, time="subject"), self.design)
        return self

    def contrast(self, definition="intercept", kind: str | None = None, baseline: float = 0.0) -> DataFrame:
        c = contrast_vector(definition, list(self.design.columns))
        if kind == "F" or np.ndim(c) == 2 and len(c) > 1:
            return f_statistic(f_effects(self.results, c), baseline)
        return with_tails(statistic(contrast(self.results, np.ravel(c)), baseline))

    def compute_contrast(self, definition="intercept", kind: str | None = None, output: str = "zscore", baseline: float = 0.0) -> DataFrame:
        """voxel_id, value: the named map of a contrast."""
        return contrast_map(self.contrast(definition, kind, baseline), output)
