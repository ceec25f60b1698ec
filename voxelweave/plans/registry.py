"""The engine's registered queries: each applies an operator to a view of the shared tables; SQL twins are beside it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scale
from ..operators import atlas, decompose, glm, masks, reductions, runs, series, spatial, thresholds, validate, windows
from ..operators.layout import checkpointed, to_long, to_series
from ..sources import bids
from . import views
from .views import B, E, G, H, P, R, V

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return put


def r(name: str, digits: int = 6, out: str | None = None):
    """A rounded column: sums of floats differ in their last digits from one order to another."""
    return F.round(name, digits).alias(out or (name if isinstance(name, str) else "value"))


def _m(spark: SparkSession, d: str) -> DataFrame:
    return views.matrix(spark, d).select("t_idx", "voxel_id", "value")


# Flagship: z-score, seeds from the first band, correlation of every voxel with it.

Z = "Z AS (SELECT t_idx, voxel_id, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS value FROM E WINDOW w AS (PARTITION BY voxel_id))"
SEEDS = "S AS (SELECT Z.t_idx, B.region, avg(Z.value) AS s FROM Z JOIN B USING (voxel_id) WHERE B.region <> 0 GROUP BY ALL)"


@query("seed_correlation", f"WITH {E}, {B}, {Z}, {SEEDS} SELECT S.region, Z.voxel_id, round(corr(Z.value, S.s), 6) AS r FROM Z JOIN S USING (t_idx) GROUP BY ALL")
def seed_correlation(spark: SparkSession, d: str) -> DataFrame:
    z = series.standardize(_m(spark, d))
    seeds = reductions.extract_with_labels(z, views.bands(spark))
    return reductions.seed_correlation(z, seeds).select("region", "voxel_id", r("r"))


@query("seed_maps_masked", f"WITH {E}, {B}, S AS (SELECT t_idx, region, sum(value) AS s FROM E JOIN B USING (voxel_id) WHERE region <> 0 GROUP BY ALL) SELECT region, voxel_id, round(corr(value, s) * max(CASE WHEN voxel_id < 32 THEN 1 ELSE 0 END), 6) + 0.0 AS r FROM E JOIN S USING (t_idx) GROUP BY ALL")
def seed_maps_masked(spark: SparkSession, d: str) -> DataFrame:
    mask = spark.range(32).withColumnRenamed("id", "voxel_id")
    return reductions.seed_based_maps(_m(spark, d), views.bands(spark), "sum", mask).select("region", "voxel_id", (F.round("r", 6) + 0.0).alias("r"))


@query("tsnr", f"WITH {E} SELECT voxel_id, round(avg(value) / stddev_pop(value), 6) AS tsnr FROM E GROUP BY voxel_id")
def tsnr(spark, d):
    return reductions.compute_tsnr(_m(spark, d)).select("voxel_id", r("tsnr"))


@query("cv", f"WITH {E} SELECT voxel_id, round(stddev_pop(value) / avg(value), 4) AS cv FROM E GROUP BY voxel_id")
def cv(spark, d):
    return reductions.compute_cv(_m(spark, d)).select("voxel_id", r("cv", 4))


@query("zscore", f"WITH {R} SELECT voxel_id, t_idx, CASE WHEN stddev_samp(value) OVER w < 1e-15 THEN 'NaN'::DOUBLE ELSE round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) END AS value FROM R WINDOW w AS (PARTITION BY voxel_id)")
def zscore(spark, d):
    return series.standardize(views.regions(spark, d)).select("voxel_id", "t_idx", r("value"))


@query("psc", f"WITH {R} SELECT voxel_id, t_idx, round((value - avg(value) OVER w) / abs(avg(value) OVER w) * 100, 6) AS value FROM R WINDOW w AS (PARTITION BY voxel_id)")
def psc(spark, d):
    return series.standardize(views.regions(spark, d), "psc").select("voxel_id", "t_idx", r("value"))


@query("detrend_constant", f"WITH {R} SELECT voxel_id, t_idx, round(value - avg(value) OVER (PARTITION BY voxel_id), 9) + 0.0 AS value FROM R")
def detrend_constant(spark, d):
    return series.detrend(views.regions(spark, d), 0).select("voxel_id", "t_idx", (F.round("value", 9) + 0.0).alias("value"))


@query("detrend_linear", f"WITH {E}, f AS (SELECT voxel_id, regr_slope(value, t_idx) AS b, regr_intercept(value, t_idx) AS a FROM E GROUP BY voxel_id) SELECT voxel_id, t_idx, round(value - a - b * t_idx, 6) + 0.0 AS value FROM E JOIN f USING (voxel_id)")
def detrend_linear(spark, d):
    return series.detrend(_m(spark, d), 1).select("voxel_id", "t_idx", (F.round("value", 6) + 0.0).alias("value"))


D = "D AS (SELECT t_idx, voxel_id, value, value - lag(value) OVER (PARTITION BY voxel_id ORDER BY t_idx) AS d FROM E), W AS (SELECT t_idx, sqrt(avg(d * d)) AS w FROM D GROUP BY t_idx)"
AR = """M AS (SELECT voxel_id, t_idx, value - avg(value) OVER (PARTITION BY voxel_id) AS c FROM E),
L AS (SELECT voxel_id, c, lag(c) OVER (PARTITION BY voxel_id ORDER BY t_idx) AS b FROM M),
A AS (SELECT voxel_id, sum(c * b) / sum(c * c) AS ar1, (sum(c * c) - sum(c * b) / sum(c * c) * sum(c * b)) / count(*) AS sigma2 FROM L GROUP BY voxel_id)"""


@query("dvars_raw", f"WITH {E}, {D} SELECT t_idx, round(coalesce(w, (SELECT min(w) FROM W)) * 1000 / (SELECT median(value) FROM E), 2) AS dvars FROM W")
def dvars_raw(spark, d):
    return reductions.compute_dvars(_m(spark, d), standardize=False).select("t_idx", r("dvars", 2))


@query("dvars_standardized", f"WITH {E}, {D}, {AR}, Q AS (SELECT voxel_id, list_sort(list(value)) AS l FROM E GROUP BY voxel_id), K AS (SELECT avg(sqrt(2 * (1 - ar1)) * (l[floor(0.75 * (len(l) - 1))::INT + 1] - l[floor(0.25 * (len(l) - 1))::INT + 1]) / 1.3489795003921634) AS k FROM Q JOIN A USING (voxel_id)) SELECT t_idx, round(coalesce(w, (SELECT min(w) FROM W)) / (SELECT k FROM K), 6) AS dvars FROM W")
def dvars_standardized(spark, d):
    return reductions.compute_dvars(_m(spark, d)).select("t_idx", r("dvars"))


@query("ar1_coefficients", f"WITH {E}, {AR} SELECT voxel_id, round(ar1, 6) AS ar1, round(sigma2, 6) AS sigma2 FROM A")
def ar1_coefficients(spark, d):
    return reductions.ar1_coefficients(_m(spark, d)).select("voxel_id", r("ar1"), r("sigma2"))


@query("db_scale", "SELECT l_orderkey, l_linenumber, round(10 * log10(l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem)), 6) + 0.0 AS db FROM lineitem")
def db_scale(spark, d):
    x = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    return scale.db_scale(x).select("l_orderkey", "l_linenumber", (F.round("db", 6) + 0.0).alias("db"))


@query("log_power_scale", "SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS ln, round(sqrt(abs(l_extendedprice)), 6) AS root FROM lineitem")
def log_power_scale(spark, d):
    x = views.table(spark, d, "lineitem")
    return x.select("l_orderkey", "l_linenumber", F.round(scale.log_scale(F.col("l_extendedprice")), 6).alias("ln"), F.round(scale.power_scale(F.col("l_extendedprice")), 6).alias("root"))


@query("min_max_scale", "SELECT l_orderkey, l_linenumber, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS scaled FROM lineitem")
def min_max_scale(spark, d):
    x = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    return scale.scale_min_max(x).select("l_orderkey", "l_linenumber", r("scaled"))


for _how, _fn in (("mean", "avg"), ("sum", "sum"), ("median", "median"), ("min", "min"), ("max", "max"), ("var", "var_pop"), ("std", "stddev_pop")):

    @query(f"extract_labels_{_how}", f"WITH {E}, {B} SELECT t_idx, region, round({_fn}(value), 6) AS value FROM E JOIN B USING (voxel_id) WHERE region <> 0 GROUP BY ALL")
    def _labels(spark, d, how=_how):
        return reductions.extract_with_labels(_m(spark, d), views.bands(spark), how).select("t_idx", "region", r("value"))


@query("extract_mask", f"WITH {E} SELECT t_idx, voxel_id, round(value, 6) AS value FROM E WHERE voxel_id % 5 = 0")
def extract_mask(spark, d):
    mask = spark.range(64).withColumnRenamed("id", "voxel_id").filter("voxel_id % 5 = 0")
    return masks.extract_with_mask(_m(spark, d), mask).select("t_idx", "voxel_id", r("value"))


@query("unmask_fill", f"WITH {E} SELECT t_idx, voxel_id, CASE WHEN voxel_id % 5 = 0 THEN round(value, 6) ELSE -1 END AS value FROM E")
def unmask_fill(spark, d):
    grid = spark.range(64).withColumnRenamed("id", "voxel_id")
    kept = masks.extract_with_mask(_m(spark, d), grid.filter("voxel_id % 5 = 0"))
    return masks.unmask(kept, grid, -1.0).select("t_idx", "voxel_id", r("value"))


@query("zero_variance_filter", f"WITH {R} SELECT voxel_id, t_idx, round(value, 6) AS value FROM R WHERE voxel_id IN (SELECT voxel_id FROM R GROUP BY 1 HAVING stddev_samp(value) > 5)")
def zero_variance_filter(spark, d):
    return reductions.remove_zero_variance(views.regions(spark, d), 5.0).select("voxel_id", "t_idx", r("value"))


def _keep(spark, d):
    return views.regions(spark, d).select("t_idx").distinct().withColumn("keep", F.col("t_idx") % 3 != 0)


@query("censor", f"WITH {R} SELECT voxel_id, t_idx, round(value, 6) AS value FROM R WHERE t_idx % 3 <> 0")
def censor(spark, d):
    return series.censor_samples(views.regions(spark, d), _keep(spark, d)).select("voxel_id", "t_idx", r("value"))


@query("interpolate_censored", f"""WITH {R}, K AS (SELECT * FROM R WHERE t_idx % 3 <> 0), N AS (
  SELECT R.voxel_id, R.t_idx, CASE WHEN R.t_idx % 3 <> 0 THEN R.value END AS v, a.t_idx AS ta, a.value AS va, b.t_idx AS tb, b.value AS vb
  FROM R ASOF LEFT JOIN K a ON R.voxel_id = a.voxel_id AND R.t_idx >= a.t_idx ASOF LEFT JOIN K b ON R.voxel_id = b.voxel_id AND R.t_idx <= b.t_idx)
  SELECT voxel_id, t_idx, round(coalesce(v, CASE WHEN va IS NULL OR vb IS NULL THEN coalesce(va, vb) ELSE va + (vb - va) * (t_idx - ta) / (tb - ta)::DOUBLE END), 6) AS value FROM N""")
def interpolate_censored(spark, d):
    return series.interpolate_samples(views.regions(spark, d), _keep(spark, d), edges=True).select("voxel_id", "t_idx", r("value"))


@query("repair_non_finite", f"""WITH {R}, X AS (SELECT voxel_id, t_idx, CASE WHEN value > 60 THEN NULL ELSE value END AS value FROM R), K AS (SELECT * FROM X WHERE value IS NOT NULL), N AS (
  SELECT X.voxel_id, X.t_idx, X.value AS v, a.t_idx AS ta, a.value AS va, b.t_idx AS tb, b.value AS vb
  FROM X ASOF LEFT JOIN K a ON X.voxel_id = a.voxel_id AND X.t_idx >= a.t_idx ASOF LEFT JOIN K b ON X.voxel_id = b.voxel_id AND X.t_idx <= b.t_idx)
  SELECT voxel_id, t_idx, round(coalesce(v, CASE WHEN va IS NULL OR vb IS NULL THEN coalesce(va, vb) ELSE va + (vb - va) * (t_idx - ta) / (tb - ta)::DOUBLE END), 6) AS value FROM N""")
def repair_non_finite(spark, d):
    x = views.regions(spark, d).withColumn("value", F.when(F.col("value") > 60, F.lit(float("nan"))).otherwise(F.col("value")))
    return series.repair_non_finite(x).select("voxel_id", "t_idx", r("value"))


@query("regress_one_confound", f"WITH {E}, C AS (SELECT t_idx, t_idx - avg(t_idx) OVER () AS c FROM (SELECT DISTINCT t_idx FROM E)), F AS (SELECT voxel_id, sum(value * c) / sum(c * c) AS b FROM E JOIN C USING (t_idx) GROUP BY 1) SELECT voxel_id, t_idx, round(value - b * c, 6) AS value FROM E JOIN C USING (t_idx) JOIN F USING (voxel_id)")
def regress_one_confound(spark, d):
    m = _m(spark, d)
    c = m.select("t_idx").distinct().withColumn("c", F.col("t_idx").cast("double"))
    return series.regress_one(m, c).select("voxel_id", "t_idx", r("value"))


@query("cosine_basis", "SELECT t_idx, k, round(CASE WHEN k = 0 THEN 1 ELSE sqrt(2.0 / n) * cos(pi() / n * (t_idx + 0.5) * k) END, 6) + 0.0 AS value FROM (SELECT vec_id AS t_idx, count(*) OVER () AS n FROM embeddings), range(5) b(k)")
def cosine_basis(spark, d):
    n = views.table(spark, d, "embeddings").count()
    return series.cosine_drift_rows(spark, n, 4.01 / n, 0.5).select("t_idx", F.col("k").cast("long").alias("k"), (F.round("value", 6) + 0.0).alias("value"))


@query("cosine_filter", f"""WITH {E}, N AS (SELECT count(DISTINCT t_idx) AS n FROM E), C AS (SELECT t_idx, k, CASE WHEN k = 0 THEN 1 / sqrt(n) ELSE sqrt(2.0 / n) * cos(pi() / n * (t_idx + 0.5) * k) END AS c FROM N, (SELECT DISTINCT t_idx FROM E), range(4) b(k)),
  F AS (SELECT voxel_id, k, sum(value * c) AS f FROM E JOIN C USING (t_idx) GROUP BY ALL), S AS (SELECT voxel_id, t_idx, sum(f * c) AS s FROM F JOIN C USING (k) GROUP BY ALL)
  SELECT voxel_id, t_idx, round(value - s, 6) + 0.0 AS value FROM E JOIN S USING (voxel_id, t_idx)""")
def cosine_filter(spark, d):
    s = to_series(_m(spark, d))
    n = views.table(spark, d, "embeddings").count()
    out = to_long(series.filter_cosine(s, n, 3.01 / (2 * n), 1.0))
    return out.select("voxel_id", F.col("t_idx").cast("long").alias("t_idx"), (F.round("value", 6) + 0.0).alias("value"))


@query("compcor_voxel_selection", f"WITH {E}, S AS (SELECT voxel_id, var_samp(value) AS variance FROM E GROUP BY 1 HAVING variance > 0) SELECT voxel_id, round(variance, 6) AS variance FROM S WHERE variance >= (SELECT quantile_cont(variance, 0.9) FROM S)")
def compcor_voxel_selection(spark, d):
    return series.compcor_voxels(_m(spark, d), 0.1).select("voxel_id", r("variance"))


def _hours(spark, d):
    return views.regions(spark, d).select("voxel_id", F.col("t_idx").cast("double").alias("time"), "value")


ASOF = f"""{R}, L AS (SELECT min(t_idx) AS lo, max(t_idx) AS hi FROM R), T AS (SELECT lo + k * 0.75 AS time FROM L, range(60) t(k) WHERE lo + k * 0.75 <= hi),
  G AS (SELECT voxel_id, time FROM (SELECT DISTINCT voxel_id FROM R), T),
  N AS (SELECT G.voxel_id, G.time, a.t_idx AS ta, a.value AS va, b.t_idx AS tb, b.value AS vb FROM G ASOF LEFT JOIN R a ON G.voxel_id = a.voxel_id AND G.time >= a.t_idx ASOF LEFT JOIN R b ON G.voxel_id = b.voxel_id AND G.time <= b.t_idx)"""


def _targets(spark, d):
    return series.uniform_times(_hours(spark, d), step=0.75).filter("true")


@query("resample_linear", f"WITH {ASOF} SELECT voxel_id, time, round(CASE WHEN ta = tb THEN va ELSE va + (vb - va) * (time - ta) / (tb - ta) END, 6) AS value FROM N")
def resample_linear(spark, d):
    return series.resample_time(_hours(spark, d), _targets(spark, d), extrapolate=False).select("voxel_id", "time", r("value"))


@query("resample_nearest_previous_next", f"WITH {ASOF} SELECT voxel_id, time, round(va, 6) AS previous, round(vb, 6) AS next, round(CASE WHEN vb IS NULL OR (va IS NOT NULL AND time - ta <= tb - time) THEN va ELSE vb END, 6) AS nearest FROM N")
def resample_nearest_previous_next(spark, d):
    x, t = _hours(spark, d), _targets(spark, d)
    out = None
    for how in ("previous", "next", "nearest"):
        one = series.resample_time(x, t, how).select("voxel_id", "time", r("value", out=how))
        out = one if out is None else out.join(one, ["voxel_id", "time"])
    return out


@query("resample_extrapolate", f"""WITH {R}, A AS (SELECT voxel_id, list(struct_pack(t := t_idx, v := value) ORDER BY t_idx) AS s FROM R GROUP BY 1 HAVING count(*) > 1)
  SELECT voxel_id, s[-1].t + 2.5 AS time, round(s[-2].v + (s[-1].v - s[-2].v) * (s[-1].t + 2.5 - s[-2].t) / (s[-1].t - s[-2].t), 6) AS value FROM A WHERE s[-1].t = (SELECT max(t_idx) FROM R)""")
def resample_extrapolate(spark, d):
    x = _hours(spark, d)
    last = x.groupBy("voxel_id").agg(F.max("time").alias("last"), F.count("*").alias("n"))
    top = x.agg((F.max("time") + 2.5).alias("time"))
    out = series.resample_time(x, top).join(last.filter("n > 1"), "voxel_id").filter("last = time - 2.5")
    return out.select("voxel_id", "time", r("value"))


@query("time_units_reference", "SELECT event_id, round(value / 1000.0, 9) AS seconds, round(value + 0.5 * 0.25, 6) AS center FROM events")
def time_units_reference(spark, d):
    e = views.table(spark, d, "events")
    return e.select("event_id", F.round(scale.convert_time_units(F.col("value"), "ms", "s"), 9).alias("seconds"), F.round(scale.convert_time_reference(F.col("value"), 0.25, "start", "center"), 6).alias("center"))


@query("representative_step", f"WITH {V}, S AS (SELECT t - lag(t) OVER (ORDER BY t) AS d FROM (SELECT DISTINCT t_idx::DOUBLE AS t FROM V)) SELECT m AS step, max(abs(d - m) > 0.01 * abs(m)) AS non_uniform FROM S, (SELECT median(d) AS m FROM S) WHERE d IS NOT NULL GROUP BY m")
def representative_step(spark, d):
    t = views.days(spark, d).select(F.col("t_idx").cast("double").alias("coord")).distinct()
    return series.representative_step(t).select("step", "non_uniform")


WIN = f"{V}, N AS (SELECT max(t_idx) + 1 AS n FROM V), I AS (SELECT k::INT AS window_id FROM N, range(100000) t(k) WHERE k * 10 + 30 <= n), X AS (SELECT window_id, t_idx, voxel_id, re, im FROM I JOIN V ON t_idx >= window_id * 10 AND t_idx < window_id * 10 + 30)"


def _windowed(spark, d):
    v = views.days(spark, d)
    n = v.agg(F.max("t_idx")).first()[0] + 1
    return windows.sliding_windows(v, n, 30, 10)


@query("sliding_windows", f"WITH {WIN} SELECT window_id, count(*) AS n, min(t_idx) AS first, max(t_idx) AS last FROM X GROUP BY 1")
def sliding_windows(spark, d):
    return _windowed(spark, d).groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.min("t_idx").alias("first"), F.max("t_idx").alias("last"))


@query("power_doppler", f"WITH {WIN} SELECT window_id, voxel_id, round(avg(re * re + im * im), 3) AS value FROM X GROUP BY ALL")
def power_doppler(spark, d):
    return windows.power_doppler(_windowed(spark, d)).select("window_id", "voxel_id", r("value", 3))


@query("bmode", f"WITH {WIN} SELECT window_id, voxel_id, round(avg(sqrt(re * re + im * im)), 4) AS value FROM X GROUP BY ALL")
def bmode(spark, d):
    return windows.bmode(_windowed(spark, d)).select("window_id", "voxel_id", r("value", 4))


@query("axial_velocity", f"""WITH {WIN}, Y AS (SELECT *, lag(re) OVER w AS r0, lag(im) OVER w AS i0 FROM X WINDOW w AS (PARTITION BY window_id, voxel_id ORDER BY t_idx)),
  A AS (SELECT window_id, voxel_id, atan2(sum(im * r0 - re * i0), sum(re * r0 + im * i0)) AS phase FROM Y GROUP BY ALL HAVING count(r0) > 0),
  M AS (SELECT window_id, quantile_disc(phase, 0.5) AS phase FROM (SELECT window_id, phase FROM A UNION ALL SELECT window_id, 0 FROM (SELECT window_id, count(*) AS c FROM A GROUP BY 1), range(2) t(k) WHERE k < 3 - c) GROUP BY 1)
  SELECT window_id, voxel_id, round(M.phase * 500 * 1540 / (4 * pi() * 15625), 6) + 0.0 AS value FROM A JOIN M USING (window_id)""")
def axial_velocity(spark, d):
    """Two voxels side by side: a kernel of three has both of them and one place beyond the volume, which is 0."""
    grid = spark.range(2).select(F.col("id").alias("voxel_id"), F.lit(0).alias("z_idx"), F.lit(0).alias("y_idx"), F.col("id").cast("int").alias("x_idx"))
    out = windows.axial_velocity(_windowed(spark, d), 500.0, 15625.0, grid=grid).filter("value IS NOT NULL")
    return out.select("window_id", "voxel_id", (F.round("value", 6) + 0.0).alias("value"))


@query("window_timings", f"WITH {V}, N AS (SELECT max(t_idx) + 1 AS n FROM V) SELECT k AS window_id, k * 10 * 0.5 + 0.5 * (29 * 0.5 + 0.5) AS time, 29 * 0.5 + 0.5 AS duration FROM N, range(100000) t(k) WHERE k * 10 + 30 <= n")
def window_timings(spark, d):
    n = views.days(spark, d).agg(F.max("t_idx")).first()[0] + 1
    times = spark.range(n).select(F.col("id").alias("t_idx"), (F.col("id") * 0.5).alias("time"))
    return windows.window_timings(times, n, 30, 10, 0.5, "start", "center")


def _events(spark, d):
    e = views.table(spark, d, "events")
    onset = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    return e.select(onset.alias("onset"), F.floor(F.col("value") * 60).cast("double").alias("duration"), F.col("event_type").alias("trial_type"), "event_id")


X = "X AS (SELECT floor(epoch(ts))::DOUBLE AS onset, floor(value * 60)::DOUBLE AS duration, event_type AS trial_type, event_id FROM events)"


@query("events_dedup", f"WITH {X} SELECT trial_type, onset, duration, count(*)::DOUBLE AS modulation FROM X GROUP BY ALL")
def events_dedup(spark, d):
    return glm.dedup_events(_events(spark, d))


@query("boxcar_regressor", f"""WITH {X}, L AS (SELECT min(onset) AS lo, max(onset) AS hi FROM X), T AS (SELECT lo + k * 3600 AS time FROM L, range(100000) t(k) WHERE lo + k * 3600 <= hi),
  Q AS (SELECT trial_type, (SELECT min(time) FROM T WHERE time >= onset) AS a, (SELECT min(time) FROM T WHERE time >= onset + duration) AS b, duration FROM X),
  Y AS (SELECT trial_type, a AS t, 1 AS d FROM Q WHERE duration > 0 UNION ALL SELECT trial_type, b, -1 FROM Q WHERE duration > 0)
  SELECT k.trial_type, T.time, coalesce((SELECT sum(d) FROM Y WHERE Y.trial_type = k.trial_type AND Y.t <= T.time), 0)::DOUBLE AS value FROM (SELECT DISTINCT trial_type FROM X) k, T""")
def boxcar_regressor(spark, d):
    e = _events(spark, d)
    lo, hi = e.agg(F.min("onset"), F.max("onset")).first()
    grid = spark.range(int((hi - lo) // 3600) + 1).select((F.lit(lo) + F.col("id") * 3600.0).alias("time"))
    return glm.boxcar(glm.dedup_events(e.filter("duration > 0")), grid)


@query("active_events", f"WITH {X}, L AS (SELECT min(onset) AS lo, floor((max(onset + greatest(duration, 0)) - min(onset)) / 7200)::BIGINT AS last FROM X) SELECT k AS frame_id, event_id FROM L, range(10000000) t(k), X WHERE k <= last AND CASE WHEN duration > 0 THEN onset < lo + k * 7200 + 7200 AND lo + k * 7200 < onset + duration ELSE lo + k * 7200 <= onset AND onset < lo + k * 7200 + 7200 END")
def active_events(spark, d):
    e = _events(spark, d)
    lo, hi = e.agg(F.min("onset"), F.max(F.col("onset") + F.greatest("duration", F.lit(0.0)))).first()
    count = 0 if lo is None else int((hi - lo) // 7200) + 1  # up to the last moment of any event
    frames = spark.range(count).select(F.col("id").alias("frame_id"), (F.lit(lo) + F.col("id") * 7200).alias("start"), (F.lit(lo) + F.col("id") * 7200 + 7200).alias("end"))
    return glm.active_events(frames, e, 7200.0).select("frame_id", "event_id")


def _two(spark, d):
    """t_idx, a, b: two regressors from the time index and the label."""
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("t_idx"), (F.col("vec_id") % 10).cast("double").alias("a"), F.col("label").cast("double").alias("b"))


OLS = f"""{E}, Y AS (SELECT voxel_id, value AS y, (t_idx % 10)::DOUBLE AS a, label::DOUBLE AS b FROM E),
  S AS (SELECT voxel_id, count(*) AS n, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(y, a) AS say, covar_pop(y, b) AS sby, var_pop(y) AS syy, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM Y GROUP BY 1),
  C AS (SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / det AS ca, (sby * saa - say * sab) / det AS cb FROM S)"""


@query("glm_ols_two_regressors", f"WITH {OLS} SELECT voxel_id, round(ca, 6) AS a, round(cb, 6) AS b, round(my - ca * ma - cb * mb, 6) AS constant FROM C")
def glm_ols(spark, d):
    return glm.ols_sql(_m(spark, d), _two(spark, d), ["a", "b"]).select("voxel_id", r("a"), r("b"), r("constant"))


def _fitted(spark, d):
    x = _two(spark, d).orderBy("t_idx").toPandas()  # a design: two columns by time
    return glm.fit(to_series(_m(spark, d)), np.column_stack([x["a"], x["b"], np.ones(len(x))]))


TC = f"{OLS}, K AS (SELECT voxel_id, ca - cb AS effect, (syy - ca * say - cb * sby) * n / (n - 3) * (sbb + saa + 2 * sab) / det / n AS variance, (n - 3)::DOUBLE AS dof FROM C)"


@query("t_contrast", f"WITH {TC} SELECT voxel_id, round(effect, 6) AS effect, round(variance, 9) AS variance, dof, round(effect / sqrt(variance), 5) AS statistic FROM K")
def t_contrast(spark, d):
    out = glm.statistic(glm.contrast(_fitted(spark, d), np.array([1.0, -1.0, 0.0])))
    return out.select("voxel_id", r("effect"), r("variance", 9), "dof", r("statistic", 5))


@query("fixed_effects", f"WITH {TC} SELECT voxel_id, round(effect, 6) AS effect, round(variance / 2, 9) AS variance, 2 * dof AS dof FROM K")
def fixed_effects(spark, d):
    c = glm.contrast(_fitted(spark, d), np.array([1.0, -1.0, 0.0]))
    return glm.fixed_effects([c, c]).select("voxel_id", r("effect"), r("variance", 9), "dof")


@query("second_level_mean", f"WITH {E} SELECT voxel_id, round(avg(value), 6) AS effect, round(avg(value) / (stddev_samp(value) / sqrt(count(*))), 5) AS statistic FROM E GROUP BY 1")
def second_level_mean(spark, d):
    maps = _m(spark, d).select("voxel_id", F.col("t_idx").alias("subject"), "value")
    return glm.SecondLevelModel().fit(maps).contrast().select("voxel_id", r("effect"), r("statistic", 5))


_RANK = f"{P}, Q AS (SELECT voxel_id, p, row_number() OVER (ORDER BY p, voxel_id) AS r, count(*) OVER () AS m FROM P)"
_UP, _DOWN = "OVER (ORDER BY r)", "OVER (ORDER BY r DESC)"
for _method, _expr in {
    "bonferroni": "least(p * m, 1)",
    "sidak": "1 - (1 - p) ** m",
    "holm": f"least(max(p * (m - r + 1)) {_UP}, 1)",
    "holm-sidak": f"least(max(1 - (1 - p) ** (m - r + 1)) {_UP}, 1)",
    "simes-hochberg": f"least(min(p * (m - r + 1)) {_DOWN}, 1)",
    "fdr_bh": f"least(min(p * m / r) {_DOWN}, 1)",
    "fdr_by": f"least(min(p * m * (SELECT sum(1.0::DOUBLE / k) FROM range(1, (SELECT count(*) + 1 FROM P)) t(k)) / r) {_DOWN}, 1)",
}.items():

    @query(f"pvalue_{_method.replace('-', '_')}", f"WITH {_RANK} SELECT voxel_id, round({_expr}, 6) AS p_adjusted FROM Q")
    def _adjust(spark, d, method=_method):
        return thresholds.adjust_pvalues(views.pvalues(spark, d), method).select("voxel_id", r("p_adjusted"))


@query("pvalue_hommel", f"""WITH {P}, S AS (SELECT voxel_id, p, row_number() OVER (ORDER BY p, voxel_id) AS i, count(*) OVER () AS n FROM P),
  M AS (SELECT m, coalesce(min(CASE WHEN i > n - m + 1 THEN m * p / (i - n + m) END), 1e300) AS others, min(CASE WHEN i = n - m + 1 THEN m * p END) AS own
    FROM (SELECT i AS m FROM S) JOIN S ON i >= n - m + 1 GROUP BY m)
  SELECT voxel_id, round(least(max(CASE WHEN m >= n - i + 1 THEN least(others, own) ELSE least(m * p, others) END), 1), 6) AS p_adjusted FROM S, M GROUP BY voxel_id""")
def pvalue_hommel(spark, d):
    return thresholds.adjust_pvalues(views.pvalues(spark, d), "hommel").select("voxel_id", r("p_adjusted"))


@query("threshold_fixed", f"WITH {G} SELECT y_idx, x_idx, CASE WHEN abs(z) >= 2.5 THEN z ELSE 0 END AS z FROM G")
def threshold_fixed(spark, d):
    return thresholds.apply_threshold(views.grid(spark, d), 2.5).select("y_idx", "x_idx", "z")


#: Two-sided tails of scores by the series of the error function.
ERF = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(80), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(abs(z) / sqrt(2)) - lgamma(k + 1) - ln(2 * k + 1))))"


@query("threshold_fdr", f"""WITH {G}, T AS (SELECT y_idx * 20 + x_idx AS voxel_id, z, CASE WHEN z = 0 THEN 1 ELSE {ERF} END AS p FROM G),
  Q AS (SELECT voxel_id, z, p, min(p * m / r) OVER (ORDER BY r DESC) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, voxel_id) AS r, count(*) OVER () AS m FROM T)),
  K AS (SELECT voxel_id, CASE WHEN q <= 0.05 THEN z ELSE 0 END AS z FROM Q)
  SELECT voxel_id, z, coalesce((SELECT min(abs(z)) FROM K WHERE z <> 0), 'Infinity'::DOUBLE) AS threshold FROM K""")
def threshold_fdr(spark, d):
    g = views.grid(spark, d).withColumn("voxel_id", F.col("y_idx") * 20 + F.col("x_idx"))
    out, least = thresholds.apply_statistical_threshold(g)
    return out.select("voxel_id", "z", F.lit(least).alias("threshold"))


@query("cluster_filter", f"""WITH RECURSIVE {G}, C AS (SELECT y_idx AS y, x_idx AS x, z, CASE WHEN z > 0 THEN 1 ELSE -1 END AS s FROM (SELECT y_idx, x_idx, CASE WHEN abs(z) >= 1 THEN z ELSE 0 END AS z FROM G) WHERE z <> 0),
  J AS (SELECT y, x, y AS ry, x AS rx, s FROM C UNION SELECT C.y, C.x, J.ry, J.rx, J.s FROM J JOIN C ON C.s = J.s AND abs(C.y - J.y) + abs(C.x - J.x) = 1),
  K AS (SELECT y, x, count(*) AS n FROM J GROUP BY ALL)
  SELECT G.y_idx, G.x_idx, CASE WHEN abs(G.z) >= 1 AND K.n >= 4 THEN G.z ELSE 0 END AS z FROM G LEFT JOIN K ON K.y = G.y_idx AND K.x = G.x_idx""")
def cluster_filter(spark, d):
    return thresholds.cluster_filter(thresholds.apply_threshold(views.grid(spark, d), 1.0), 4).select("y_idx", "x_idx", "z")


COV = f"{E}, M AS (SELECT t_idx, voxel_id, value - avg(value) OVER (PARTITION BY voxel_id) AS x FROM E), K AS (SELECT a.voxel_id AS i, b.voxel_id AS j, avg(a.x * b.x) AS value FROM M a JOIN M b USING (t_idx) GROUP BY ALL)"


@query("covariance", f"WITH {COV} SELECT i, j, round(value, 6) + 0.0 AS value FROM K")
def covariance(spark, d):
    return reductions.covariance(_m(spark, d)).select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query("correlation_matrix", f"WITH {COV} SELECT K.i, K.j, CASE WHEN K.i = K.j THEN 1 ELSE round(K.value / sqrt(a.value * b.value), 6) + 0.0 END AS value FROM K JOIN K a ON a.i = K.i AND a.j = K.i JOIN K b ON b.i = K.j AND b.j = K.j")
def correlation_matrix(spark, d):
    return reductions.covariance(_m(spark, d), kind="correlation").select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query("vectorize_triangle", f"WITH {COV} SELECT (i * (i + 1) // 2 + j)::BIGINT AS k, round(CASE WHEN i = j THEN value / sqrt(2) ELSE value END, 6) + 0.0 AS value FROM K WHERE i >= j")
def vectorize_triangle(spark, d):
    return reductions.vectorize_triangle(reductions.covariance(_m(spark, d))).select("k", (F.round("value", 6) + 0.0).alias("value"))


def _subjects(spark, d):
    m = views.matrix(spark, d).select((F.col("t_idx") % 5).alias("subject"), F.col("voxel_id").alias("region"), "t_idx", "value")
    return to_series(m, ("subject", "region"))


def _matrices(found: DataFrame, n: int = 64) -> DataFrame:
    cells = found.select("subject", F.posexplode("matrix").alias("k", "v"))
    return cells.select("subject", F.floor(F.col("k") / n).cast("int").alias("i"), (F.col("k") % n).cast("int").alias("j"), (F.round("v", 4) + 0.0).alias("value"))


#: Shrunk covariances of each subject, and their inverses: one pivot a round, every cell from its row's and its column's.
INVERSE = """C AS MATERIALIZED (SELECT vec_id % 5 AS subject, vec_id, i - 1 AS i, embedding[i]::DOUBLE - avg(embedding[i]::DOUBLE) OVER (PARTITION BY vec_id % 5, i) AS x FROM embeddings, range(1, 65) r(i)),
  S AS MATERIALIZED (SELECT a.subject, a.i, b.i AS j, avg(a.x * b.x) AS s, count(*) AS n FROM C a JOIN C b USING (subject, vec_id) GROUP BY ALL),
  O AS (SELECT subject, sum(q * q) AS four FROM (SELECT subject, vec_id, sum(x * x) AS q FROM C GROUP BY ALL) GROUP BY subject),
  T AS (SELECT subject, n, sum(CASE WHEN i = j THEN s END) / 64 AS mu, sum(s * s) AS two FROM S GROUP BY ALL),
  H AS (SELECT subject, mu, (two - 64 * mu * mu) / 64 AS spread, (four / n - two) / (n * 64) AS noise FROM T JOIN O USING (subject)),
  W AS (SELECT subject, mu, CASE WHEN spread = 0 THEN 0 ELSE least(greatest(noise, 0), spread) / spread END AS w FROM H),
  A AS (SELECT -1 AS k, subject, i, j, (1 - w) * s + CASE WHEN i = j THEN w * mu ELSE 0 END AS v FROM S JOIN W USING (subject)),
  G AS (SELECT * FROM A UNION ALL
    SELECT k + 1, subject, i, j, CASE WHEN i = k + 1 AND j = k + 1 THEN 1 / p WHEN i = k + 1 THEN v / p WHEN j = k + 1 THEN -v / p ELSE v - u * t / p END
    FROM (SELECT *, max(CASE WHEN j = k + 1 THEN v END) OVER (PARTITION BY subject, i) AS u, max(CASE WHEN i = k + 1 THEN v END) OVER (PARTITION BY subject, j) AS t,
      max(CASE WHEN i = k + 1 AND j = k + 1 THEN v END) OVER (PARTITION BY subject) AS p FROM G WHERE k < 63)),
  P AS (SELECT subject, i::INT AS i, j::INT AS j, v FROM G WHERE k = 63)"""


@query("connectivity_precision", f"WITH RECURSIVE {INVERSE} SELECT subject, i, j, round(v, 4) + 0.0 AS value FROM P")
def connectivity_precision(spark, d):
    return _matrices(decompose.ConnectivityMatrix("precision").fit_transform(_subjects(spark, d)))


@query("connectivity_partial_correlation", f"WITH RECURSIVE {INVERSE}, D AS (SELECT subject, i AS k, v AS d FROM P WHERE i = j) SELECT P.subject, P.i, P.j, CASE WHEN P.i = P.j THEN 1 ELSE round(-P.v / sqrt(a.d * b.d), 4) + 0.0 END AS value FROM P JOIN D a ON a.subject = P.subject AND a.k = P.i JOIN D b ON b.subject = P.subject AND b.k = P.j")
def connectivity_partial_correlation(spark, d):
    return _matrices(decompose.ConnectivityMatrix("partial correlation").fit_transform(_subjects(spark, d)))


@query("connectivity_tangent")
def connectivity_tangent(spark, d):
    return _matrices(decompose.ConnectivityMatrix("tangent").fit_transform(_subjects(spark, d)))


def _eigen(n: int = 3, squarings: int = 12) -> str:
    """SQL for the n leading eigenvectors of the symmetric matrix A0 (i, j, v): powers by squaring, then deflation."""
    out = []
    for k in range(n):
        out.append(f"P{k}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(abs(v)) FROM A{k}) AS v FROM A{k})")
        for s_ in range(squarings):
            out.append(f"Q{k}_{s_} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM P{k}_{s_} a JOIN P{k}_{s_} b ON a.j = b.i GROUP BY ALL)")
            out.append(f"P{k}_{s_ + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(abs(v)) FROM Q{k}_{s_}) AS v FROM Q{k}_{s_})")
        best = f"(SELECT i FROM P{k}_{squarings} WHERE i = j ORDER BY v DESC, i LIMIT 1)"
        out.append(f"U{k} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS u FROM P{k}_{squarings} WHERE j = {best})")
        out.append(f"L{k} AS MATERIALIZED (SELECT sum(a.u * v * b.u) AS l FROM A{k} JOIN U{k} a USING (i) JOIN U{k} b ON A{k}.j = b.i)")
        out.append(f"A{k + 1} AS MATERIALIZED (SELECT A{k}.i, A{k}.j, v - l * a.u * b.u AS v FROM A{k} JOIN U{k} a USING (i) JOIN U{k} b ON A{k}.j = b.i, L{k})")
    return ",\n  ".join(out)


#: A voxel's weight is its entry in the voxels' eigenvector; the sign makes the largest entry in time positive.
@query("pca_scores", f"""WITH {E}, C AS MATERIALIZED (SELECT voxel_id, t_idx, value - avg(value) OVER (PARTITION BY voxel_id) AS v FROM E),
  A0 AS MATERIALIZED (SELECT a.voxel_id AS i, b.voxel_id AS j, sum(a.v * b.v) AS v FROM C a JOIN C b USING (t_idx) GROUP BY ALL),
  {_eigen()},
  W AS ({" UNION ALL ".join(f"SELECT i AS voxel_id, {k} AS component, u FROM U{k}" for k in range(3))}),
  T AS (SELECT component, t_idx, sum(u * v) AS s FROM W JOIN C USING (voxel_id) GROUP BY ALL), G AS (SELECT component, arg_max(s, abs(s)) AS top FROM T GROUP BY 1)
  SELECT voxel_id, component, round(u * sign(top), 5) + 0.0 AS value FROM W JOIN G USING (component)""")
def pca_scores(spark, d):
    s = to_series(_m(spark, d))
    return to_long(decompose.PCA(3).fit(s).maps(s), time="component").select("voxel_id", "component", (F.round("value", 5) + 0.0).alias("value"))


def _positive(spark, d):
    return checkpointed(to_series(views.matrix(spark, d).select("voxel_id", "t_idx", F.abs("value").alias("value"))))  # read once in each round


@query("nmf")
def nmf(spark, d):
    return to_long(decompose.nmf(_positive(spark, d), 3)[0], time="component").select("voxel_id", "component", r("value", 3))


def _mixed(spark, d):
    """Parts as voxels of six times: six mixtures of size, price and a remainder, which are independent and not normal."""
    sources = F.array((F.col("p_size") / 14).alias("a"), F.col("p_retailprice") / 100, (F.col("p_partkey") % 7).cast("double"))
    mix = lambda t: sum((sources[j] * float(np.cos(1.0 + 2 * t * (j + 1)) + (j == t)) for j in range(3)), F.lit(0.0))
    return checkpointed(views.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("voxel_id"), F.array(*[mix(t) for t in range(6)]).alias("series")))


@query("fast_ica")
def fast_ica(spark, d):
    return to_long(decompose.fast_ica(_mixed(spark, d), 3)[0], time="component").select("voxel_id", "component", r("value", 3))


def _sections(rate: float, low: float, high: float, order: int = 5) -> str:
    """SQL that filters Y (voxel_id, k, x) forwards and backwards by second-order sections, from the state of its first value.

    A pass goes along k with the states of all sections in a list; one section's output is the next one's input.
    """
    from ..functions import filters

    sections = filters.butterworth(order, rate, low, high)
    states, gain = [], 1.0
    for sec in sections:
        states.append(filters.steady_state(sec) * gain)
        gain *= sec[:3].sum() / sec[3:].sum()
    flat = "[" + ", ".join(repr(float(v)) for st in states for v in st) + "]"

    def one(name: str, source: str) -> str:
        steps, value = [], "x"
        for q, (b0, b1, b2, _, a1, a2) in enumerate(np.asarray(sections, float).tolist()):
            y = f"y{q}"
            steps.append((y, f"{b0!r} * {value} + z[{2 * q + 1}]", f"{b1!r} * {value} - {a1!r} * {y} + z[{2 * q + 2}]", f"{b2!r} * {value} - {a2!r} * {y}"))
            value = y
        inner = "s"
        for y, expression, _, _ in steps:
            inner = f"(SELECT *, {expression} AS {y} FROM {inner})"
        z = ", ".join(f"{p}, {r_}" for _, _, p, r_ in steps)
        first = f"SELECT voxel_id, 0::BIGINT AS k, NULL::DOUBLE AS y, list_transform({flat}, lambda c: c * x) AS z FROM {source} WHERE k = 1"
        inner = inner.replace("FROM s)", f"FROM (SELECT w.voxel_id, n.k, n.x, w.z FROM {name} w JOIN {source} n ON n.voxel_id = w.voxel_id AND n.k = w.k + 1))")
        return f"{name}(voxel_id, k, y, z) AS ({first} UNION ALL SELECT voxel_id, k, {value}, [{z}] FROM {inner})"

    taps = 2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 5] == 0).sum()))
    pad = 3 * taps
    return f"""N AS (SELECT max(t_idx) + 1 AS n FROM E),
  Y AS MATERIALIZED (SELECT voxel_id, t_idx + 1 + {pad} AS k, value AS x FROM E
    UNION ALL SELECT voxel_id, {pad} + 1 - t_idx, 2 * first_value(value) OVER w - value FROM E WINDOW w AS (PARTITION BY voxel_id ORDER BY t_idx) QUALIFY t_idx BETWEEN 1 AND {pad}
    UNION ALL SELECT voxel_id, {pad} + 2 * n - 1 - t_idx, 2 * last_value(value) OVER w - value FROM E, N WINDOW w AS (PARTITION BY voxel_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) QUALIFY t_idx BETWEEN n - 1 - {pad} AND n - 2),
  {one("F1", "Y")},
  Y2 AS MATERIALIZED (SELECT voxel_id, n + {2 * pad} + 1 - k AS k, y AS x FROM F1, N WHERE k > 0),
  {one("F2", "Y2")},
  BW AS (SELECT voxel_id, n + {2 * pad} + 1 - k - 1 - {pad} AS t_idx, y AS value FROM F2, N WHERE k > 0 AND n + {2 * pad} + 1 - k BETWEEN {pad} + 1 AND {pad} + n)"""


@query("butterworth_filter", f"WITH RECURSIVE {E}, {_sections(2.0, 0.05, 0.4)} SELECT voxel_id, t_idx, round(value, 5) + 0.0 AS value FROM BW")
def butterworth_filter(spark, d):
    return to_long(series.filter_butterworth(to_series(_m(spark, d)), 2.0, 0.05, 0.4)).select("voxel_id", F.col("t_idx").cast("long").alias("t_idx"), (F.round("value", 5) + 0.0).alias("value"))


#: Censored at once; then what is left of each voxel beside a confound, two drifts and the constant, taken off one after
#: the other as orthogonal columns; then z-scores.
_C = "sum({a} * {b}) OVER () / sum({b} * {b}) OVER ()"
@query("clean_cosine", f"""WITH {E}, N AS (SELECT count(DISTINCT t_idx) AS n FROM E),
  C0 AS (SELECT t_idx, 1.0 AS a, sin(t_idx / 9.0) AS b, sqrt(2.0 / n) * cos(pi() / n * (t_idx + 0.5)) AS c, sqrt(2.0 / n) * cos(pi() / n * (t_idx + 0.5) * 2) AS d FROM (SELECT DISTINCT t_idx FROM E), N WHERE t_idx % 17 <> 3),
  C1 AS (SELECT t_idx, a, b - a * {_C.format(a="b", b="a")} AS b, c - a * {_C.format(a="c", b="a")} AS c, d - a * {_C.format(a="d", b="a")} AS d FROM C0),
  C2 AS (SELECT t_idx, a, b, c - b * {_C.format(a="c", b="b")} AS c, d - b * {_C.format(a="d", b="b")} AS d FROM C1),
  C3 AS (SELECT t_idx, a, b, c, d - c * {_C.format(a="d", b="c")} AS d FROM C2),
  K AS (SELECT voxel_id, sum(value * a) / sum(a * a) AS ka, sum(value * b) / sum(b * b) AS kb, sum(value * c) / sum(c * c) AS kc, sum(value * d) / sum(d * d) AS kd FROM E JOIN C3 USING (t_idx) GROUP BY 1),
  X AS (SELECT voxel_id, t_idx, value - ka * a - kb * b - kc * c - kd * d AS x FROM E JOIN C3 USING (t_idx) JOIN K USING (voxel_id))
  SELECT voxel_id, row_number() OVER (PARTITION BY voxel_id ORDER BY t_idx) - 1 AS t_idx, round((x - avg(x) OVER w) / stddev_samp(x) OVER w, 6) + 0.0 AS value FROM X WINDOW w AS (PARTITION BY voxel_id)""")
def clean_cosine(spark, d):
    n = views.table(spark, d, "embeddings").count()
    t = np.arange(n)
    out = series.clean(to_series(_m(spark, d)), n, standardize_method="zscore", low_cutoff=1.01 / n, filter_method="cosine", confounds=np.sin(t / 9.0)[:, None], sample_mask=t % 17 != 3)
    return to_long(out).select("voxel_id", F.col("t_idx").cast("long").alias("t_idx"), (F.round("value", 6) + 0.0).alias("value"))


#: Censored samples lie between their neighbours, or are the last kept one; the line goes, censoring follows, and signals
#: without their mean get it back before the percentages.
@query("clean_percent", f"""WITH {E}, L AS (SELECT voxel_id, t_idx, value + 3 AS value, avg(value + 3) OVER (PARTITION BY voxel_id) AS mean FROM E),
  I AS (SELECT voxel_id, t_idx, mean, CASE WHEN t_idx % 17 <> 3 THEN value ELSE (lag(value) OVER w + coalesce(lead(value) OVER w, lag(value) OVER w)) / 2 END AS x FROM L WINDOW w AS (PARTITION BY voxel_id ORDER BY t_idx)),
  D AS (SELECT voxel_id, t_idx, mean, x - avg(x) OVER v - covar_pop(x, t_idx) OVER v / var_pop(t_idx) OVER v * (t_idx - avg(t_idx) OVER v) AS x FROM I WINDOW v AS (PARTITION BY voxel_id)),
  K AS (SELECT voxel_id, t_idx, mean, x, avg(x) OVER v AS after FROM D WHERE t_idx % 17 <> 3 WINDOW v AS (PARTITION BY voxel_id)),
  R AS (SELECT avg(abs(after)) / avg(abs(mean)) < 0.1 AS lost FROM (SELECT DISTINCT voxel_id, after, mean FROM K)),
  Y AS (SELECT voxel_id, t_idx, x + CASE WHEN lost THEN mean ELSE 0 END AS y FROM K, R)
  SELECT voxel_id, row_number() OVER (PARTITION BY voxel_id ORDER BY t_idx) - 1 AS t_idx, round((y - avg(y) OVER v) / abs(avg(y) OVER v) * 100, 4) + 0.0 AS value FROM Y WINDOW v AS (PARTITION BY voxel_id)""")
def clean_percent(spark, d):
    n = views.table(spark, d, "embeddings").count()
    out = series.clean(to_series(_m(spark, d).withColumn("value", F.col("value") + 3)), n, detrend_order=1, standardize_method="psc", sample_mask=np.arange(n) % 17 != 3)
    return to_long(out).select("voxel_id", F.col("t_idx").cast("long").alias("t_idx"), (F.round("value", 4) + 0.0).alias("value"))


@query("clean_pipeline")
def clean_pipeline(spark, d):
    n = views.table(spark, d, "embeddings").count()
    t = np.arange(n)
    out = series.clean(to_series(_m(spark, d)), n, detrend_order=1, standardize_method="zscore", low_cutoff=0.01, confounds=np.sin(t / 9.0)[:, None], sample_mask=t % 17 != 3)
    return to_long(out).select("voxel_id", "t_idx", r("value"))


SCRUBBED = """V AS (SELECT voxel_id, t_idx, value FROM E UNION ALL SELECT DISTINCT -1, t_idx, sin(t_idx / 9.0) FROM E),
  F AS (SELECT voxel_id, t_idx, CASE WHEN t_idx % 17 = 3 THEN (lag(value) OVER w + lead(value) OVER w) / 2 ELSE value END AS v FROM V WINDOW w AS (PARTITION BY voxel_id ORDER BY t_idx)),
  D AS (SELECT voxel_id, t_idx, v - avg(v) OVER p - regr_slope(v, t_idx) OVER p * (t_idx - avg(t_idx) OVER p) AS v FROM F WINDOW p AS (PARTITION BY voxel_id)),
  K AS (SELECT * FROM D WHERE t_idx % 17 <> 3),
  C AS (SELECT t_idx, v - avg(v) OVER () AS c FROM K WHERE voxel_id = -1),
  G AS (SELECT voxel_id, t_idx, v - c * sum(c * v) OVER p / sum(c * c) OVER p AS v FROM K JOIN C USING (t_idx) WHERE voxel_id >= 0 WINDOW p AS (PARTITION BY voxel_id))
  SELECT voxel_id, (row_number() OVER (PARTITION BY voxel_id ORDER BY t_idx) - 1)::INT AS t_idx, round((v - avg(v) OVER p) / stddev_samp(v) OVER p, 6) + 0.0 AS value FROM G WINDOW p AS (PARTITION BY voxel_id)"""


@query("clean_scrubbed", f"WITH {E}, {SCRUBBED}")
def clean_scrubbed(spark, d):
    n = views.table(spark, d, "embeddings").count()
    t = np.arange(n)
    out = series.clean(to_series(_m(spark, d)), n, detrend_order=1, standardize_method="zscore", confounds=np.sin(t / 9.0)[:, None], sample_mask=t % 17 != 3)
    return to_long(out).select("voxel_id", "t_idx", (F.round("value", 6) + 0.0).alias("value"))


#: The upper tail of t by Simpson's rule over 2,000 steps, and the normal score of it by Newton's method on the series of
#: the normal distribution.
TAIL = "0.5 - exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(dof * pi()) * t / 6000 * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-(dof + 1) / 2 * ln(1 + (t * i / 2000) ** 2 / dof))))"
SCORE = "list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(40), lambda i: i::DOUBLE)), lambda z, i: z + greatest(-1, least(1, (0.5 - p) * sqrt(2 * pi()) * exp(z * z / 2) - list_sum(list_transform(range(120), lambda k: CASE WHEN z = 0 THEN 0 ELSE sign(z) * exp((2 * k + 1) * ln(abs(z)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) END)))))"


@query("glm_ar1", f"""WITH {OLS}, R0 AS (SELECT voxel_id, t_idx, value AS y, (t_idx % 10)::DOUBLE AS a, label::DOUBLE AS b, 1.0 AS c FROM E),
  R1 AS (SELECT r.*, y - my - ca * (a - ma) - cb * (b - mb) AS e FROM R0 r JOIN C USING (voxel_id)),
  R2 AS (SELECT *, lag(e) OVER w AS e1, coalesce(lag(y) OVER w, 0) AS y1, coalesce(lag(a) OVER w, 0) AS a1, coalesce(lag(b) OVER w, 0) AS b1, coalesce(lag(c) OVER w, 0) AS c1 FROM R1 WINDOW w AS (PARTITION BY voxel_id ORDER BY t_idx)),
  RHO AS (SELECT voxel_id, coalesce(sum(e * e1), 0) / sum(e * e) AS rho FROM R2 GROUP BY 1),
  W AS (SELECT voxel_id, y - rho * y1 AS y, a - rho * a1 AS a, b - rho * b1 AS b, c - rho * c1 AS c FROM R2 JOIN RHO USING (voxel_id)),
  M AS (SELECT voxel_id, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS yb, sum(c * y) AS cy FROM W GROUP BY 1),
  I AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM M),
  T AS (SELECT *, (bb * cc - bc * bc) / det AS iaa, ((bb * cc - bc * bc) * ay + (ac * bc - ab * cc) * yb + (ab * bc - ac * bb) * cy) / det AS ta,
    ((ac * bc - ab * cc) * ay + (aa * cc - ac * ac) * yb + (ab * ac - aa * bc) * cy) / det AS tb, ((ab * bc - ac * bb) * ay + (ab * ac - aa * bc) * yb + (aa * bb - ab * ab) * cy) / det AS tc FROM I),
  S2 AS (SELECT voxel_id, any_value(ta) AS effect, any_value(n - 3)::DOUBLE AS dof, any_value(iaa) * sum((y - ta * a - tb * b - tc * c) ** 2) / any_value(n - 3) AS variance FROM W JOIN T USING (voxel_id) GROUP BY 1),
  Q AS (SELECT voxel_id, effect, dof, effect / sqrt(variance) AS t FROM S2), PV AS (SELECT *, {TAIL} AS p FROM Q)
  SELECT voxel_id, round(effect, 6) + 0.0 AS effect, round(t, 5) + 0.0 AS statistic, round(p, 6) AS p, round({SCORE}, 4) + 0.0 AS z FROM PV""")
def glm_ar1(spark, d):
    x = _two(spark, d).orderBy("t_idx").toPandas()
    f = glm.fit(to_series(_m(spark, d)), np.column_stack([x["a"], x["b"], np.ones(len(x))]), "ar1")
    out = glm.with_tails(glm.statistic(glm.contrast(f, np.array([1.0, 0.0, 0.0]))))
    return out.select("voxel_id", (F.round("effect", 6) + 0.0).alias("effect"), (F.round("statistic", 5) + 0.0).alias("statistic"), r("p"), (F.round("z", 4) + 0.0).alias("z"))


#: Five runs, dealt by the time's remainder, each with its own design; t of the difference of two effects, pooled.
@query("glm_runs", f"""WITH {E}, Y AS (SELECT t_idx % 5 AS run, voxel_id, value AS y, (t_idx % 7)::DOUBLE AS a, label::DOUBLE AS b FROM E),
  S AS (SELECT run, voxel_id, count(*) AS n, var_pop(a) AS saa, var_pop(b) AS sbb, covar_pop(a, b) AS sab, covar_pop(y, a) AS say, covar_pop(y, b) AS sby, var_pop(y) AS syy FROM Y GROUP BY ALL),
  C AS (SELECT *, saa * sbb - sab * sab AS det, (say * sbb - sby * sab) / det AS ca, (sby * saa - say * sab) / det AS cb FROM S),
  K AS (SELECT voxel_id, ca - cb AS e, (syy - ca * say - cb * sby) * n / (n - 3) * (sbb + saa + 2 * sab) / det / n AS v, (n - 3)::DOUBLE AS dof FROM C)
  SELECT voxel_id, round(sum(e) / count(*), 6) + 0.0 AS effect, round(sum(v) / count(*) ** 2, 9) AS variance, sum(dof) AS dof, round(sum(e) / sqrt(sum(v)), 5) + 0.0 AS statistic FROM K GROUP BY 1""")
def glm_runs(spark, d):
    run, t = (F.col("t_idx") % 5).cast("int").alias("run"), F.floor(F.col("t_idx") / 5).cast("int").alias("t_idx")
    samples = _m(spark, d).select(run, t, "voxel_id", "value")
    e = views.table(spark, d, "embeddings").withColumnRenamed("vec_id", "t_idx")
    given = e.select(run, t, (F.col("t_idx") % 7).cast("double").alias("a"), F.col("label").cast("double").alias("b"), F.lit(1.0).alias("constant"))
    out = runs.RunsModel(noise="ols").fit(samples, given=given).contrast("a - b")
    return out.select("voxel_id", (F.round("effect", 6) + 0.0).alias("effect"), r("variance", 9), "dof", (F.round("statistic", 5) + 0.0).alias("statistic"))


#: Two voxels: what is left without the strongest component is the other one of their 2 x 2 covariance, in closed form.
@query("svd_clutter_power_doppler", f"""WITH {WIN}, J AS (SELECT window_id, t_idx, max(CASE WHEN voxel_id = 0 THEN re END) AS p, max(CASE WHEN voxel_id = 0 THEN im END) AS q, max(CASE WHEN voxel_id = 1 THEN re END) AS r, max(CASE WHEN voxel_id = 1 THEN im END) AS s FROM X GROUP BY ALL),
  C AS (SELECT window_id, count(*) AS n, count(p) AS n0, count(r) AS n1, sum(coalesce(p * p + q * q, 0)) AS a, sum(coalesce(r * r + s * s, 0)) AS b, sum(coalesce(p * r + q * s, 0)) AS x, sum(coalesce(p * s - q * r, 0)) AS y FROM J GROUP BY 1),
  L AS (SELECT *, (a + b - sqrt((a - b) ** 2 + 4 * (x * x + y * y))) / 2 AS least FROM C),
  U AS (SELECT *, x * x + y * y + (least - a) ** 2 AS size FROM L)
  SELECT window_id, 0 AS voxel_id, round(CASE WHEN size = 0 THEN 0 ELSE least * (x * x + y * y) / size / n END, 3) + 0.0 AS value FROM U WHERE n0 > 0
  UNION ALL SELECT window_id, 1, round(CASE WHEN size = 0 THEN 0 ELSE least * (least - a) ** 2 / size / n END, 3) + 0.0 FROM U WHERE n1 > 0""")
def svd_clutter(spark, d):
    return windows.filtered_power_doppler(_windowed(spark, d), low=1).select("window_id", "voxel_id", (F.round("value", 3) + 0.0).alias("value"))


SEARCHLIGHT = """Y AS (SELECT vec_id AS t_idx, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS j FROM embeddings),
  K AS (SELECT label, count(*) AS n, min(t_idx) AS f FROM Y GROUP BY label),
  S AS (SELECT label, n, (sum(n) OVER (ORDER BY f) - n)::BIGINT AS s FROM K),
  A AS (SELECT label, fold, (s + n - fold + 4) // 5 - (s - fold + 4) // 5 AS c FROM S, range(5) r(fold)),
  C AS (SELECT label, fold, sum(c) OVER (PARTITION BY label ORDER BY fold) AS hi, c FROM A),
  Z AS (SELECT t_idx, label, fold, embedding FROM Y JOIN C USING (label) WHERE j < hi AND j >= hi - c),
  D AS (SELECT t_idx, label, fold, v - 1 AS voxel_id, embedding[v]::DOUBLE AS value FROM Z, range(1, 65) r(v)),
  M AS (SELECT g.fold, voxel_id, label AS guess, avg(value) AS mean FROM D JOIN range(5) g(fold) ON D.fold <> g.fold GROUP BY ALL),
  N AS (SELECT a AS center, b AS voxel_id FROM range(64) x(a), range(64) y(b) WHERE (a % 8 - b % 8) ** 2 + (a // 8 - b // 8) ** 2 <= 1),
  Q AS (SELECT center, t_idx, fold, label, guess, sum((value - mean) ** 2) AS q FROM D JOIN M USING (fold, voxel_id) JOIN N USING (voxel_id) GROUP BY ALL),
  P AS (SELECT center, t_idx, fold, label, arg_min(guess, q) AS guess FROM Q GROUP BY ALL),
  F AS (SELECT center, fold, avg((guess = label)::INT) AS share FROM P GROUP BY ALL)
  SELECT center AS voxel_id, round(avg(share), 6) AS score FROM F GROUP BY center"""


@query("searchlight", f"WITH {SEARCHLIGHT}")
def searchlight(spark, d):
    e = views.table(spark, d, "embeddings")
    y = np.array([x[0] for x in e.orderBy("vec_id").select("label").collect()])  # a target by time
    v = spark.range(64).select(F.col("id").alias("voxel_id"), (F.col("id") % 8).cast("double").alias("x"), F.floor(F.col("id") / 8).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return decompose.searchlight(to_series(_m(spark, d)), v, y, 1.0).select("voxel_id", r("score"))


@query("searchlight_neighbourhoods", "WITH C AS (SELECT p_partkey AS voxel_id, p_size / 5.0 AS x, (p_retailprice - 900) / 50 AS y, (p_partkey % 7)::DOUBLE AS z FROM part) SELECT a.voxel_id AS center, b.voxel_id FROM C a JOIN C b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 2.25")
def searchlight_neighbourhoods(spark, d):
    v = views.table(spark, d, "part").select(F.col("p_partkey").alias("voxel_id"), (F.col("p_size") / 5.0).alias("x"), ((F.col("p_retailprice") - 900) / 50).alias("y"), (F.col("p_partkey") % 7).cast("double").alias("z"))
    return decompose.neighbourhoods(v, v, 1.5)


@query("framewise_displacement", """WITH P AS (SELECT p_partkey, p_size::DOUBLE AS px, p_retailprice / 100 AS py, (p_partkey % 7)::DOUBLE AS pz FROM part),
  F AS (SELECT k AS t_idx, k * 0.1 AS tx, 1 + k * 0.001 AS s, lead(k * 0.1) OVER (ORDER BY k) AS tx1, lead(1 + k * 0.001) OVER (ORDER BY k) AS s1 FROM range(20) t(k)),
  D AS (SELECT t_idx, coalesce(sqrt(((s1 - s) * px + tx1 - tx) ** 2 + ((s1 - s) * py) ** 2 + ((s1 - s) * pz) ** 2), 0) AS d FROM F, P)
  SELECT t_idx, round(avg(d), 6) AS mean_fd, round(max(d), 6) AS max_fd, round(sqrt(avg(d * d)), 6) AS rms_fd FROM D GROUP BY 1""")
def framewise_displacement(spark, d):
    points = views.table(spark, d, "part").select(F.col("p_size").cast("double").alias("px"), (F.col("p_retailprice") / 100).alias("py"), (F.col("p_partkey") % 7).cast("double").alias("pz"))
    k, s = F.col("id"), 1 + F.col("id") * 0.001
    row = lambda *x: F.array(*[v.cast("double") if hasattr(v, "cast") else F.lit(float(v)) for v in x])
    affines = spark.range(20).select(k.alias("t_idx"), F.array(row(s, 0, 0, k * 0.1), row(0, s, 0, 0), row(0, 0, s, 0), row(0, 0, 0, 1)).alias("m"))
    return reductions.framewise_displacement(affines, points).select("t_idx", r("mean_fd"), r("max_fd"), r("rms_fd"))


@query("affine_apply", "SELECT p_partkey, round(2.0 * p_size + 0.5 * p_retailprice + 1, 6) AS x, round(p_retailprice - 3.0, 6) AS y, round(-1.0 * (p_partkey % 7) + 0.25 * p_size, 6) AS z FROM part")
def affine_apply(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 7).alias("z"))
    return spatial.apply_affine(p, np.array([[2, 0.5, 0, 1], [0, 1, 0, -3], [0.25, 0, -1, 0], [0, 0, 0, 1]])).select("p_partkey", r("x"), r("y"), r("z"))


@query("nearest_slice", "WITH C AS (SELECT DISTINCT s_acctbal AS c FROM supplier), T AS (SELECT k * 1000.0 AS target FROM range(10) t(k)) SELECT target, (SELECT c FROM C ORDER BY abs(c - target), c LIMIT 1) AS coord FROM T")
def nearest_slice(spark, d):
    c = views.table(spark, d, "supplier").select(F.col("s_acctbal").alias("coord")).distinct()
    return spatial.nearest_slice(c, spark.range(10).select((F.col("id") * 1000.0).alias("target")))


@query("centers_to_edges", "WITH C AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, lag(c) OVER (ORDER BY c) AS p, lead(c) OVER (ORDER BY c) AS n FROM (SELECT DISTINCT s_acctbal AS c FROM supplier)) SELECT i AS idx, round(CASE WHEN p IS NULL THEN c - (n - c) / 2 ELSE (p + c) / 2 END, 6) AS edge FROM C UNION ALL SELECT i + 1, round(c + (c - p) / 2, 6) FROM C WHERE n IS NULL")
def centers_to_edges(spark, d):
    c = views.table(spark, d, "supplier").select(F.col("s_acctbal").alias("coord")).distinct()
    return spatial.centers_to_edges(c).select(F.col("idx").cast("long").alias("idx"), r("edge"))


@query("slice_times", f"WITH {V}, T AS (SELECT DISTINCT t_idx, t_idx * 2.0 AS time FROM V), S AS (SELECT t_idx, z AS z_idx, time + z * 0.25 AS slice_time FROM T, range(8) t(z)) SELECT t_idx, z_idx, slice_time FROM S")
def slice_times(spark, d):
    t = views.days(spark, d).select("t_idx").distinct().withColumn("time", F.col("t_idx") * 2.0)
    return spatial.slice_times(t, 8, 2.0)


@query("consolidated_volume_times", f"WITH {V} SELECT DISTINCT t_idx, t_idx * 2.0 AS time, 2.0 AS duration FROM V")
def consolidated_volume_times(spark, d):
    return spatial.consolidated_times(slice_times(spark, d), 0.25).select("t_idx", "time", "duration")


def _structures(spark, d):
    tree = views.hierarchy(spark, d)
    return tree.join(atlas.with_paths(tree), "id")


_TREE = f"{H}, T AS (SELECT id, [id] AS path FROM H WHERE parent_id IS NULL UNION ALL SELECT H.id, list_append(T.path, H.id) FROM T JOIN H ON H.parent_id = T.id)"


@query("region_search", f"WITH {H} SELECT id, acronym, name FROM H WHERE regexp_matches(acronym, '(?i)an|EU') OR regexp_matches(name, '(?i)an|EU')")
def region_search(spark, d):
    return atlas.search(views.hierarchy(spark, d), "an|EU").select("id", "acronym", "name")


@query("descendants", f"WITH RECURSIVE {_TREE} SELECT id FROM T WHERE list_contains(path, 1002)")
def descendants(spark, d):
    return atlas.descendants(_structures(spark, d), 1002).select("id")


@query("ancestors", f"WITH RECURSIVE {_TREE} SELECT (k - 1)::INT AS depth, path[k] AS id FROM T, range(1, 10) t(k) WHERE T.id = 2003 AND k < len(path)")
def ancestors(spark, d):
    return atlas.ancestors(_structures(spark, d), 2003)


@query("region_masks", f"WITH RECURSIVE {_TREE} SELECT c_custkey AS voxel_id, r.id AS region, r.acronym || '_L' AS layer FROM customer JOIN T ON T.id = c_nationkey + 2000 JOIN H r ON list_contains(T.path, r.id) WHERE r.id IN (1, 1001, 2005) AND c_custkey % 2 = 1")
def region_masks(spark, d):
    v = views.table(spark, d, "customer").select(F.col("c_custkey").alias("voxel_id"), (F.col("c_nationkey") + 2000).cast("long").alias("annotation"), F.when(F.col("c_custkey") % 2 == 1, 1).otherwise(2).alias("hemisphere"))
    return atlas.region_masks(v, _structures(spark, d), [1, 1001, 2005], "left")


@query("nearest_voxels", "SELECT p_partkey, y_idx, x_idx, CASE WHEN y_idx < 10 AND x_idx < 10 THEN y_idx * 10 + x_idx END AS voxel_id FROM (SELECT p_partkey, floor((p_retailprice - 900) / 100 + 0.5)::INT AS y_idx, floor(p_size / 4.0 + 0.5)::INT AS x_idx FROM part)")
def nearest_voxels(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", F.lit(0.0).alias("z"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("x"))
    v = spark.range(100).select(F.lit(0).alias("z_idx"), F.floor(F.col("id") / 10).cast("int").alias("y_idx"), (F.col("id") % 10).cast("int").alias("x_idx"), F.col("id").alias("voxel_id"))
    return atlas.nearest_voxels(p, v, (1.0, 100.0, 4.0), (0.0, 900.0, 0.0)).select("p_partkey", "y_idx", "x_idx", "voxel_id")


@query("download_sync", "SELECT o_orderkey::VARCHAR AS path, 'missing' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2) UNION ALL SELECT o_orderkey::VARCHAR, 'changed' FROM orders JOIN (SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linenumber = 2) ON l_orderkey = o_orderkey WHERE o_orderstatus <> l_returnflag")
def download_sync(spark, d):
    remote = views.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("hash"))
    local = views.table(spark, d, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_returnflag").alias("hash"))
    return masks.sync_plan(remote, local, refresh=True)


@query("index_merge", "SELECT path, crc, source FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY source DESC, crc DESC) AS n FROM (SELECT o_orderkey AS path, o_custkey AS crc, 0 AS source FROM orders UNION ALL SELECT l_partkey, l_suppkey, 1 FROM lineitem UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_orderstatus = 'F')) WHERE n = 1")
def index_merge(spark, d):
    orders = views.table(spark, d, "orders")
    remote = orders.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("crc"))
    previous = views.table(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("crc"))
    return masks.merge_indexes(remote, previous, remote.where(orders["o_orderstatus"] == "F"))


@query("index_downloads", "WITH L AS (SELECT l_orderkey, max(l_linestatus) FILTER (WHERE l_returnflag = 'N') AS hash FROM lineitem GROUP BY ALL) SELECT o_orderkey AS path, CASE WHEN l_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM orders LEFT JOIN L ON l_orderkey = o_orderkey WHERE hash IS DISTINCT FROM o_orderstatus")
def index_downloads(spark, d):
    members = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("hash"))
    lines = views.table(spark, d, "lineitem")
    previous = lines.filter("l_returnflag = 'N'").select(F.col("l_orderkey").alias("path"), F.col("l_linestatus").alias("hash"))
    return masks.index_downloads(members, lines.select(F.col("l_orderkey").alias("path")), previous, refresh=True)


@query("gaussian_smooth_1d", f"""WITH {E}, S AS (SELECT 2.0 / (2 * sqrt(2 * ln(2))) AS s), K AS (SELECT k, exp(-0.5 * (k / s) ** 2) AS w FROM S, range(-10, 11) t(k) WHERE abs(k) <= floor(4 * s + 0.5)), N AS (SELECT k, w / sum(w) OVER () AS w FROM K),
  Q AS (SELECT v AS o, CASE WHEN (v + k + 128) % 128 < 64 THEN (v + k + 128) % 128 ELSE 127 - (v + k + 128) % 128 END AS voxel_id, w FROM N, range(64) t(v))
  SELECT t_idx, o AS voxel_id, round(sum(value * w), 6) + 0.0 AS value FROM E JOIN Q USING (voxel_id) GROUP BY ALL""")
def gaussian_smooth_1d(spark, d):
    return series.smooth_axis(_m(spark, d), "voxel_id", 64, 2.0).select("t_idx", "voxel_id", (F.round("value", 6) + 0.0).alias("value"))


@query("rolling_mean", f"WITH {R} SELECT voxel_id, t_idx, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 6) END AS value FROM R WINDOW w AS (PARTITION BY voxel_id ORDER BY t_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def rolling_mean(spark, d):
    return series.rolling_mean(views.regions(spark, d), 2, 2, 3).select("voxel_id", "t_idx", r("value"))


@query("first_difference", f"WITH {R} SELECT voxel_id, t_idx, round(value - lag(value) OVER (PARTITION BY voxel_id ORDER BY t_idx), 6) AS value FROM R")
def first_difference(spark, d):
    return series.first_difference(views.regions(spark, d)).select("voxel_id", "t_idx", r("value"))


@query("quantile_cut", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice >= (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem)")
def quantile_cut(spark, d):
    return masks.quantile_cut(views.table(spark, d, "lineitem"), 0.95, "l_extendedprice").select("l_orderkey", "l_linenumber")


@query("concat_mean", f"WITH {E} SELECT t_idx, voxel_id, round((value + abs(value)) / 2, 6) AS value FROM E")
def concat_mean(spark, d):
    m = _m(spark, d)
    return masks.concat_mean([m, m.withColumn("value", F.abs("value"))], ["t_idx", "voxel_id"]).select("t_idx", "voxel_id", r("value"))


@query("argmax_location", f"WITH {E} SELECT t_idx, voxel_id FROM E ORDER BY value DESC, t_idx, voxel_id LIMIT 1")
def argmax_location(spark, d):
    return spatial.argmax_location(_m(spark, d), ("t_idx", "voxel_id"))


@query("merge_on_time", f"WITH {R}, A AS (SELECT t_idx AS time, avg(value) AS a FROM R WHERE voxel_id % 2 = 0 GROUP BY 1), B AS (SELECT t_idx AS time, avg(value) AS b FROM R WHERE voxel_id % 3 = 0 AND t_idx % 2 = 0 GROUP BY 1) SELECT time, round(a, 6) AS a, round(b, 6) AS b FROM A FULL JOIN B USING (time)")
def merge_on_time(spark, d):
    x = views.regions(spark, d).withColumnRenamed("t_idx", "time")
    a = masks.reduce(x.filter("voxel_id % 2 = 0"), ["time"])
    b = masks.reduce(x.filter("voxel_id % 3 = 0 AND time % 2 = 0"), ["time"])
    return masks.merge_on_time({"a": a, "b": b}).select("time", r("a"), r("b"))


@query("group_spans", "WITH E AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM E GROUP BY event_type, g")
def group_spans(spark, d):
    return masks.group_spans(views.table(spark, d, "events"), "event_id", "event_type")


@query("mask_triangle", f"WITH {COV} SELECT i, j, round(value, 6) + 0.0 AS value FROM K WHERE i < j")
def mask_triangle(spark, d):
    k = reductions.covariance(_m(spark, d)).filter(scale.in_triangle(F.col("i"), F.col("j"), "upper"))
    return k.select("i", "j", (F.round("value", 6) + 0.0).alias("value"))


@query("threshold_slices", f"WITH {G} SELECT y_idx, x_idx, CASE WHEN abs(z) <= 2 THEN z END AS z FROM G")
def threshold_slices(spark, d):
    return views.grid(spark, d).select("y_idx", "x_idx", scale.threshold_value(F.col("z"), 2.0, "below").alias("z"))


@query("trial_types", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'dummy' END AS trial_type FROM events")
def trial_types(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), "event_type")).when(F.col("event_id") % 3 == 1, "n/a")
    return views.table(spark, d, "events").select("event_id", scale.normalize_trial_type(raw).alias("trial_type"))


COORDS = "C AS (SELECT l_linestatus AS dim, row_number() OVER (PARTITION BY l_linestatus ORDER BY d) - 1 AS idx, d::DOUBLE AS coord FROM (SELECT DISTINCT l_linestatus, floor(epoch(l_shipdate) / 86400)::BIGINT AS d FROM lineitem))"


def _coords(spark, d):
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400).cast("double")
    c = views.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("dim"), day.alias("coord")).distinct()
    return c.withColumn("idx", F.row_number().over(Window.partitionBy("dim").orderBy("coord")) - 1)


@query("spacings_origins", f"WITH {COORDS}, S AS (SELECT *, coord - lag(coord) OVER (PARTITION BY dim ORDER BY idx) AS s FROM C), M AS (SELECT dim, median(s) AS m, min(coord) AS origin FROM S GROUP BY 1) SELECT M.dim, CASE WHEN max(abs(s - m) > 0.01 * abs(m)) THEN NULL ELSE m END AS spacing, origin FROM S JOIN M USING (dim) GROUP BY M.dim, m, origin")
def spacings_origins(spark, d):
    return validate.spacings(_coords(spark, d)).select("dim", "spacing", "origin")


@query("coordinate_problems", f"WITH {COORDS} SELECT DISTINCT dim, 'not increasing' AS rule FROM C WHERE idx > 0")
def coordinate_problems(spark, d):
    c = _coords(spark, d)
    return validate.coordinate_problems(c.withColumn("coord", -F.col("coord"))).select("dim", "rule")


@query("stack_lags", f"WITH {E}, S AS (SELECT 0.0 AS lag, t_idx, voxel_id, value FROM E UNION ALL SELECT 1.5, t_idx, voxel_id, -value FROM E) SELECT lag, voxel_id, round(avg(value), 6) + 0.0 AS value FROM S GROUP BY ALL")
def stack_lags(spark, d):
    m = _m(spark, d)
    out = masks.stack_lags({0.0: m, 1.5: m.withColumn("value", -F.col("value"))})
    return out.groupBy("lag", "voxel_id").agg(F.avg("value").alias("v")).select("lag", "voxel_id", (F.round("v", 6) + 0.0).alias("value"))


SIDECARS = """S AS (SELECT *, o_orderkey % 3 <> 0 AS rt, o_orderkey % 5 = 0 AS vt, o_custkey % 4 = 0 AS fad FROM orders)
  SELECT o_orderkey, 'RepetitionTime' AS location, 'error' AS level, 'must be > 0' AS message FROM S WHERE rt AND o_custkey % 7 < 2
  UNION ALL SELECT o_orderkey, 'VolumeTiming.1', 'error', 'must be a number' FROM S WHERE vt
  UNION ALL SELECT o_orderkey, 'SliceEncodingDirection', 'error', 'must be one of i, j, k, i-, j-, k-' FROM S WHERE o_custkey % 2 = 1
  UNION ALL SELECT o_orderkey, 'TaskName', 'error', 'must be text' FROM S WHERE o_orderkey % 11 = 0
  UNION ALL SELECT o_orderkey, 'RepetitionTime', 'error', 'excludes VolumeTiming' FROM S WHERE rt AND vt
  UNION ALL SELECT o_orderkey, 'FrameAcquisitionDuration', 'error', 'is needed with VolumeTiming when there is no SliceTiming' FROM S WHERE vt AND NOT fad
  UNION ALL SELECT o_orderkey, 'FrameAcquisitionDuration', 'error', 'excludes RepetitionTime' FROM S WHERE rt AND fad
  UNION ALL SELECT o_orderkey, 'RepetitionTime', 'warning', 'or VolumeTiming should be given with other fields of timing' FROM S WHERE NOT rt AND NOT vt"""


@query("metadata_problems", f"WITH {SIDECARS}")
def metadata_problems(spark, d):
    o = views.table(spark, d, "orders")
    period = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit('"RepetitionTime":'), (F.col("o_custkey") % 7 - 1).cast("string")))
    onsets = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('"VolumeTiming":[0,"'), "o_orderstatus", F.lit('",1.5]')))
    lasts = F.when(F.col("o_custkey") % 4 == 0, F.lit('"FrameAcquisitionDuration":0.5'))
    way = F.concat(F.lit('"SliceEncodingDirection":"'), F.when(F.col("o_custkey") % 2 == 0, "k").otherwise(F.substring("o_orderpriority", 1, 1)), F.lit('"'))
    task = F.concat(F.lit('"TaskName":'), F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderkey").cast("string")).otherwise('"rest"'))
    text = F.concat(F.lit("{"), F.concat_ws(",", period, onsets, lasts, way, task), F.lit("}"))
    return bids.metadata_problems(o.select("o_orderkey", text.alias("text")))


SHIFTS = "F AS (SELECT DISTINCT CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS t_idx FROM lineitem)"


def _shifted(spark, d, value) -> DataFrame:
    """t_idx (return flag), z_idx, y_idx, x_idx, value: items by quantity and price, each frame shifted by its number."""
    li = views.table(spark, d, "lineitem")
    t = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    at = li.select(t.alias("t_idx"), (4 + t + F.floor(F.col("l_quantity") / 4)).cast("int").alias("y_idx"), (4 - t + F.floor(F.col("l_extendedprice") / 8000)).cast("int").alias("x_idx"))
    counts = at.groupBy("t_idx", F.lit(0).alias("z_idx"), "y_idx", "x_idx").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("t_idx"))  # a bounded number of cells in each frame
    return counts.select("t_idx", "z_idx", "y_idx", "x_idx", value(share).alias("value"))


def _moved(samples: DataFrame, **options) -> DataFrame:
    found = spatial.register_volumewise(samples, (1, 24, 24), transform="translation", **options)
    return spatial.motion_table(found.select("t_idx", "m")).select("t_idx", *[(F.round(f"trans_{a}", 0) + 0.0).alias(f"trans_{a}") for a in "xyz"])


@query("register_translation", f"WITH {SHIFTS} SELECT t_idx, -t_idx::DOUBLE AS trans_x, t_idx::DOUBLE AS trans_y, 0.0::DOUBLE AS trans_z FROM F")
def register_translation(spark, d):
    return _moved(_shifted(spark, d, lambda share: share))


@query("register_other_contrast", f"WITH {SHIFTS} SELECT t_idx, -t_idx::DOUBLE AS trans_x, t_idx::DOUBLE AS trans_y, 0.0::DOUBLE AS trans_z FROM F")
def register_other_contrast(spark, d):
    """Frames after the first have their contrast turned round, which correlation can't follow."""
    turned = lambda share: F.when(F.col("t_idx") == 0, share).otherwise(-share)
    return _moved(_shifted(spark, d, turned), metric="mutual_information", bins=16, levels=(2, 1))


@query("resample_bspline", "WITH V AS (SELECT vec_id AS t_idx, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) r(i)) SELECT t_idx, 0 AS z_idx, i // 16 AS y_idx, (i % 8) // 2 AS x_idx, round(v, 6) + 0.0 AS value FROM V WHERE (i // 8) % 2 = 0 AND i % 2 = 0")
def resample_bspline(spark, d):
    """Splines pass through all samples, so every second place has the sample that was there."""
    m = _m(spark, d).select("t_idx", F.lit(0).alias("z_idx"), F.floor(F.col("voxel_id") / 8).cast("int").alias("y_idx"), (F.col("voxel_id") % 8).cast("int").alias("x_idx"), "value")
    out = spatial.resample(m, np.eye(4), ((1, 8, 8), (1, 1, 1), (0, 0, 0)), ((1, 4, 4), (1, 2, 2), (0, 0, 0)), "bspline")
    return out.withColumn("value", F.round("value", 6) + 0.0)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
