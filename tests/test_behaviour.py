"""What operators must give on small inputs, with numbers worked out by hand or by another way than the engine's."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelweave.functions import tails
from voxelweave.operators import glm, layout, reductions, series, thresholds, windows
from voxelweave.sources import volumes


def maps(spark, values, name="z"):
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(values)], f"voxel_id long, {name} double")


def column(df, name, key="voxel_id"):
    return [r[name] for r in df.orderBy(key).select(name).collect()]


def test_a_score_at_the_threshold_stays_and_a_negative_one_keeps_the_lower_tail(spark):
    z = maps(spark, [-4, -3, -2.9, 0, 3, 3.5])
    assert column(thresholds.apply_threshold(z, 3.0), "z") == [-4, -3, 0, 0, 3, 3.5]
    assert column(thresholds.apply_threshold(z, 3.0, two_sided=False), "z") == [0, 0, 0, 0, 3, 3.5]
    assert column(thresholds.apply_threshold(z, -3.0, two_sided=False), "z") == [-4, -3, 0, 0, 0, 0]


def test_statistical_thresholds_and_what_is_tested(spark):
    z = maps(spark, [0, 1.0, 2.0, 3.0, -4.0, float("nan"), 0])
    out, at = thresholds.apply_statistical_threshold(z, 0.05, "uncorrected", skipna=True)
    assert at == pytest.approx(1.959963985, abs=1e-8) and column(out, "z") == [0, 0, 2, 3, -4, 0, 0]
    for skipzero, n in ((False, 6), (True, 4)):
        _, at = thresholds.apply_statistical_threshold(z, 0.05, "bonferroni", skipzero=skipzero, skipna=True)
        assert tails.normal_sf(at) == pytest.approx(0.025 / n, rel=1e-9)
    out, at = thresholds.apply_statistical_threshold(z, 0.05, "bonferroni", two_sided=False, mask=maps(spark, [1, 1, 1, 1]).drop("z"))
    assert column(out, "z") == [0, 0, 0, 3, 0, 0, 0] and tails.normal_sf(at) == pytest.approx(0.05 / 4, rel=1e-9)
    assert thresholds.apply_statistical_threshold(maps(spark, [0.1, 0.2]), 0.05, "holm")[1] == math.inf
    out, at = thresholds.apply_statistical_threshold(z, method=None, threshold=-4.0, two_sided=False, skipna=True)
    assert at == -4 and column(out, "z") == [0, 0, 0, 0, -4, 0, 0]


@pytest.mark.parametrize("method", thresholds.METHODS)
def test_corrections_by_definition(spark, method):
    """Each method from its definition for one hypothesis at a time; hommel from all 2 ** n - 1 intersections."""
    p = [0.01, 0.04, 0.01, 0.2, 0.03, 0.9, 0.0004, 0.03]
    n, s = len(p), sorted(p)
    rank = [sorted(range(n), key=lambda k: (p[k], k)).index(i) + 1 for i in range(n)]
    harmonic = sum(1 / k for k in range(1, n + 1))
    step = {
        "uncorrected": lambda x, r: x, "bonferroni": lambda x, r: n * x, "sidak": lambda x, r: 1 - (1 - x) ** n,
        "holm": lambda x, r: max((n - k) * s[k] for k in range(r)), "holm-sidak": lambda x, r: max(1 - (1 - s[k]) ** (n - k) for k in range(r)),
        "simes-hochberg": lambda x, r: min((n - k) * s[k] for k in range(r - 1, n)), "fdr_bh": lambda x, r: min(n * s[k] / (k + 1) for k in range(r - 1, n)),
        "fdr_by": lambda x, r: min(n * harmonic * s[k] / (k + 1) for k in range(r - 1, n)),
    }
    if method == "hommel":
        sets = [c for k in range(1, n + 1) for c in itertools.combinations(range(n), k)]
        simes = {c: min(len(c) * x / (k + 1) for k, x in enumerate(sorted(p[i] for i in c))) for c in sets}
        want = [max(v for c, v in simes.items() if i in c) for i in range(n)]
    else:
        want = [min(step[method](x, r), 1) for x, r in zip(p, rank, strict=True)]
    got = thresholds.adjust_pvalues(maps(spark, [*p, None], "p").repartition(3), method)
    assert column(got, "p_adjusted") == pytest.approx([*want, 1.0], rel=1e-9)


def test_ranks_over_ranges(spark):
    x = np.random.default_rng(0).integers(0, 40, 500).astype(float)
    order = layout.ranked(maps(spark, x, "p"), "p", "voxel_id")
    got = order.rows.select("voxel_id", "__r").toPandas().set_index("voxel_id")["__r"].sort_index().to_numpy()
    assert order.total == 500 and (got[np.lexsort((np.arange(500), x))] == np.arange(1, 501)).all()
    low = order.running(F.col("p") * -1, "q", upward=False).select("voxel_id", "q").toPandas().set_index("voxel_id")["q"]
    assert (low.sort_index().to_numpy() == -x.max()).all()
    none = layout.ranked(maps(spark, [], "p"), "p", "voxel_id")
    assert none.total == 0 and none.running(F.col("p"), "q", True).count() == 0


def frame(spark, x):
    t, v = np.indices(x.shape)
    return spark.createDataFrame(pd.DataFrame({"t_idx": t.ravel(), "voxel_id": v.ravel(), "value": x.ravel()}))


def test_constant_confounds_take_nothing_off(spark):
    y = layout.to_series(frame(spark, np.array([[1.0], [2], [3], [4], [5]])))
    kept = series.regress_confounds(y, np.ones((5, 1))).first()["series"]
    assert kept == pytest.approx([1, 2, 3, 4, 5])
    assert series.regress_confounds(y, np.ones((5, 1)), standardize_confounds=False).first()["series"] == pytest.approx([-2, -1, 0, 1, 2])


def test_dvars_with_robust_deviations(spark):
    # one voxel goes 0 1 0 1 ...; one is 5 but for a single 9, and its quartiles don't differ, so it is left out
    x = np.column_stack([[0.0, 1, 0, 1, 0, 1, 0, 1], [5.0, 5, 5, 9, 5, 5, 5, 5]])
    got = column(reductions.compute_dvars(frame(spark, x)), "dvars", "t_idx")
    # steps are 1 in size; mean 0.5, so ar1 = sum of -0.25 over 7 steps / (8 * 0.25) = -0.875; deviation 1 / 1.3489795
    want = 1 / (math.sqrt(2 * 1.875) / 1.3489795003921634)
    assert got == pytest.approx([want] * 8)
    assert column(reductions.compute_dvars(frame(spark, x), standardize=False, normalization=10.0), "dvars", "t_idx") == pytest.approx([20.0] * 8)


def test_seeds_and_covariance_of_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 7))
    x[:, 5] = 2.0
    seeds = spark.createDataFrame([(t, r, float(x[t, r] + x[t, 6])) for t in range(30) for r in (0, 3)], "t_idx long, region int, value double")
    want = {(r, v): 0.0 if v == 5 else np.corrcoef(x[:, v], x[:, r] + x[:, 6])[0, 1] for r in (0, 3) for v in range(7)}
    for s in (seeds, seeds.union(spark.createDataFrame([(99, 0, 1.0)], seeds.schema))):  # the second way: a time that voxels lack
        got = {(q.region, q.voxel_id): q.r for q in reductions.seed_correlation(frame(spark, x), s).collect()}
        assert got.keys() == want.keys()
        if s is seeds:
            assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    for block in (2, 100):
        p = reductions.covariance(frame(spark, x), block=block).toPandas()
        got = np.full((7, 7), np.nan)
        got[p.i, p.j] = p.value
        assert len(p) == 49 and np.allclose(got, np.cov(x.T, bias=True))


def test_f_contrasts_of_all_runs(spark):
    """Two runs with one-regressor columns: whitened effects are estimates over their own scale, summed over runs."""
    rng = np.random.default_rng(2)
    designs = [np.column_stack([rng.standard_normal(50), rng.standard_normal(50), np.ones(50)]) for _ in range(2)]
    data = [rng.standard_normal((50, 3)) + d[:, :1] * [0.0, 1.0, 2.0] for d in designs]
    c = np.eye(3)[:2]
    fits = [glm.fit(layout.to_series(frame(spark, y)), d) for y, d in zip(data, designs, strict=True)]
    got = glm.f_statistic(glm.f_fixed_effects([glm.f_effects(f, c) for f in fits])).toPandas().set_index("voxel_id").sort_index()
    effects, variances = np.zeros((2, 3)), np.zeros(3)
    for y, d in zip(data, designs, strict=True):
        theta, rss = np.linalg.lstsq(d, y, rcond=None)[:2]
        lower = np.linalg.cholesky(np.linalg.inv(c @ np.linalg.inv(d.T @ d) @ c.T))
        effects += lower.T @ theta[:2]
        variances += rss / 47
    f = (effects**2).sum(0) / 2 / variances
    assert np.allclose(got.statistic, f) and (got.dof == 94).all() and np.allclose(got.variance, variances / 4)
    assert np.allclose(got.p, tails.f_sf(f, 2, 94)) and not np.allclose(got.statistic, glm.f_contrast(fits[0], c).toPandas().set_index("voxel_id").sort_index().statistic)
    one = glm.contrast(fits[0], [1.0, 0, 0])
    twice = glm.scaled(one, 2.0).toPandas().set_index("voxel_id").sort_index()
    plain = one.toPandas().set_index("voxel_id").sort_index()
    assert np.allclose(twice.effect, 2 * plain.effect) and np.allclose(twice.variance, 4 * plain.variance)
    with pytest.raises(ValueError):
        glm.contrast_map(one, "other")


def test_models_use_every_run_and_give_each_output(spark):
    rng = np.random.default_rng(3)
    times = np.arange(100) * 0.5
    events = pd.DataFrame({"onset": [5.0, 25], "duration": [2.0, 2.0], "trial_type": ["A", "B"], "modulation": [1.0, 1.0]})
    d = glm.first_level_design(times, events)
    runs = [np.column_stack([k * d["A"], 0 * d["A"]]) + rng.standard_normal((100, 2)) * 0.1 for k in (1, 3)]
    m = glm.FirstLevelModel(noise="ols").fit([layout.to_series(frame(spark, y)) for y in runs], [times] * 2, [events] * 2)
    columns = list(d.columns)
    f = np.eye(len(columns))[[columns.index("A"), columns.index("B")]]
    both, first = (x.toPandas().set_index("voxel_id").sort_index() for x in (m.contrast(f), glm.f_statistic(glm.f_effects(m.results[0], f))))
    assert (both.dof == 2 * first.dof).all() and both.statistic[0] > 2 * first.statistic[0]
    t, square = (m.contrast("A", kind=k).toPandas().set_index("voxel_id").sort_index() for k in ("t", "F"))
    assert t.effect[0] == pytest.approx(2, abs=0.2) and square.effects[0][0] > 0
    for output, name in glm.OUTPUTS.items():
        assert column(m.compute_contrast("A", output=output), "value") == pytest.approx(t[name].tolist())
    assert np.allclose(m.contrast("A", baseline=2.0).toPandas().set_index("voxel_id").sort_index().statistic, (t.effect - 2) / np.sqrt(t.variance))


def iq(spark, z):
    t, v = np.indices(z.shape)
    table = pd.DataFrame({"t_idx": t.ravel(), "voxel_id": v.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})
    return spark.createDataFrame(table).select("t_idx", "voxel_id", F.struct("re", "im").alias("value"))


def test_each_inner_window_has_its_volume(spark):
    z = np.random.default_rng(4).standard_normal((24, 2)) * (1 + 1j)
    w = windows.sliding_windows(iq(spark, z), 24, 12)
    got = windows.filtered_power_doppler(w, method=None, inner_width=4, inner_stride=4).toPandas().pivot(index="window_id", columns="voxel_id", values="value")
    times = spark.createDataFrame([(k, k * 1.0) for k in range(24)], "t_idx long, time double")
    assert got.index.tolist() == column(windows.window_timings(times, 24, 12, 12, 1.0, inner_width=4, inner_stride=4), "window_id", "window_id") == list(range(6))
    assert np.allclose(got.to_numpy(), [(np.abs(z[k : k + 4]) ** 2).mean(0) for k in range(0, 24, 4)])


@pytest.mark.parametrize("kernel", [3, (1, 3, 5), (1, 1, 2), 4])
def test_median_over_neighbours(spark, kernel):
    shape = (2, 4, 3)
    v = np.random.default_rng(5).standard_normal(shape)
    places = [(k, *map(int, c)) for k, c in enumerate(np.ndindex(shape))]
    grid = spark.createDataFrame(places, "voxel_id long, z_idx int, y_idx int, x_idx int")
    one = spark.createDataFrame([(7, k, float(x)) for k, x in enumerate(v.ravel())], "window_id int, voxel_id long, value double")
    sizes = windows.kernel_sizes(kernel, shape)
    wide = np.pad(v, [(s // 2,) * 2 for s in sizes])
    want = [float(np.median(wide[z : z + sizes[0], y : y + sizes[1], x : x + sizes[2]])) for z, y, x in np.ndindex(shape)]
    assert column(windows.median_filter(one, grid, kernel), "value") == pytest.approx(want)
    assert all(s % 2 for s in sizes)


def test_blocks_are_counted_through_gaps(spark, tmp_path):
    """Numbers 1, 5, 9 in two files, out of order, as one recording of three blocks."""
    def block(number):
        return np.array([number, 144, 6, 4, 3] + [0] * 5, "<i4").tobytes() + np.full((4, 6, 3), number + 0.5j, np.complex64).tobytes()

    (tmp_path / "bf_part_2.dat").write_bytes(block(9))
    (tmp_path / "bf part_1.dat").write_bytes(block(5) + block(1))
    (tmp_path / "bf_part_3.dat").write_bytes(b"")
    got = volumes.load_autc(spark, str(tmp_path)).groupBy("t_idx").agg(F.count("value").alias("n"), F.max("value.re").alias("re"), F.min("value.im").alias("im")).orderBy("t_idx").collect()
    assert [tuple(r) for r in got] == [(t, 24, re, 0.5) for t, re in enumerate([1] * 3 + [5] * 3 + [9] * 3)]


def test_complex_values_are_kept(spark, tmp_path):
    z = (np.arange(24).reshape(2, 1, 3, 4) + 1j * np.arange(24, 0, -1).reshape(2, 1, 3, 4)).astype(np.complex64)
    samples, _ = volumes.create_recording(spark, z)
    got = samples.orderBy("t_idx", "voxel_id").select("value.re", "value.im").collect()
    assert [complex(*r) for r in got] == z.ravel().tolist()
    (tmp_path / "a.nii").write_bytes(volumes.write_nifti(z))
    parts = volumes.load_nifti(spark, str(tmp_path), complex_as="parts").orderBy("t_idx", "z_idx", "y_idx", "x_idx").select("value.re", "value.im").collect()
    assert [complex(*r) for r in parts] == z.ravel().tolist()
    assert volumes.load_nifti(spark, str(tmp_path), complex_as="magnitude").agg(F.sum("value")).first()[0] == pytest.approx(np.abs(z).sum(), rel=1e-6)
    with pytest.raises(Exception, match="complex"):
        volumes.load_nifti(spark, str(tmp_path)).count()


def test_one_header_stands_before_all_blocks_of_a_file(spark, tmp_path):
    blocks = (np.arange(2 * 3 * 4 * 6).reshape(2, 3, 4, 1, 6) * (1 - 2j)).astype(np.complex64)  # block, volume, x, 1, z
    for padding in (0, 16):
        body = b"".join(b.tobytes() + b"\xff" * padding for b in blocks)
        (tmp_path / f"p{padding}.dat").write_bytes(np.array([1, 48, 2, 0, padding], "<u8").tobytes() + b"\0" * 8 + body)
        rows = volumes.load_echoframe(spark, str(tmp_path), 3, 4, 6, f"p{padding}.dat").orderBy("t_idx", "y_idx", "x_idx").select("t_idx", "z_idx", "value.re", "value.im").collect()
        want = blocks.reshape(6, 4, 6).transpose(0, 2, 1)
        assert [complex(r.re, r.im) for r in rows] == want.ravel().tolist() and rows[-1].t_idx == 5 and rows[-1].z_idx == 0
    (tmp_path / "short.dat").write_bytes(np.array([1, 40, 3, 0, 0], "<u8").tobytes() + blocks[0].tobytes())
    with pytest.raises(Exception, match="missing"):
        volumes.load_echoframe(spark, str(tmp_path), 3, 4, 6, "short.dat").count()


@pytest.mark.parametrize("few", [0, 40, 10**6])
def test_order_statistics_by_rounds(spark, few):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal(300) ** 5, np.full(200, 0.25), rng.integers(0, 3, 100)])
    df = maps(spark, [*x, float("nan"), float("inf")]).union(maps(spark, [None]))
    s = np.sort(x)
    assert layout.order_statistics(df, "z", [0, 17, 350, 599], few) == [s[k] for k in (0, 17, 350, 599)]
    for q in (0.0, 0.13, 0.5, 1.0):
        assert layout.exact_quantile(df, "z", q, few) == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert layout.exact_quantile(df.limit(0), "z", 0.5, few) is None
    with pytest.raises(ValueError):
        layout.order_statistics(df, "z", [600], few)


def test_spans_across_ranges(spark):
    groups = [str(k) for k in np.random.default_rng(7).integers(0, 2, 300)]
    groups[40:120], groups[200:205] = ["0"] * 80, [None] * 5
    df = spark.createDataFrame(list(enumerate(groups)), "t long, g string").repartition(7)
    want, begin = [], 0
    for k in range(1, 301):
        if k == 300 or groups[k] != groups[begin]:
            want.append((groups[begin], begin, k - 1, k - begin))
            begin = k
    from voxelweave.operators import masks

    got = [tuple(r) for r in masks.group_spans(df, "t", "g").orderBy("first").select("g", "first", "last", "n").collect()]
    assert got == want and masks.group_spans(df.limit(0), "t", "g").count() == 0


@pytest.mark.parametrize("kind", ["cubes", "copies", "tiny"])
def test_hommel_by_ranges(spark, kind):
    rng = np.random.default_rng(8)
    p = {"cubes": rng.uniform(0, 1, 700) ** 3, "copies": np.tile(np.round(rng.uniform(0, 1, 60), 2), 12), "tiny": 10.0 ** rng.uniform(-12, 0, 500)}[kind]
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "voxel_id long, p double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = thresholds.adjust_pvalues(df, "hommel").selectExpr("*", "spark_partition_id() AS part").toPandas().sort_values("voxel_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert np.allclose(got.p_adjusted, thresholds.hommel(p), rtol=1e-12, atol=0)
    assert got.part.nunique() > 1  # the map isn't one group


def test_clusters_across_tiles(spark):
    """A snake through all tiles, a loop around it, diagonal neighbours and both signs, with few rounds of joins."""
    z = np.zeros((23, 31))
    for y in range(0, 23, 4):
        z[y] = 1
        z[y + 1 : y + 4, 30 if y % 8 == 0 else 0] = 1
    z[2, 3:20], z[6, 5:7], z[10, 5], z[11, 6] = -1, -2, 3, 3
    y, x = np.indices(z.shape)
    df = spark.createDataFrame(pd.DataFrame({"z_idx": 0, "y_idx": y.ravel() - 9, "x_idx": x.ravel() - 11, "z": z.ravel()}))
    for edge in (4, 64):
        got = thresholds.cluster_filter(df, 3, edge=edge).toPandas()
        out = np.full_like(z, np.nan)
        out[got.y_idx + 9, got.x_idx + 11] = got.z
        want = z.copy()
        want[6, 5:7], want[10, 5] = 0, 0  # (11, 6) touches the snake
        assert len(got) == z.size and np.array_equal(out, want)


def test_cells_of_one_tile_are_labelled_by_a_task(spark, monkeypatch):
    df = spark.createDataFrame([(0, 0, x, 1.0) for x in range(60)], "z_idx int, y_idx int, x_idx int, z double")
    written, whole = [], layout.checkpointed

    def counted(rows):
        out = whole(rows)
        written.append(out.count())
        return out

    for module in (layout, thresholds):
        monkeypatch.setattr(module, "checkpointed", counted, raising=False)
    assert thresholds.cluster_filter(df, 60).filter("z = 1").count() == 60
    assert sum(written) <= 60  # no rows are written for links inside of tiles
