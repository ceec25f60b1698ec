"""The fluent surface."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelweave.recording import Recording


def test_recording(spark, tmp_path):
    data = np.random.default_rng(0).standard_normal((12, 1, 2, 3)) + 10
    r = Recording.create(spark, data, 0.5, (1.0, 0.2, 0.1), affines={"lab": np.eye(4).tolist()}).validate(require_time=True)
    assert r.spacing["x"] == pytest.approx(0.1) and r.spacing["time"] == pytest.approx(0.5) and r.origin["y"] == 0.0
    got = r.tsnr().toPandas().set_index("voxel_id").tsnr.sort_index().to_numpy()
    flat = data.reshape(12, -1)
    assert np.allclose(got, flat.mean(0) / flat.std(0))
    z = r.detrend().standardize().samples.toPandas()
    assert abs(z.groupby("voxel_id").value.mean()).max() < 1e-9
    assert r.db().samples.agg(F.max("value")).first()[0] == 0.0 and r.power(2).log().samples.count() == 72
    labels = spark.createDataFrame([(v, v % 2 + 1) for v in range(6)], "voxel_id long, region int")
    assert r.with_labels(labels).count() == 24 and r.seed_map(labels).count() == 12 and r.dvars().count() == 12 and r.cv().count() == 6
    r.save(str(tmp_path / "rec"))
    assert Recording.load(spark, str(tmp_path / "rec")).samples.count() == 72
    assert np.allclose(r.affine_to(r, "lab"), np.eye(4)) and r.fit(np.ones((12, 1)), "ols").count() == 6
    iq = Recording(r.samples.withColumn("value", F.struct(F.col("value").alias("re"), F.lit(0.0).alias("im"))), r.coords, {"transmit_frequency": 15e6, "sound_velocity": 1540.0})
    p = iq.power_doppler(6, 3).samples
    assert p.count() == 18 and iq.bmode(6).samples.count() == 12 and iq.axial_velocity(6, 6, 500.0).samples.agg(F.max(F.abs("value"))).first()[0] == 0.0
    assert iq.power_doppler(6, 3, "svd_indices").samples.count() == 18
