"""A recording as one object: its samples, coordinates and metadata, with the operators as methods.

Each method gives a new recording or a DataFrame; nothing runs until its rows are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import affine as affines, scale
from .operators import glm, layout, masks, quality_control, reductions, series, spatial, validate, windows
from .sources import files, volumes


@dataclass(frozen=True)
class Recording:
    """samples: voxel_id, t_idx, value and any index columns; coords: dim, idx, coord; meta: attributes by name."""

    samples: DataFrame
    coords: DataFrame | None = None
    meta: dict = field(default_factory=dict)

    @classmethod
    def create(cls, spark: SparkSession, data: np.ndarray, dt: float = 1.0, spacing=(1.0, 1.0, 1.0), origin=(0.0, 0.0, 0.0), **meta) -> Recording:
        return cls(*volumes.create_recording(spark, data, dt, spacing, origin), meta)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recording:
        samples, meta = volumes.load_recording(spark, path)
        return cls(samples, None, meta)

    def save(self, path: str, **how) -> None:
        """By suffix: .nii, .nii.gz, .zarr, or a Parquet recording."""
        files.save(self.samples, path, self.coords, self.meta, **how)

    def _with(self, samples: DataFrame) -> Recording:
        return replace(self, samples=samples)

    def validate(self, **rules) -> Recording:
        validate.validate_recording(self.coords, **rules)
        return self

    @property
    def spacing(self) -> dict[str, float | None]:
        return {r.dim: r.spacing for r in validate.spacings(self.coords).collect()}

    @property
    def origin(self) -> dict[str, float]:
        return {r.dim: r.origin for r in validate.spacings(self.coords).collect()}

    # selection and extraction

    def with_mask(self, mask: DataFrame) -> Recording:
        return self._with(masks.extract_with_mask(self.samples, mask))

    def unmask(self, grid: DataFrame, fill: float = 0.0) -> Recording:
        return self._with(masks.unmask(self.samples, grid, fill))

    def with_labels(self, labels: DataFrame, reduction: str = "mean") -> DataFrame:
        return reductions.extract_with_labels(self.samples, labels, reduction)

    def censor(self, sample_mask: DataFrame) -> Recording:
        return self._with(series.censor_samples(self.samples, sample_mask))

    # values

    def db(self, factor: float = 10.0) -> Recording:
        return self._with(scale.db_scale(self.samples, factor=factor, out="value"))

    def log(self) -> Recording:
        return self._with(self.samples.withColumn("value", scale.log_scale(F.col("value"))))

    def power(self, exponent: float = 0.5) -> Recording:
        return self._with(self.samples.withColumn("value", scale.power_scale(F.col("value"), exponent)))

    def detrend(self, order: int = 1) -> Recording:
        return self._with(series.detrend(self.samples, order))

    def standardize(self, method: str = "zscore") -> Recording:
        return self._with(series.standardize(self.samples, method))

    # quality and connectivity

    def tsnr(self) -> DataFrame:
        return reductions.compute_tsnr(self.samples)

    def cv(self) -> DataFrame:
        return reductions.compute_cv(self.samples)

    def dvars(self, **options) -> DataFrame:
        return reductions.compute_dvars(self.samples, **options)

    def seed_map(self, seed_masks: DataFrame, reduction: str = "mean", mask: DataFrame | None = None) -> DataFrame:
        return reductions.seed_based_maps(self.samples, seed_masks, reduction, mask)

    # complex samples

    def _length(self) -> int:
        return self.samples.agg(F.max("t_idx")).first()[0] + 1

    def power_doppler(self, width: int, stride: int | None = None, method: str | None = None, **options) -> Recording:
        w = windows.sliding_windows(self.samples, self._length(), width, stride)
        out = windows.power_doppler(w) if method is None else windows.filtered_power_doppler(w, method, **options)
        return self._with(out.withColumnRenamed("window_id", "t_idx"))

    def bmode(self, width: int, stride: int | None = None) -> Recording:
        out = windows.bmode(windows.sliding_windows(self.samples, self._length(), width, stride))
        return self._with(out.withColumnRenamed("window_id", "t_idx"))

    def axial_velocity(self, width: int, stride: int | None, rate: float, lag: int = 1, kernel: int | tuple[int, int, int] = 3) -> Recording:
        validate.validate_iq(self.samples, self.meta, velocity=True)
        w = windows.sliding_windows(self.samples, self._length(), width, stride)
        out = windows.axial_velocity(w, rate, self.meta["transmit_frequency"], lag, self.meta["sound_velocity"], grid=self.samples.select("voxel_id", "z_idx", "y_idx", "x_idx").distinct(), kernel=kernel)
        return self._with(out.withColumnRenamed("window_id", "t_idx"))

    # space and models

    def affine_to(self, other: Recording, via: str) -> np.ndarray:
        return affines.relative(np.asarray(self.meta["affines"][via]), np.asarray(other.meta["affines"][via]))

    def register_volumewise(self, shape: tuple[int, int, int], **options) -> DataFrame:
        return spatial.register_volumewise(self.samples, shape, **options)

    def register_to(self, fixed: np.ndarray, spacing=(1.0, 1.0, 1.0), frame: int = 0, **options) -> tuple[np.ndarray, dict]:
        """The affine from points of a fixed volume to those of one of this recording's frames, and how it was found."""
        moving = spatial.volume_of(self.samples.filter(F.col("t_idx") == frame).toPandas(), fixed.shape)  # one frame
        return spatial.register(moving, fixed, spacing, **options)

    def quality(self, **wanted) -> dict[str, DataFrame]:
        return quality_control.metrics(self.samples, **wanted)

    def carpet(self, **options) -> tuple[DataFrame, tuple[float, float]]:
        return quality_control.carpet(self.samples, **options)

    def series(self) -> DataFrame:
        return layout.to_series(self.samples)

    def fit(self, design, noise: str = "ar1") -> DataFrame:
        return glm.fit(self.series(), design, noise)
