"""Robust scaling of series and the configurable amplitude pipeline."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.scaling import clip
from motefield.operators import filters
from motefield.ranking import quantiles, summarise
from motefield.series import SeriesLayout, attach_table, close_blocks, open_blocks

PIPELINES = ("none", "raw", "median", "hampel_savgol")


@dataclass(frozen=True)
class PreprocessConfig:
    pipeline: str = "hampel_savgol"
    apply_detrend: bool = False
    apply_zscore: bool = False
    hampel_window: int = 7
    hampel_sigma: float = 3.0
    sg_window: int = 11
    sg_poly: int = 3
    median_window: int = 7
    detrend_window: int = 51
    scale_floor_percentile: float = 10.0
    z_clip: float | None = 8.0

    def __post_init__(self) -> None:
        if self.pipeline not in PIPELINES:
            raise ValueError(f"unknown pipeline {self.pipeline!r}, use one of {PIPELINES}")

    def but(self, **changes) -> "PreprocessConfig":
        return replace(self, **changes)

    @classmethod
    def single_receiver(cls, pipeline: str, **changes) -> "PreprocessConfig":
        """Settings of the one-receiver format: detrended and scaled unless nothing is done at all.

        An even median window is raised to the next odd one.
        """
        full = pipeline not in ("none", "raw")
        made = cls(pipeline, apply_detrend=full, apply_zscore=full, **changes)
        return made.but(median_window=made.median_window | 1)

    @property
    def reach(self) -> int:
        """How many rows a result depends on to each side."""
        smooth = {
            "median": max(self.median_window, 3) // 2,
            "hampel_savgol": 2 * (max(self.hampel_window, 3) // 2) + self.sg_window // 2,
        }.get(self.pipeline, 0)
        return smooth + (self.detrend_window if self.apply_detrend else 0)


def robust_zscore(
    df: DataFrame,
    value: str,
    layout: SeriesLayout,
    recording: list[str],
    out: str,
    floor_percentile: float = 10.0,
    z_clip: float | None = 8.0,
) -> DataFrame:
    """(x - median) / scale per series, scale = 1.4826 * MAD.

    The scale is kept above the given percentile of the positive scales of the recording
    (above 1e-6, or 1 when no series varies). Adds ``norm_median``, ``norm_scale`` and
    ``scale_floor``.
    """
    keys = list(layout.keys)
    spread = F.abs(F.col(value) - F.col("norm_median"))
    scale = F.col("_mad") * filters.MAD_TO_SIGMA
    positive = F.when(scale > 0, scale)
    floor = F.when(F.count(positive) == 0, 1.0).otherwise(
        F.greatest(F.percentile(positive, F.lit(floor_percentile / 100)), F.lit(1e-6))
    )
    if layout.blocked:
        centre = quantiles(df, keys, value, {"norm_median": 0.5}, layout.longest)
        away = attach_table(df, layout, centre).withColumn("_away", spread)
        mads = quantiles(away, keys, "_away", {"_mad": 0.5}, layout.longest)
        series = centre.join(mads, keys)
        floors = series.groupBy(*recording).agg(floor.alias("scale_floor"))
        rows = attach_table(df, layout, series.join(floors, recording))
    else:
        whole = Window.partitionBy(*keys)
        rows = df.withColumn("norm_median", F.percentile(value, F.lit(0.5)).over(whole))
        rows = rows.withColumn("_mad", F.percentile(spread, F.lit(0.5)).over(whole))
        if layout.recording_fits:
            # Every series speaks once, by its first row; no second pass and no join.
            rows = rows.withColumn("_first", F.min(layout.order).over(whole))
            once = F.when((scale > 0) & (F.col(layout.order) == F.col("_first")), scale)
            per_recording = Window.partitionBy(*recording)
            low = F.percentile(once, F.lit(floor_percentile / 100)).over(per_recording)
            rows = rows.withColumn("scale_floor", F.coalesce(F.when(low.isNotNull(), F.greatest(low, F.lit(1e-6))), F.lit(1.0)))
        else:
            series = rows.groupBy(*keys).agg(F.first("_mad").alias("_mad"))
            floors = series.groupBy(*recording).agg(floor.alias("scale_floor"))
            rows = rows.join(floors, recording)
    rows = rows.withColumn("norm_scale", F.greatest(scale, F.col("scale_floor"))).drop("_mad", "_first")
    z = (F.col(value) - F.col("norm_median")) / F.col("norm_scale")
    if z_clip is not None:
        z = clip(z, F.lit(-float(z_clip)), F.lit(float(z_clip)))
    return rows.withColumn(out, z)


def preprocess_amplitude(
    df: DataFrame, value: str, layout: SeriesLayout, recording: list[str], config: PreprocessConfig
) -> DataFrame:
    """Smooth, detrend and normalise; every intermediate result stays as a column.

    Adds ``hampel`` or ``median_filtered`` (by pipeline), ``smoothed``, ``trend``,
    ``detrended``, ``normalized``, ``norm_median``, ``norm_scale`` and ``scale_floor``.
    """
    # One partitioning by recording serves every step when recordings are small.
    rows = df.repartition(*recording) if config.apply_zscore and layout.recording_fits else df
    if config.reach:
        rows = filters.with_length(open_blocks(rows, layout, config.reach), layout)
    if config.pipeline == "median":
        rows = filters.median_columns(rows, value, layout, config.median_window, "median_filtered")
        rows = rows.withColumn("smoothed", F.col("median_filtered"))
    elif config.pipeline == "hampel_savgol":
        rows = filters.hampel_columns(rows, value, layout, config.hampel_window, config.hampel_sigma, "hampel")
        rows = filters.savgol_columns(rows, "hampel", layout, config.sg_window, config.sg_poly, "smoothed")
    else:
        rows = rows.withColumn("smoothed", F.col(value))
    if config.apply_detrend:
        rows = filters.trend_columns(rows, "smoothed", layout, config.detrend_window, "trend")
    else:
        rows = rows.withColumn("trend", F.lit(0.0))
    if config.reach:
        rows = close_blocks(rows, layout).drop(filters.LENGTH)
    rows = rows.withColumn("detrended", F.col("smoothed") - F.col("trend"))
    if config.apply_zscore:
        return robust_zscore(
            rows, "detrended", layout, recording, "normalized", config.scale_floor_percentile, config.z_clip
        )
    return rows.withColumns(
        {
            "normalized": F.col("detrended"),
            "norm_median": F.lit(0.0),
            "norm_scale": F.lit(1.0),
            "scale_floor": F.lit(1.0),
        }
    )


def preprocess_diagnostics(rows: DataFrame, layout: SeriesLayout, recording: list[str]) -> DataFrame:
    """Range of the normalised values and percentiles of the series scales, per recording."""
    series = rows.groupBy(*layout.keys).agg(
        F.min("normalized").alias("_min"),
        F.max("normalized").alias("_max"),
        F.first("norm_scale").alias("_scale"),
        F.first("scale_floor").alias("_floor"),
    )
    shares = {"scale_p0": 0.0, "scale_p10": 0.1, "scale_p50": 0.5, "scale_p90": 0.9}
    aggs = [
        F.min("_min").alias("norm_min"),
        F.max("_max").alias("norm_max"),
        F.first("_floor").alias("scale_floor"),
    ]
    return summarise(series, recording, aggs, "_scale", shares)


def robust_limits(df: DataFrame, value: str, keys: list[str], q: float = 99.0, centred: bool = False) -> DataFrame:
    """Value limits for display: percentiles (100-q, q), or +-percentile of |x| when centred.

    The first kind is NULL when both coincide.
    """
    finite = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    finite = finite.filter(F.abs(F.col(value)) < float("inf"))
    if centred:
        top = quantiles(finite.withColumn("_a", F.abs(F.col(value))), keys, "_a", {"_q": q / 100})
        limit = F.greatest(F.col("_q"), F.lit(1e-6))
        return top.select(*keys, (-limit).alias("low"), limit.alias("high"))
    both = quantiles(finite, keys, value, {"_l": 1 - q / 100, "_h": q / 100})
    usable = F.col("_h") > F.col("_l")
    return both.select(*keys, F.when(usable, F.col("_l")).alias("low"), F.when(usable, F.col("_h")).alias("high"))
