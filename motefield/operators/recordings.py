"""Recording-level operators: silent subcarriers, device scale, windows of a binary task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.labels import binary_class, binary_name, distance
from motefield.operators.packets import align_devices, first_rows, segment_rows
from motefield.ranking import summarise
from motefield.series import SeriesLayout


def null_subcarriers(samples: DataFrame, recordings: DataFrame, per_label: int = 4, share: float = 0.99) -> DataFrame:
    """Subcarriers that are zero in nearly all packets of the first recordings of each label."""
    heads = first_rows(recordings, "label", "recording_id", per_label)
    seen = samples.join(heads.select("recording_id"), "recording_id", "left_semi")
    zero = (F.abs(F.col("x")) <= 1e-8).cast("int")
    return seen.groupBy("sc").agg(F.avg(zero).alias("zero_share")).filter(F.col("zero_share") >= share)


def drop_subcarriers(samples: DataFrame, nulls: DataFrame) -> DataFrame:
    """Remove the listed subcarriers and number the remaining ones from zero.

    The list is no longer than one packet has subcarriers.
    """
    listed = sorted(r[0] for r in nulls.select("sc").distinct().collect())
    kept = samples.filter(~F.col("sc").isin(listed)) if listed else samples
    below: Column = F.lit(0)
    for s in listed:
        below = below + F.when(F.col("sc") > s, 1).otherwise(0)
    return kept.withColumn("sc", F.col("sc") - below)


def binary_windows(
    packets: DataFrame, layout: SeriesLayout, devices: list[str], width: int, step: int
) -> DataFrame:
    """Aligned packets assigned to windows, with class and distance of the recording."""
    aligned = align_devices(packets, "recording_id", devices, layout)
    cut = segment_rows(aligned, layout, width, step)
    return cut.withColumns(
        {
            "binary_label": binary_class(F.col("label")),
            "binary_name": binary_name(binary_class(F.col("label"))),
            "distance_m": distance(F.col("label")),
        }
    )


def window_metadata(windows: DataFrame) -> DataFrame:
    """One row per window with its labels and sizes."""
    return windows.groupBy(
        "recording_id", "segment", "person_id", "label", "binary_label", "binary_name", "distance_m"
    ).agg(
        F.countDistinct("seg_t").alias("n_packets"), F.countDistinct("device").alias("n_devices"),
        F.max(F.floor(F.size("iq") / 2)).alias("n_subcarriers"),
    )


def device_scale(samples: DataFrame, packets: DataFrame, by: list[str], largest: int | None = None) -> DataFrame:
    """Level and change of amplitude and RSSI per class and receiver.

    ``samples`` must hold ``x`` and the change ``dx`` inside a window (NULL on its first row).
    """
    level = summarise(
        samples, by, [F.avg("x").alias("amp_mean"), F.stddev_pop("x").alias("amp_std")], "x",
        {"amp_p10": 0.1, "amp_p90": 0.9}, largest,
    )
    moves = samples.filter("dx is not null").withColumn("_a", F.abs(F.col("dx")))
    change = summarise(moves, by, [F.avg("_a").alias("abs_dt_mean")], "_a", {"abs_dt_p90": 0.9}, largest)
    rssi = packets.groupBy(*by).agg(F.avg("rssi").alias("rssi_mean"), F.stddev_pop("rssi").alias("rssi_std"))
    return level.join(change, by).join(rssi, by)


def device_scale_pivot(scale: DataFrame) -> DataFrame:
    """Class columns per receiver with their ratio, for RSSI their difference."""
    flat = scale.select(
        "device",
        "binary_name",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                    for m in ("amp_mean", "abs_dt_mean", "rssi_mean")
                ]
            )
        ).alias("_e"),
    ).select("device", "binary_name", "_e.*")
    table = flat.groupBy("metric", "device").pivot("binary_name", ["no_motion", "motion"]).agg(F.first("value"))
    quiet = F.when(F.col("no_motion") != 0, F.col("no_motion"))
    return table.withColumn(
        "compared",
        F.when(F.col("metric") == "rssi_mean", F.col("motion") - F.col("no_motion")).otherwise(F.col("motion") / quiet),
    )


def distance_subset(windows: DataFrame) -> DataFrame:
    """Rows with movement; the distance becomes the target."""
    return windows.filter(F.col("distance_m") > 0).withColumn("y_distance", F.col("distance_m"))


def with_change(samples: DataFrame, series: list[str], order: str, value: str = "x", out: str = "dx") -> DataFrame:
    along = Window.partitionBy(*series).orderBy(order)
    return samples.withColumn(out, F.col(value) - F.lag(value).over(along))
