"""Packet frames: per-packet signal, acceptance of units, alignment of receivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.functions.iq import iq_amplitude
from motefield.operators.filters import median_filter
from motefield.series import SeriesLayout, attach_stats, close_blocks, open_blocks


def mean_amplitude(amplitude) -> F.Column:
    return F.aggregate(amplitude, F.lit(0.0), lambda a, v: a + v) / F.size(amplitude)


def unit_signal(frames: DataFrame, layout: SeriesLayout, width: int) -> DataFrame:
    """Mean amplitude of each packet, median filtered along the unit."""
    means = frames.withColumn("x", mean_amplitude(iq_amplitude(F.col("iq")))).drop("iq")
    return median_filter(means, "x", layout, width, "x")


def align_devices(frames: DataFrame, recording: str, devices: list[str], layout: SeriesLayout) -> DataFrame:
    """Keep the packets every receiver has, paired by position.

    A recording is cut to its shortest receiver; without one of ``devices`` nothing is left.
    """
    by_recording = layout.with_keys(recording)
    opened = open_blocks(frames.filter(F.col("device").isin(devices)), by_recording, 0)
    counts = {f"_n_{d}": F.count_if(F.col("device") == d) for d in devices}
    sized = attach_stats(opened, by_recording, **counts)
    shortest = F.least(*[F.col(c) for c in counts]) if len(devices) > 1 else F.col(next(iter(counts)))
    return close_blocks(sized.filter(F.col(layout.order) < shortest).drop(*counts), by_recording)


def wide_by_device(frames: DataFrame, keys: list[str], devices: list[str], values: list[str]) -> DataFrame:
    """One row per packet position with one column per receiver and value."""
    picked = [
        F.max(F.when(F.col("device") == d, F.col(v))).alias(f"{v}_{d}") for v in values for d in devices
    ]
    return frames.groupBy(*keys).agg(*picked)


def rejected_units(packets: DataFrame, unit: str, cell: str = "csi_data") -> DataFrame:
    """Units that cannot be used, with the reason.

    ``iq`` must hold the parsed cell (NULL when not a list, NULL entries when not integers).
    """
    size = F.size("iq")
    bad = F.col("iq").isNull() | F.exists("iq", lambda v: v.isNull())
    odd = ~bad & (size % 2 == 1)
    good = F.when(~bad & ~odd, size)
    seen = packets.groupBy(unit).agg(
        F.max(bad.cast("int")).alias("bad"),
        F.max(odd.cast("int")).alias("odd"),
        F.min(good).alias("low"),
        F.max(good).alias("high"),
    )
    reason = (
        F.when(F.col("bad") == 1, "invalid csi_data")
        .when(F.col("odd") == 1, "odd csi_data length")
        .when(F.col("low") != F.col("high"), "inconsistent subcarrier count")
    )
    return seen.select(unit, reason.alias("reason")).filter("reason is not null")


def accepted_packets(packets: DataFrame, unit: str) -> DataFrame:
    return packets.join(rejected_units(packets, unit), unit, "left_anti")


def segment_rows(
    df: DataFrame, layout: SeriesLayout, width: int, step: int, length: str | None = None
) -> DataFrame:
    """Assign rows to windows of ``width`` rows starting every ``step`` rows.

    Incomplete windows at the end are dropped. Adds ``segment`` and ``seg_t``, the position in
    the window. ``length`` names a column with the series length when it is known already.
    """
    if length is None:
        opened = attach_stats(open_blocks(df, layout, 0), layout, _n=F.count(F.lit(1)))
        df, length = close_blocks(opened, layout), "_n"
    t = F.col(layout.order)
    first = F.greatest(F.lit(0), F.ceil((t - width + 1) / step)).cast("long")
    last = F.least(F.floor(t / step), F.floor((F.col(length) - width) / step)).cast("long")
    cut = df.withColumns({"_first": first, "_last": last}).filter(F.col("_first") <= F.col("_last"))
    out = cut.withColumn("segment", F.explode(F.sequence("_first", "_last")))
    return out.withColumn("seg_t", t - F.col("segment") * step).drop("_first", "_last", "_n")


def first_rows(df: DataFrame, by: str, order: str, count: int) -> DataFrame:
    """First ``count`` distinct values of ``order`` in each ``by`` group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    heads = df.select(by, order).distinct().withColumn("_rank", rank).filter(F.col("_rank") <= count)
    return heads.drop("_rank")
