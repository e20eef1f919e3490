"""One-row-per-unit features of a 1-D signal: bounds, statistics, moments, packet counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions.scaling import minmax
from motefield.operators.filters import sign_changes, zero_crossing_rate
from motefield.operators.spectral import FFT_ROWS, ordered_values, spectral_features, spectral_struct
from motefield.ranking import QUANTILE_ROWS, percentiles, spread_percentiles, summarise
from motefield.runtime import lookup_join
from motefield.series import SeriesLayout

# The scalar features of a unit, in model order.
UNIT_FEATURES = [
    "mean", "std", "median", "skew", "kurtosis", "spectral_centroid", "spectral_spread", "spectral_entropy",
    "dominant_freq", "spectral_rolloff_85", "min", "max", "q25", "q75", "iqr", "range", "rms", "energy", "zcr",
]


def train_bounds(train: DataFrame, value: str, by: list[str]) -> DataFrame:
    return train.groupBy(*by).agg(F.min(value).alias("global_min"), F.max(value).alias("global_max"))


def scale_by_bounds(df: DataFrame, value: str, bounds: DataFrame, by: list[str]) -> DataFrame:
    """Min-max scale with the bounds of the row's ``by`` key (one pair for all when empty)."""
    if by:
        joined = lookup_join(df, bounds, by)
        low, high = F.col("global_min"), F.col("global_max")
    else:
        one = bounds.first()
        joined, low, high = df, F.lit(one["global_min"]), F.lit(one["global_max"])
    return joined.withColumn(value, minmax(F.col(value), low, high)).drop("global_min", "global_max")


SHARES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _statistics(x: Column, moments: bool) -> list[Column]:
    aggs = [
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.sum(x * x).alias("energy"),
    ]
    if moments:
        aggs += [
            F.coalesce(F.skewness(x), F.lit(0.0)).alias("skew"),
            F.coalesce(F.kurtosis(x), F.lit(0.0)).alias("kurtosis"),
        ]
    return aggs


def _with_ranges(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"iqr": F.col("q75") - F.col("q25"), "range": F.col("max") - F.col("min")})


def unit_statistics(df: DataFrame, value: str, layout: SeriesLayout, moments: bool = True) -> DataFrame:
    aggs = _statistics(F.col(value), moments)
    return _with_ranges(summarise(df, list(layout.keys), aggs, value, SHARES, layout.longest))


def packet_summary(df: DataFrame, layout: SeriesLayout, rssi: str = "rssi") -> DataFrame:
    return summarise(
        df, list(layout.keys), [F.count("*").alias("n_packets")], rssi, {"rssi_median": 0.5}, layout.longest
    )


def unit_features(df: DataFrame, value: str, layout: SeriesLayout) -> DataFrame:
    """All scalar features of the scaled signal, one row per unit.

    Short units are described by one aggregation on the partitioning their windows use; the
    spectrum takes the collected values of a unit. When some unit is long, each part is
    computed in its spread-out form and the one-row-per-unit results are joined.
    """
    keys = list(layout.keys)
    if layout.blocked or layout.longest > min(QUANTILE_ROWS, FFT_ROWS):
        stats = unit_statistics(df, value, layout)
        crossings = zero_crossing_rate(df, value, layout, "zcr")
        spectrum = spectral_features(df, value, layout)
        return stats.join(crossings, keys).join(spectrum, keys).select(*keys, *UNIT_FEATURES)
    rows = sign_changes(df, value, layout, "_flip")
    packed = rows.groupBy(*keys).agg(
        *_statistics(F.col(value), True),
        percentiles(value, SHARES),
        F.avg("_flip").alias("zcr"),
        ordered_values(value, layout).alias("_x"),
    )
    described = _with_ranges(spread_percentiles(packed, SHARES)).withColumn("_s", spectral_struct("_x"))
    return described.select("*", "_s.*").select(*keys, *UNIT_FEATURES)
