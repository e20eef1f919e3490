"""Filters along time. Every filter maps a frame with ``keys, t, value`` to the same rows.

``layout`` says how series are spread (see :mod:`motefield.series`). The ``*_columns``
helpers work on an opened frame, so a chain of filters needs one exchange only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.series import SeriesLayout, attach_stats, close_blocks, open_blocks

MAD_TO_SIGMA = 1.4826
LENGTH = "_n"


def check_odd(width: int) -> int:
    if isinstance(width, bool) or not isinstance(width, int):
        raise TypeError("window size must be an integer")
    if width < 1 or width % 2 == 0:
        raise ValueError("window size must be odd and at least 1")
    return width


def edge_padded(value: str, layout: SeriesLayout, half: int) -> Column:
    """The ``2*half+1`` values around each row; beyond the ends the end value repeats.

    A missing neighbour means that the series ends there, and then the end lies in the same
    block. Offsets cost a fraction of what collecting a frame for every row does.
    """
    w = layout.window()
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = [F.coalesce(F.lag(value, k).over(w), first) for k in range(half, 0, -1)]
    after = [F.coalesce(F.lead(value, k).over(w), last) for k in range(1, half + 1)]
    return F.array(*before, F.col(value), *after)


def with_length(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    return attach_stats(df, layout, **{LENGTH: F.count(F.lit(1))})


def fitting_odd_window(n: Column, width: int, least: int = 3) -> Column:
    """Odd window that fits a series of length ``n``, at least ``least``; 1 when n <= 1."""
    room = n - F.when(n % 2 == 0, 1).otherwise(0)
    asked = F.lit(width if width % 2 else width - 1)
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(least), F.least(asked, room))).cast("int")


def fitting_savgol_window(n: Column, width: int, degree: int) -> Column:
    """Odd window for a polynomial of ``degree``; NULL when the series is too short."""
    least = degree + 2 + (degree + 2 + 1) % 2
    room = n - F.when(n % 2 == 0, 1).otherwise(0)
    fit = F.least(F.lit(width if width % 2 else width - 1), room)
    return F.when((n > degree + 1) & (fit >= least), fit).cast("int")


def savgol_weights(width: int, degree: int) -> list[float]:
    """Weights of the least-squares polynomial evaluated at the window centre."""
    offsets = np.arange(width) - width // 2
    basis = np.vander(offsets, degree + 1, increasing=True).astype(float)
    return [float(c) for c in np.linalg.pinv(basis)[0]]


def _middle(padded: Column, half: int) -> Column:
    return F.element_at(F.sort_array(padded), half + 1)


def _middle_of(padded: Column, half: int, own_half: Column) -> Column:
    """Median of the central ``2*own_half+1`` entries of a wider stencil."""
    inner = F.slice(padded, F.lit(half + 1) - own_half, own_half * 2 + 1)
    return F.element_at(F.sort_array(inner), own_half + 1)


def _fitting_median(df: DataFrame, value: str, out: str, layout: SeriesLayout, width: int) -> DataFrame:
    half = max(width, 3) // 2
    own_half = F.floor(fitting_odd_window(F.col(LENGTH), width) / 2).cast("int")
    return (
        df.withColumn("_pad", edge_padded(value, layout, half))
        .withColumn(
            out,
            F.when(own_half == half, _middle(F.col("_pad"), half)).otherwise(
                _middle_of(F.col("_pad"), half, own_half)
            ),
        )
        .drop("_pad")
    )


def moving_average(df: DataFrame, value: str, layout: SeriesLayout, width: int, out: str) -> DataFrame:
    """Sum over the window divided by its full width: values beyond the ends count as zero."""
    half = check_odd(width) // 2
    opened = open_blocks(df, layout, half)
    frame = layout.window().rowsBetween(-half, half)
    return close_blocks(opened.withColumn(out, F.sum(value).over(frame) / width), layout)


def median_filter(df: DataFrame, value: str, layout: SeriesLayout, width: int, out: str) -> DataFrame:
    """Rolling median of fixed width; the end values repeat beyond the ends."""
    half = check_odd(width) // 2
    opened = open_blocks(df, layout, half)
    return close_blocks(opened.withColumn(out, _middle(edge_padded(value, layout, half), half)), layout)


def median_columns(df, value, layout, width, out):
    """Rolling median whose width shrinks to fit short series."""
    return _fitting_median(df, value, out, layout, width)


def hampel_columns(df, value, layout, width, sigma, out):
    """Replace a value by the rolling median when it is further than ``sigma`` scaled MADs away."""
    step = _fitting_median(df, value, "_med", layout, width)
    step = step.withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    step = _fitting_median(step, "_dev", "_mad", layout, width)
    limit = F.lit(sigma) * MAD_TO_SIGMA * (F.col("_mad") + 1e-8)
    return step.withColumn(
        out, F.when(F.col("_dev") > limit, F.col("_med")).otherwise(F.col(value))
    ).drop("_med", "_dev", "_mad")


def savgol_columns(df, value, layout, width, degree, out):
    """Local polynomial smoothing; series too short for the polynomial stay as they are."""
    half = width // 2
    fit = fitting_savgol_window(F.col(LENGTH), width, degree)
    smoothed = F.col(value)
    for w in range(3, 2 * half + 2, 2):
        if w < degree + 2:
            continue
        terms = [
            F.element_at(F.col("_pad"), half - w // 2 + i + 1) * c
            for i, c in enumerate(savgol_weights(w, degree))
        ]
        smoothed = F.when(fit == w, sum(terms[1:], terms[0])).otherwise(smoothed)
    return (
        df.withColumn("_pad", edge_padded(value, layout, half)).withColumn(out, smoothed).drop("_pad")
    )


def trend_columns(df, value, layout, width, out):
    """Rolling mean over min(width, n) rows with repeated end values.

    An even window of size s reaches s/2 rows back and s/2-1 rows ahead.
    """
    n, x, t = F.col(LENGTH), F.col(value), F.col(layout.order)
    back, ahead = width // 2, width - width // 2 - 1
    frame = layout.window().rowsBetween(-back, ahead)
    behind_gap = F.greatest(F.lit(back) - t, F.lit(0))
    ahead_gap = F.lit(width) - behind_gap - F.count(F.lit(1)).over(frame)
    full = (
        F.sum(x).over(frame) + behind_gap * F.first(x).over(frame) + ahead_gap * F.last(x).over(frame)
    ) / width
    # Series shorter than the window: fewer than ``width`` values, all in one block.
    every = layout.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.collect_list(F.when(n < width, x)).over(every)
    own_back = F.floor(n / 2).cast("int")
    own_ahead = (n - own_back - 1).cast("int")
    place = t.cast("int")
    low = F.greatest(place - own_back, F.lit(0))
    high = F.least(place + own_ahead, (n - 1).cast("int"))
    part = F.aggregate(F.slice("_all", low + 1, high - low + 1), F.lit(0.0), lambda a, v: a + v)
    short = (
        part
        + F.greatest(own_back - place, F.lit(0)) * F.get("_all", F.lit(0))
        + F.greatest(place + own_ahead - (n - 1), F.lit(0)) * F.get("_all", (n - 1).cast("int"))
    ) / n
    return (
        df.withColumns({"_full": full, "_all": whole})
        .withColumn(out, F.when(n < width, short).otherwise(F.col("_full")))
        .drop("_full", "_all")
    )


def _one_filter(df, layout, reach, columns) -> DataFrame:
    opened = with_length(open_blocks(df, layout, reach), layout)
    return close_blocks(columns(opened), layout).drop(LENGTH)


def median_filter_fitting(df, value, layout, width, out) -> DataFrame:
    return _one_filter(df, layout, max(width, 3) // 2, lambda d: median_columns(d, value, layout, width, out))


def hampel_filter(df, value, layout, out, width=7, sigma=3.0) -> DataFrame:
    return _one_filter(
        df, layout, 2 * (max(width, 3) // 2), lambda d: hampel_columns(d, value, layout, width, sigma, out)
    )


def savgol_filter(df, value, layout, out, width=11, degree=3) -> DataFrame:
    return _one_filter(df, layout, width // 2, lambda d: savgol_columns(d, value, layout, width, degree, out))


def detrend(df, value, layout, trend, out, width=51) -> DataFrame:
    """Add the rolling-mean trend and the value without it."""
    done = _one_filter(df, layout, width, lambda d: trend_columns(d, value, layout, width, trend))
    return done.withColumn(out, F.col(value) - F.col(trend))


def time_diff(df, value, layout, out) -> DataFrame:
    """Difference to the previous row; the first row of a series has none and is dropped."""
    opened = open_blocks(df, layout, 1)
    change = F.col(value) - F.lag(value).over(layout.window())
    return close_blocks(opened.withColumn(out, change), layout).filter(F.col(layout.order) > 0)


def sign_changes(df, value, layout, out) -> DataFrame:
    """1 where the sign of the value minus its series mean differs from the row before, else 0.

    NULL on the first row of a series.
    """
    opened = attach_stats(open_blocks(df, layout, 1), layout, _mean=F.avg(value))
    signed = opened.withColumn("_neg", F.col(value) < F.col("_mean"))
    flips = signed.withColumn(out, (F.col("_neg") != F.lag("_neg").over(layout.window())).cast("int"))
    kept = close_blocks(flips, layout).drop("_mean", "_neg")
    return kept.withColumn(out, F.when(F.col(layout.order) > 0, F.col(out)))


def zero_crossing_rate(df, value, layout, out) -> DataFrame:
    """Share of steps at which the sign of the value minus its series mean changes."""
    return sign_changes(df, value, layout, "_flip").groupBy(*layout.keys).agg(F.avg("_flip").alias(out))
