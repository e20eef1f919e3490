"""Filters against numpy, in the plain and in the block layout."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.operators import filters, normalise
from motefield.operators.normalise import PreprocessConfig
from motefield.series import SeriesLayout, attach_stats, close_blocks, open_blocks

LENGTHS = [1, 2, 3, 6, 7, 20, 101]
RNG = np.random.default_rng(7)
SERIES = {n: np.round(RNG.normal(10, 3, n), 3) for n in LENGTHS}
SERIES[40] = np.full(40, 2.5)
SERIES[60] = np.arange(60.0)
SERIES[61] = np.arange(61.0)
SERIES[61][30] = 500.0


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(n, t, float(v)) for n, x in SERIES.items() for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "k int, t long, x double").cache()


PLAIN = SeriesLayout(("k",), 101)
BLOCKS = SeriesLayout(("k",), 101, block_rows=64)
SMALL_BLOCKS = SeriesLayout(("k",), 101, block_rows=12)


def result(df, column):
    out = {}
    for r in df.orderBy("k", "t").collect():
        out.setdefault(r["k"], []).append(r[column])
    return {k: np.array(v, dtype=float) for k, v in out.items()}


def padded(x, half):
    return np.pad(x, half, mode="edge")


def rolling_median(x, w):
    p = padded(x, w // 2)
    return np.array([np.median(p[i : i + w]) for i in range(len(x))])


def fit_odd(n, w, least=3):
    if n <= 1:
        return 1
    return max(least, min(w, n if n % 2 else n - 1))


def same(got, want):
    assert got.keys() == SERIES.keys()
    for k in SERIES:
        np.testing.assert_allclose(got[k], want(SERIES[k]), atol=1e-9, err_msg=str(k))


@pytest.mark.parametrize("layout", [PLAIN, BLOCKS, SMALL_BLOCKS])
def test_fixed_median_and_moving_average(frame, layout):
    same(result(filters.median_filter(frame, "x", layout, 5, "y"), "y"), lambda x: rolling_median(x, 5))
    zero = lambda x: np.array([np.pad(x, 2)[i : i + 5].sum() / 5 for i in range(len(x))])
    same(result(filters.moving_average(frame, "x", layout, 5, "y"), "y"), zero)


def test_known_median(spark):
    df = spark.createDataFrame([(1, t, float(v)) for t, v in enumerate([3, 1, 4, 1, 5, 9, 2, 6, 5, 3])], "k int, t long, x double")
    got = result(filters.median_filter(df, "x", SeriesLayout(("k",), 10), 5, "y"), "y")[1]
    assert got.tolist() == [3, 3, 3, 4, 4, 5, 5, 5, 3, 3]


@pytest.mark.parametrize("layout", [PLAIN, BLOCKS, SMALL_BLOCKS])
def test_fitting_median_and_hampel(frame, layout):
    same(result(filters.median_filter_fitting(frame, "x", layout, 7, "y"), "y"), lambda x: rolling_median(x, fit_odd(len(x), 7)))

    def hampel(x):
        w = fit_odd(len(x), 7)
        m = rolling_median(x, w)
        d = np.abs(x - m)
        return np.where(d > 3 * 1.4826 * (rolling_median(d, w) + 1e-8), m, x)

    got = result(filters.hampel_filter(frame, "x", layout, "y"), "y")
    same(got, hampel)
    assert got[61][30] < 100
    np.testing.assert_allclose(got[60][5:-5], SERIES[60][5:-5])


def savgol(x, width, degree):
    n = len(x)
    w = min(width, n if n % 2 else n - 1)
    if n <= degree + 1 or w < degree + 2:
        return x
    c = filters.savgol_weights(w, degree)
    p = padded(x, w // 2)
    return np.array([p[i : i + w] @ c for i in range(n)])


@pytest.mark.parametrize("layout", [PLAIN, SMALL_BLOCKS])
@pytest.mark.parametrize("width,degree", [(11, 3), (7, 3), (5, 2)])
def test_savgol(frame, layout, width, degree):
    same(result(filters.savgol_filter(frame, "x", layout, "y", width, degree), "y"), lambda x: savgol(x, width, degree))


def test_savgol_weights():
    np.testing.assert_allclose(filters.savgol_weights(7, 3), np.array([-2, 3, 6, 7, 6, 3, -2]) / 21, atol=1e-12)
    cubic = np.arange(30.0) ** 3
    np.testing.assert_allclose(savgol(cubic, 11, 3)[6:-6], cubic[6:-6], rtol=1e-9)


def trend(x, width):
    size = max(1, min(width, len(x)))
    back = size // 2
    p = np.pad(x, (back, size), mode="edge")
    return np.array([p[i : i + size].mean() for i in range(len(x))])


@pytest.mark.parametrize("layout", [PLAIN, BLOCKS])
@pytest.mark.parametrize("width", [51, 40, 8])
def test_detrend(frame, layout, width):
    got = filters.detrend(frame, "x", layout, "tr", "y", width)
    same(result(got, "tr"), lambda x: trend(x, width))
    same(result(got, "y"), lambda x: x - trend(x, width))


@pytest.mark.parametrize("layout", [PLAIN, SMALL_BLOCKS])
def test_diff_and_zero_crossings(frame, layout):
    got = result(filters.time_diff(frame, "x", layout, "y"), "y")
    for k, x in SERIES.items():
        np.testing.assert_allclose(got.get(k, np.array([])), np.diff(x), atol=1e-12)
    rates = {r["k"]: r["z"] for r in filters.zero_crossing_rate(frame, "x", layout, "z").collect()}
    for k, x in SERIES.items():
        want = np.mean(np.diff((x < x.mean()).astype(int)) != 0) if len(x) > 1 else None
        assert rates[k] is None if want is None else rates[k] == pytest.approx(want)


def zscore(groups):
    scales, out = {}, {}
    for k, x in groups.items():
        med = np.median(x)
        scales[k] = 1.4826 * np.median(np.abs(x - med))
    positive = [s for s in scales.values() if s > 0]
    floor = max(np.percentile(positive, 10), 1e-6) if positive else 1.0
    for k, x in groups.items():
        out[k] = np.clip((x - np.median(x)) / max(scales[k], floor), -8, 8)
    return out


@pytest.mark.parametrize("layout", [PLAIN, SMALL_BLOCKS, SeriesLayout(("k",), 101, recording_rows=500)])
def test_robust_zscore(frame, layout):
    rows = frame.withColumn("rec", F.lit(1))
    got = result(normalise.robust_zscore(rows, "x", layout.with_keys("rec", "k"), ["rec"], "z"), "z")
    want = zscore(SERIES)
    for k in SERIES:
        np.testing.assert_allclose(got[k], want[k], atol=1e-9)


def test_flat_recording_keeps_scale_one(spark):
    df = spark.createDataFrame([(1, 1, t, 4.0) for t in range(5)], "rec int, k int, t long, x double")
    rows = normalise.robust_zscore(df, "x", SeriesLayout(("rec", "k"), 5), ["rec"], "z").collect()
    assert {r["scale_floor"] for r in rows} == {1.0} and {r["z"] for r in rows} == {0.0}


@pytest.mark.parametrize("pipeline", ["none", "median", "hampel_savgol"])
def test_pipeline_is_the_same_in_blocks(frame, pipeline):
    rows = frame.withColumn("rec", F.lit(1))
    config = PreprocessConfig(pipeline=pipeline, apply_detrend=True, apply_zscore=True, detrend_window=21)
    keys = ("rec", "k")
    layouts = [SeriesLayout(keys, 101), SeriesLayout(keys, 101, block_rows=40), SeriesLayout(keys, 101, recording_rows=500)]
    got = [
        result(normalise.preprocess_amplitude(rows, "x", layout, ["rec"], config), "normalized") for layout in layouts
    ]
    for k in SERIES:
        np.testing.assert_allclose(got[0][k], got[1][k], atol=1e-8)
        np.testing.assert_allclose(got[0][k], got[2][k], atol=1e-8)


def test_unknown_pipeline_and_bad_windows():
    with pytest.raises(ValueError):
        PreprocessConfig(pipeline="other")
    for bad in (4, 0):
        with pytest.raises(ValueError):
            filters.check_odd(bad)
    with pytest.raises(TypeError):
        filters.check_odd(3.0)


def test_stats_on_halo_rows(frame):
    opened = attach_stats(open_blocks(frame, SMALL_BLOCKS, 3), SMALL_BLOCKS, n=F.count(F.lit(1)))
    closed = close_blocks(opened, SMALL_BLOCKS)
    assert closed.count() == frame.count()
    assert closed.filter(F.col("n") != F.col("k")).count() == 0
    assert opened.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 12 + 6
