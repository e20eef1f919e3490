"""The spread-out forms give the same results as the plain ones."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motefield import ranking
from motefield.operators import metrics, neighbours, sampling, spectral, splits
from motefield.operators.packets import align_devices, segment_rows
from motefield.series import SeriesLayout

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat."""
    rows = []
    for key, n in ((1, 900), (2, 40), (3, 1)):
        order = RNG.permutation(n)
        rows += [(key, int(o), float(np.round(RNG.normal(0, 2), 1))) for o in order]
    return spark.createDataFrame(rows, "key int, o long, x double").cache()


def test_positions(skewed):
    small = ranking.positions(skewed, ["key"], ["o"], "t", block_rows=16)
    assert small.filter(F.col("t") != F.col("o")).count() == 0
    assert small.count() == skewed.count()


def test_running_totals(skewed):
    along = Window.partitionBy("key").orderBy("o")
    want = skewed.withColumn("w", F.sum("x").over(along)).select("key", "o", "w")
    cut = ranking.value_bucket(skewed, "o", 50)
    got = ranking.running_totals(cut, ["key"], [F.col("o")], {"s": F.col("x")}, ranking.BUCKET)
    assert got.join(want, ["key", "o"]).filter(F.abs(F.col("s") - F.col("w")) > 1e-9).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_quantiles(skewed, limit):
    shares = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    rows = ranking.quantiles(skewed, ["key"], "x", shares, limit=limit).collect()
    data = skewed.toPandas()
    assert len(rows) == 3
    for r in rows:
        x = data[data.key == r["key"]].x.to_numpy()
        for name, p in shares.items():
            assert r[name] == pytest.approx(np.percentile(x, 100 * p), abs=1e-9)


def test_summary_without_keys(skewed):
    a = ranking.summarise(skewed, [], [F.avg("x").alias("m")], "x", {"q": 0.5}, limit=10).first()
    b = ranking.summarise(skewed, [], [F.avg("x").alias("m")], "x", {"q": 0.5}).first()
    assert a["m"] == pytest.approx(b["m"]) and a["q"] == pytest.approx(b["q"])


@pytest.mark.parametrize("n", [2, 3, 7, 64, 97, 250])
def test_spread_transform(spark, n):
    x = RNG.normal(0.4, 0.2, n)
    df = spark.createDataFrame([("u", t, float(v)) for t, v in enumerate(x)], "unit string, t long, x double")
    layout = SeriesLayout(("unit",), n, block_rows=16)
    rows = spectral.power_spectrum(df, "x", layout, fft_rows=1).orderBy("k", "freq").collect()
    want = np.abs(np.fft.rfft(x)) ** 2
    np.testing.assert_allclose([r["power"] for r in rows], want, atol=1e-9)
    # Parseval: the one-sided spectrum carries the energy of the signal.
    doubled = want.copy()
    doubled[1 : (n + 1) // 2] *= 2
    assert doubled.sum() / n == pytest.approx((x**2).sum())
    near, far = (spectral.spectral_features(df, "x", layout, fft_rows=f).first() for f in (10**6, 1))
    for name in spectral.SCALARS:
        assert near[name] == pytest.approx(far[name], abs=1e-8), name


def test_spectrum_of_single_and_zero_units(spark):
    df = spark.createDataFrame([("a", 0, 3.0), ("b", 0, 0.0), ("b", 1, 0.0)], "k string, t long, x double")
    rows = spectral.spectral_features(df, "x", SeriesLayout(("k",), 2)).collect()
    assert all(r[name] == 0.0 for r in rows for name in spectral.SCALARS)


def test_align_and_segments_in_blocks(spark):
    sizes = {("r1", "dev1"): 45, ("r1", "dev2"): 41, ("r1", "dev3"): 50, ("r2", "dev1"): 9, ("r2", "dev2"): 9}
    rows = [(r, d, t, t * 10) for (r, d), n in sizes.items() for t in range(n)]
    df = spark.createDataFrame(rows, "recording_id string, device string, t long, v long")
    for block_rows in (65_536, 8):
        layout = SeriesLayout(("recording_id", "device"), 50, block_rows=block_rows)
        aligned = align_devices(df, "recording_id", ["dev1", "dev2", "dev3"], layout)
        assert {(r[0], r[1]): r[2] for r in aligned.groupBy("recording_id", "device").count().collect()} == {
            ("r1", d): 41 for d in ("dev1", "dev2", "dev3")
        }
        for width, step in ((20, 10), (25, 25), (5, 8)):
            seg = segment_rows(aligned, layout, width, step).filter("device = 'dev1'")
            starts = list(range(0, 41 - width + 1, step))
            got = {r["segment"]: (r["a"], r["b"], r["n"]) for r in seg.groupBy("segment").agg(
                F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).collect()}
            assert got == {i: (s, s + width - 1, width) for i, s in enumerate(starts)}


def test_auc_with_many_scores(spark, monkeypatch):
    y = RNG.integers(0, 2, 400)
    s = np.round(RNG.normal(y, 2), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    monkeypatch.setattr(metrics, "QUANTILE_ROWS", 7)
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(want)
    assert metrics.roc_auc(df.filter("y = 1"), "y", "s").first()[0] is None


@pytest.mark.parametrize("p", [1, 2])
def test_neighbours_by_cells(spark, monkeypatch, p):
    train, test = RNG.normal(size=(300, 4)), RNG.normal(size=(60, 4))
    train[:100] = train[0]
    tr = spark.createDataFrame([(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(train)], "train_id long, features array<double>, label int")
    te = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(test)], "test_id long, features array<double>")
    monkeypatch.setattr(neighbours, "BLOCK_POINTS", 15)
    monkeypatch.setattr(neighbours, "LANDMARKS", 12)
    near, far = (
        {(r["test_id"], r["rank"]): r["train_id"] for r in neighbours.nearest(tr, te, 5, p, shipped_values=v).collect()}
        for v in (10**6, 10)
    )
    assert near == far and len(near) == 300
    diff = test[:, None, :] - train[None]
    dist = np.abs(diff).sum(2) if p == 1 else np.sqrt((diff**2).sum(2))
    for i in range(60):
        assert [near[i, r] for r in range(1, 6)] == np.lexsort((np.arange(300), dist[i]))[:5].tolist()


def test_distance_weights(spark):
    rows = [(1, 1, 0, 0.0), (1, 2, 1, 0.1), (1, 3, 1, 0.1), (2, 1, 0, 1.0), (2, 2, 1, 2.0), (2, 3, 1, 3.0)]
    df = spark.createDataFrame(rows, "test_id long, train_id long, label int, distance double")
    assert {r[0]: r[1] for r in neighbours.classify(df).collect()} == {1: 1, 2: 1}
    assert {r[0]: r[1] for r in neighbours.classify(df, "distance").collect()} == {1: 0, 2: 0}


def test_splits_keep_groups(spark):
    units = spark.createDataFrame([(u, u // 3, f"l{(u // 3) % 4}") for u in range(600)], "u int, g int, label string")
    roles = splits.stratified_split(units, "g", ["label"])
    joined = units.join(roles, ["g", "label"])
    splits.assert_no_leak(joined.filter("role='train'"), joined.filter("role='test'"), "g")
    for r in roles.groupBy("label").agg(F.count_if(F.col("role") == "test").alias("t"), F.count("*").alias("n")).collect():
        assert r["t"] == math.ceil(0.2 * r["n"])
    with pytest.raises(ValueError):
        splits.assert_no_leak(joined, joined, "g")
    folds = splits.fold_table(units, "g", ["label"]).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {10}


def test_round_robin_takes_turns(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else "b" if i < 55 else "c") for i in range(80)], "id int, g string")
    got = sampling.round_robin_sample(df, "id", "g", 21)
    assert {r[0]: r[1] for r in got.groupBy("g").count().collect()} == {"a": 8, "b": 5, "c": 8}
    assert sampling.round_robin_sample(df, "id", "g", None).count() == 80
    assert sampling.round_robin_sample(df, "id", "g", 100).count() == 80


def test_positions_with_a_tied_first_column(spark):
    """Rows of one key that share the first order column are spread by the next one."""
    rows = spark.range(3000).select(F.lit(1).alias("key"), F.lit(7).alias("o"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("p"), "id")
    cut = ranking.range_bucket(rows, [F.col("o"), F.col("p"), F.col("id")], 100)
    sizes = [r["count"] for r in cut.groupBy(ranking.BUCKET).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 400
    spread = ranking.positions(rows, ["key"], ["o", "p", "id"], "t", block_rows=100)
    plain = ranking.positions(rows, ["key"], ["o", "p", "id"], "t")
    assert spread.dtypes == plain.dtypes
    assert {(r.id, r.t) for r in spread.collect()} == {(r.id, r.t) for r in plain.collect()}


def test_scale_floor_of_series_that_start_late(spark):
    """A series whose first position is missing has its vote in every form of the z-score."""
    import numpy as np

    from motefield.operators import normalise
    from motefield.series import SeriesLayout

    rng = np.random.default_rng(4)
    rows = [(1, s, t, float(v)) for s in (1, 2) for t, v in enumerate(rng.normal(0, 3 * s, 40), start=1)]
    df = spark.createDataFrame(rows, "rec int, sc int, t long, x double")
    short = normalise.robust_zscore(df, "x", SeriesLayout(("rec", "sc"), 40, "t"), ["rec"], "z")
    floors = {round(r.scale_floor, 6) for r in short.collect()}
    scales = {}
    for s in (1, 2):
        x = np.array([r[3] for r in rows if r[1] == s])
        scales[s] = 1.4826 * np.median(np.abs(x - np.median(x)))
    assert len(floors) == 1 and abs(floors.pop() - np.percentile(list(scales.values()), 10)) < 0.01


def test_neighbours_send_small_batches(spark, monkeypatch):
    """A test point may go to every cell and every distance may be a tie; no array of a task or batch that it sends exceeds the bound."""
    monkeypatch.setattr(neighbours, "SLICE_VALUES", 8 * 60)
    seen, plain = [], neighbours._distances
    monkeypatch.setattr(neighbours, "_distances", lambda a, b, p: seen.append(a.size * len(b)) or plain(a, b, p))
    x = np.random.default_rng(2).normal(size=(50, 8))
    frame = pd.DataFrame({"features": list(x)})
    parts = list(neighbours._slices(iter([frame, frame[:0]]), x[:10], 2))
    assert sum(len(part) for part, _ in parts) == 50 and max(seen) <= 8 * 60 and len(parts) == 9
    assert np.allclose(np.concatenate([d for _, d in parts]), plain(x, x[:10], 2))
    same = np.tile(x[:1], (200, 1))
    row, place, dist, rank = neighbours._best(x[:20], same, np.arange(200)[::-1], 3, 2)
    assert (place.reshape(20, 3) == [199, 198, 197]).all() and (rank.reshape(20, 3) == [1, 2, 3]).all()
