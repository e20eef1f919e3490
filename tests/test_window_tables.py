"""Feature tables with missing features, and what feature names say."""

import pytest

from motefield.operators import models, windows
from motefield.plans import robustness

NAMES = ["motion__global_dt_mean", "motion__dev1_dt_mean", "motion__dev3_rssi_dt_std", "motion__pair_dev1_dev2_absdiff_dt_std", "motion__pair_dev1_dev3_absdiff_dt_std", "absolute__receiver_spread_mean"]
DEVICES = ["dev1", "dev2", "dev3"]


def test_a_window_without_a_feature_keeps_the_places_of_the_others(spark):
    rows = [(1, "motion__a", 1.0), (1, "motion__b", 2.0), (1, "motion__c", 3.0), (2, "motion__a", 4.0), (2, "motion__c", 5.0), (3, "motion__b", None), (4, "absolute__z", 1.0)]
    long = spark.createDataFrame(rows, "w int, feature string, value double")
    got = {r.w: (r.names, r.features) for r in windows.feature_table(long, ["w"]).collect()}
    names = ["motion__a", "motion__b", "motion__c"]
    assert got == {1: (names, [1.0, 2.0, 3.0]), 2: (names, [4.0, 0.0, 5.0]), 3: (names, [0.0, 0.0, 0.0])}


def test_no_feature_at_all_is_an_error(spark):
    long = spark.createDataFrame([(1, "absolute__z", 1.0)], "w int, feature string, value double")
    with pytest.raises(ValueError):
        windows.feature_table(long, ["w"], "motion_only")


def test_subsets_and_groups_follow_the_scope(spark):
    found = robustness.subset_indices(NAMES, DEVICES)
    assert found == {
        "all_selected": [0, 1, 2, 3, 4, 5], "without_dev3": [0, 1, 3, 5], "dev1_only": [1], "dev2_only": [], "dev3_only": [2],
        "global_only": [0], "pairs_only": [3, 4],
    }
    table = spark.createDataFrame([(n, float(2**i)) for i, n in enumerate(NAMES)], "feature string, importance double")
    got = {r.feature_group: r.importance_mass for r in models.importance_groups(table, DEVICES).collect()}
    assert got == {"global": 1.0, "dev1": 2.0, "dev3": 4.0, "pair_dev1_dev2": 8.0, "pairs_with_dev3": 16.0}


def test_blocks_with_missing_receivers_and_shapes(spark):
    """Windows of several shapes, with gaps: statistics of each vector by numpy, missing samples left out."""
    import numpy as np

    from motefield.operators import windows

    rng = np.random.default_rng(4)
    rows, kept = [], {}
    for w, (packets, sc) in enumerate([(6, 4), (6, 4), (3, 2), (1, 3)]):
        x = rng.normal(size=(2, packets, sc))
        if w == 1:
            x[1, 2, 0] = np.nan
        kept[w] = x
        rows += [(w, f"d{d}", t, s, float(x[d, t, s])) for d in range(2) for t in range(packets) for s in range(sc) if not np.isnan(x[d, t, s])]
    samples = spark.createDataFrame(rows, "w int, device string, seg_t int, sc int, x double").repartition(3)
    blocks = windows.window_blocks(samples, ["w"], ["d0", "d1"])
    got = {(r.w, r.vector): r for r in windows.block_summary(blocks, ["w"], ["d0", "d1"]).collect()}
    for w, x in kept.items():
        gap, step = np.abs(x[0] - x[1]), np.diff(x, axis=1)
        for vector, values in {"absolute__d1_x": x[1], "motion__global_abs_dt": np.abs(step), "absolute__pair_d0_d1_absdiff": gap, "motion__d0_motion_energy": np.abs(step[0]).mean(axis=1)}.items():
            v = values[~np.isnan(values)]
            if len(v):
                want = [v.mean(), v.std(), v.min(), *np.quantile(v, [0.1, 0.5, 0.9]), v.max()]
                assert np.allclose([got[w, vector][s] for s in windows.STATS], want)
            else:
                assert (w, vector) not in got
    names = {(r.w, r.feature): r.value for r in windows.block_features(blocks, ["w"], ["d0", "d1"]).collect()}
    assert names[3, "motion__d0_t_energy_000"] == 0.0 and (3, "motion__d0_sc_energy_000") not in names
    assert np.isclose(names[0, "absolute__d0_sc_mean_002"], kept[0][0, :, 2].mean()) and np.isclose(names[2, "motion__d1_t_energy_002"], np.abs(np.diff(kept[2][1], axis=0)).mean(axis=1)[1])


def test_tasks_of_windows_follow_from_samples(spark, monkeypatch):
    """24,000 samples, 1,000 a task: as many tasks as that asks for, however few bytes are shuffled, with the values of one task."""
    from pyspark.sql import functions as F

    samples = spark.range(24_000).select(
        F.floor(F.col("id") / 24).alias("w"), (F.floor(F.col("id") / 4) % 6).alias("seg_t"), (F.col("id") % 4).alias("sc"), F.sin("id").alias("x")
    )
    few = sorted(tuple(r) for r in windows.single_receiver_features(samples, ["w"]).collect())
    monkeypatch.setattr(windows, "TASK_SAMPLES", 1000, raising=False)
    assert windows.wide(samples.withColumn("_r", F.lit("one")), ["w"], ["one"], "_r").rdd.getNumPartitions() == 25
    many = sorted(tuple(r) for r in windows.single_receiver_features(samples, ["w"]).collect())
    assert [r[:2] for r in few] == [r[:2] for r in many] and all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(few, many))


def test_smoothing_is_shared_and_scales_need_no_second_pass(spark):
    """Settings that go on from shared smoothed samples, on whole windows, have the features of a setting that does all steps by itself and joins its scales."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from motefield.operators.normalise import preprocess_amplitude
    from motefield.series import SeriesLayout

    place = F.floor(F.col("id") / 3)
    packets = spark.range(4 * 2 * 6 * 3).select(
        F.floor(place / 12).cast("int").alias("recording_id"), (F.floor(place / 6) % 2).cast("int").alias("segment"), (place % 6).alias("seg_t"),
        F.concat(F.lit("dev"), (F.col("id") % 3 + 1).cast("string")).alias("device"), (-30 - F.col("id") % 7).alias("rssi"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.pmod(F.hash("id", i), F.lit(99))).alias("iq"),
        F.lit("p").alias("person_id"), (F.floor(place / 12) % 2).cast("int").alias("binary_label"),
    ).repartition(3).cache()
    layout = robustness.window_layout(packets, 6)
    assert layout.recording_fits and layout.recording_rows == 6 * 3 * 4
    shared = robustness.smoothed_windows(packets, layout, robustness.CONFIGS)
    assert len(shared) == 1
    alone = SeriesLayout((*robustness.WINDOW, "device", "sc"), 6, "seg_t")
    features = lambda table: {tuple(r[:2]): r[2] for r in table.select(*robustness.WINDOW, vector_to_array("features")).collect()}
    for config in robustness.CONFIGS.values():
        got, names = robustness.window_table(packets, config, layout, DEVICES, shared)
        want, same = robustness.window_table(packets, config, alone, DEVICES)
        assert names == same and features(got) == features(want) and len(features(want)) == 8
    last = robustness.CONFIGS["smooth_detrend_zscore"]
    rest = preprocess_amplitude(shared[robustness.smoothing(last)], "x", layout, robustness.WINDOW, last.but(pipeline="raw"))
    plan = rest._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_quantiles_with_and_without_gaps():
    import numpy as np

    values = np.random.default_rng(3).normal(size=(50, 17))
    values[7, 3], values[9, :16] = np.nan, np.nan
    assert (windows._quantiles(values, [0.1, 0.5, 0.9]) == np.nanquantile(values, [0.1, 0.5, 0.9], axis=1)).all()


def test_importance_of_a_forest_in_parts(spark, monkeypatch):
    """Parts hold no more trees than asked for, make up the whole forest, and weigh as their trees; a small forest is one fit."""
    import numpy as np
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(8).normal(size=(200, 4))
    rows = spark.createDataFrame([(Vectors.dense(v), float(v[1] > 0)) for v in x], ["features", "label"]).coalesce(1).cache()
    fitted, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: fitted.append((self.getNumTrees(), self.getSeed(), fit(self, df))) or fitted[-1][2])
    estimator = models.forest(trees=10, depth=3)
    whole = models.forest_importance(estimator, rows, 200)
    assert [f[0] for f in fitted] == [10] and np.isclose(whole.sum(), 1.0)
    fitted.clear()
    found = models.forest_importance(estimator, rows, 200, forest_rows=200 * 3 * 2, parallelism=2)
    assert sorted(f[0] for f in fitted) == [1, 3, 3, 3] and len({f[1] for f in fitted}) == 4
    want = sum(n * m.featureImportances.toArray() for n, _, m in fitted) / 10
    assert np.allclose(found, want) and found.argmax() == 1
