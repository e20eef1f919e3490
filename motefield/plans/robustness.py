"""How well a window classifier holds under other scalings, feature subsets and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.iq import exploded, iq_amplitude
from motefield.operators import batched, metrics, models, splits, windows
from motefield.operators.normalise import PreprocessConfig, preprocess_amplitude
from motefield.runtime import lookup_join, materialise, packed, written
from motefield.series import SeriesLayout

WINDOW = ["recording_id", "segment"]
# The compared preprocessing settings and feature subsets.
CONFIGS = {
    "smooth_raw_scale": PreprocessConfig(),
    "smooth_zscore": PreprocessConfig(apply_zscore=True),
    "smooth_detrend_zscore": PreprocessConfig(apply_detrend=True, apply_zscore=True),
    "median_detrend_zscore": PreprocessConfig(pipeline="median", apply_detrend=True, apply_zscore=True),
}
META = ["person_id", "binary_label"]


def subset_indices(names: list[str], devices: list[str]) -> dict[str, list[int]]:
    """Positions of the features in each subset: all, without the last receiver, by receiver, and by kind."""
    scopes = [windows.feature_scope(name) for name in names]
    out = {
        "all_selected": list(range(len(names))),
        f"without_{devices[-1]}": [i for i, (_, receivers) in enumerate(scopes) if devices[-1] not in receivers],
    }
    for device in devices:
        out[f"{device}_only"] = [i for i, scope in enumerate(scopes) if scope == ("receiver", (device,))]
    for kind, name in (("global", "global_only"), ("pair", "pairs_only")):
        out[name] = [i for i, scope in enumerate(scopes) if scope[0] == kind]
    return out


def window_layout(packets: DataFrame, width: int) -> SeriesLayout:
    """Layout of the sample series of a window, with the samples of the largest window: one that fits a task needs no second pass for its scales."""
    sizes = packets.groupBy(*WINDOW).agg(F.sum(F.floor(F.size("iq") / 2)).alias("n"))
    return SeriesLayout((*WINDOW, "device", "sc"), width, "seg_t", recording_rows=int(sizes.agg(F.max("n")).first()[0] or 0))


SAMPLE = [*WINDOW, "device", "seg_t", "sc"]


def window_samples(packets: DataFrame) -> DataFrame:
    """Amplitudes of all windows, one row per sample."""
    return exploded(packets, [*WINDOW, "device", "seg_t"], iq_amplitude(F.col("iq")), "sc", "x")


def smoothing(config: PreprocessConfig) -> PreprocessConfig:
    """The part of a setting that decides the smoothed values."""
    return config.but(apply_detrend=False, apply_zscore=False, detrend_window=0, scale_floor_percentile=0.0, z_clip=None)


def smoothed_windows(packets: DataFrame, layout: SeriesLayout, configs: dict[str, PreprocessConfig]) -> dict[PreprocessConfig, DataFrame]:
    """Smoothed samples by kind of smoothing, for those that several settings share; each is computed once."""
    kinds = [smoothing(c) for c in configs.values()]
    out = {}
    for kind in dict.fromkeys(k for k in kinds if kinds.count(k) > 1):
        done = preprocess_amplitude(window_samples(packets), "x", layout, WINDOW, kind)
        out[kind] = written(done.select(*SAMPLE, F.col("smoothed").alias("x")), "smoothed")
    return out


def window_table(
    packets: DataFrame, config: PreprocessConfig, layout: SeriesLayout, devices: list[str], smoothed: dict[PreprocessConfig, DataFrame] | None = None
) -> tuple[DataFrame, list[str]]:
    """Feature vectors of all windows after preprocessing inside each window, and feature names.

    ``smoothed`` are the samples of :func:`smoothed_windows`; a setting whose smoothing is among them goes on from there.
    """
    ready = (smoothed or {}).get(smoothing(config))
    samples, rest = (window_samples(packets), config) if ready is None else (ready, config.but(pipeline="raw"))
    done = preprocess_amplitude(samples, "x", layout, WINDOW, rest).select(*SAMPLE, F.col("normalized").alias("x"))
    long = windows.window_features(done, packets, WINDOW, devices)
    table = windows.feature_table(long, WINDOW, "motion_only")
    meta = packets.groupBy(*WINDOW).agg(*[F.first(c).alias(c) for c in META])
    rows = materialise(table.join(meta, WINDOW))
    names = rows.select("names").first()["names"]
    ready = models.as_features(rows.drop("names")).withColumn("label", F.col("binary_label").cast("double"))
    return ready, names


RESULT = [
    "config", "split", "feature_subset", "n_train", "n_test", "accuracy", "balanced_accuracy", "roc_auc", "support_no_motion", "support_motion",
]


def stacked_windows(packets: DataFrame, width: int, devices: list[str], configs: dict[str, PreprocessConfig]) -> tuple[DataFrame, dict[str, list[str]]]:
    """One row per window with the features of all settings end to end, and the feature names of each setting."""
    layout = window_layout(packets, width)
    smoothed = smoothed_windows(packets, layout, configs)
    out, names = None, {}
    for name, config in configs.items():
        table, names[name] = window_table(packets, config, layout, devices, smoothed)
        own = table.select(*WINDOW, *META, "label", vector_to_array("features").alias("features"))
        if out is None:
            out = own
        else:
            both = out.join(own.select(*WINDOW, F.col("features").alias("_more")), WINDOW)
            out = both.withColumn("features", F.concat("features", "_more")).drop("_more")
    return materialise(out), names


def hold_out_matrix(table: DataFrame) -> tuple[DataFrame, list[str]]:
    """``uses``: for each split whether a window is on its train side: by recordings, by persons, and without each person."""
    names, sides = [], []
    for group in ("recording_id", "person_id"):
        roles = splits.group_shuffle_split(table, group).select(group, (F.col("role") == "train").alias(f"_by_{group}"))
        table = lookup_join(table, roles, [group])
        names.append(group)
        sides.append(F.col(f"_by_{group}"))
    for row in table.select("person_id").distinct().orderBy("person_id").collect():
        names.append(f"without {row['person_id']}")
        sides.append(F.col("person_id") != row["person_id"])
    return table.withColumn("uses", F.array(*sides)).drop("_by_recording_id", "_by_person_id"), names


def robustness_grid(
    packets: DataFrame, width: int, devices: list[str], configs: dict[str, PreprocessConfig] = CONFIGS, cost: float = 1.0
) -> DataFrame:
    """Scores per setting, feature subset and split, and with each person held out.

    All settings, subsets, splits and persons are models of one batched fit over one table: splits are masks, subsets and settings are
    ranges of its feature array. Scores come from one scan. A split whose train side has one class only, or that leaves no row to test, is left out.
    """
    spark = packets.sparkSession
    table, names = stacked_windows(packets, width, devices, configs)
    table, split_names = hold_out_matrix(table)
    rows = materialise(table.select("binary_label", "label", "features", "uses"))
    fits, told, start = [], [], 0
    for config, own in names.items():
        subsets = {k: tuple(start + i for i in v) for k, v in subset_indices(own, devices).items() if v}
        for s, split in enumerate(split_names):
            for subset, columns in subsets.items():
                if s < 2 or subset == "all_selected":
                    told.append((len(fits), config, split, subset, s))
                    fits.append(batched.Fit(cost, s, columns))
        start += len(own)
    known = batched.split_statistics(rows, len(split_names), start)
    weights = batched.fit_logistic(rows, fits, known)
    scored = materialise(batched.unseen_scores(rows, fits, weights, known, ["binary_label"]))
    return scored_fits(spark, scored, told, known)


def scored_fits(spark, scored: DataFrame, told: list[tuple], known: batched.Splits) -> DataFrame:
    true, said = F.col("binary_label"), (F.col("score") > 0.5).cast("int")
    sums = scored.groupBy("fit").agg(
        F.count("*").alias("n_test"), F.avg((true == said).cast("int")).alias("accuracy"),
        F.count_if(true == 0).alias("support_no_motion"), F.count_if(true == 1).alias("support_motion"),
        F.avg(F.when(true == 0, 1 - said)).alias("_r0"), F.avg(F.when(true == 1, said)).alias("_r1"),
    )
    recalls = F.array_compact(F.array("_r0", "_r1"))
    balanced = F.aggregate(recalls, F.lit(0.0), lambda a, v: a + v) / F.size(recalls)
    areas = metrics.roc_auc(scored, "binary_label", "score", ["fit"])
    sizes = [(*t[:4], int(known.negatives[t[4]] + known.positives[t[4]])) for t in told]
    fits = spark.createDataFrame(sizes, "fit int, config string, split string, feature_subset string, n_train long")
    return fits.join(sums.withColumn("balanced_accuracy", balanced), "fit").join(areas, "fit").select(*RESULT)


def importance_mass(
    packets: DataFrame, width: int, devices: list[str], configs: dict[str, PreprocessConfig] = CONFIGS, trees: int = 300, parallelism: int = 4
) -> DataFrame:
    """Random forest importance summed over feature groups for every setting, fitted on the train recordings.

    Settings are worked side by side and share their smoothing; the nodes that the driver holds of all forests together are bounded.
    """
    layout = window_layout(packets, width)
    smoothed = smoothed_windows(packets, layout, configs)
    lanes = min(parallelism, len(configs))

    def one(name: str) -> DataFrame:
        table, names = window_table(packets, configs[name], layout, devices, smoothed)
        roles = splits.group_shuffle_split(table, "recording_id")
        train = table.join(roles.filter("role = 'train'"), "recording_id", "left_semi")
        weighted = materialise(metrics.with_class_weights(train, "label"))
        rows = weighted.count()
        estimator = models.forest(trees=trees, leaf=2, weight="weight")
        importance = models.forest_importance(estimator, packed(weighted, rows), rows, models.FOREST_ROWS // lanes)
        return models.importance_groups(models.importance_table(packets.sparkSession, importance, names), devices).withColumn("config", F.lit(name))

    found = models.run_parallel([lambda n=n: one(n) for n in configs], lanes)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
