"""From unit signals to one model per receiver and a group prediction."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.labels import class_name
from motefield.operators import gram, kernel_svm, models, splits, units, votes
from motefield.operators.filters import median_filter
from motefield.ranking import summarise
from motefield.runtime import lookup_join, materialise
from motefield.series import SeriesLayout
from motefield.sources.artifacts import Artifact

UNIT = ["unit_id", "recording_id", "device", "label"]
SPLIT_NOTE = "groups of recordings, stratified by label, shared by receivers, test share 0.2, seed 42"


@dataclass
class UnitTable:
    """Feature rows of all units with their split role, and the train bounds per receiver."""

    features: DataFrame
    bounds: DataFrame
    median_width: int

    def side(self, role: str, device: str | None = None) -> DataFrame:
        rows = self.features.filter(F.col("role") == role)
        return rows if device is None else rows.filter(F.col("device") == device)


def unit_table(signal: DataFrame, layout: SeriesLayout, target, median_width: int = 5, seed: int = 42) -> UnitTable:
    """Filter, split, scale with train bounds and describe every unit once.

    ``signal`` has the columns ``unit_id, recording_id, device, label, t, x, rssi``; ``target``
    maps the label column to the class column.
    """
    layout = layout.with_keys(*UNIT)
    filtered = materialise(median_filter(signal.select(*UNIT, "t", "x", "rssi"), "x", layout, median_width, "x"))
    roles = splits.stratified_split(filtered, "recording_id", ["label"], seed=seed)
    train = filtered.join(roles.filter("role = 'train'"), ["recording_id", "label"], "left_semi")
    bounds = materialise(units.train_bounds(train, "x", ["device"]))
    scaled = units.scale_by_bounds(filtered, "x", bounds, ["device"])
    rssi = summarise(filtered, UNIT, [F.count("*").alias("n_packets")], "rssi", {"rssi_median": 0.5}, layout.longest)
    features = units.unit_features(scaled, "x", layout).join(rssi, UNIT).join(roles, ["recording_id", "label"])
    features = features.withColumn("label_class", target(F.col("label")))
    return UnitTable(materialise(features.withColumn("y", F.col("label_class").cast("double"))), bounds, median_width)


def clipped(rows: DataFrame, bundle: dict) -> DataFrame:
    """Rows with their features clipped to the train bounds of a bundle."""
    low = F.array(*[F.lit(v) for v in bundle["feature_min"]])
    high = F.array(*[F.lit(v) for v in bundle["feature_max"]])
    return models.clip_to_bounds(rows.withColumns({"feature_min": low, "feature_max": high}), bundle["feature_cols"])


def embedded(rows: DataFrame, artifact: Artifact) -> DataFrame:
    return models.embed(clipped(rows, artifact.bundle), artifact.embedding)


FOLDS = 5
# Costs and kernel widths of the grid per receiver.
DEVICE_GRID = kernel_svm.grid((0.5, 1.0, 5.0, 10.0), ("scale", "auto", 0.01, 0.1, 1.0))


def calibrated_machine(rows: DataFrame, candidate: kernel_svm.Candidate, folds: int = FOLDS) -> PipelineModel:
    """One kernel machine over a feature table (``unit_id, features, label, fold``, perhaps ``weight``), calibrated by the margins of unseen folds."""
    features = vector_to_array("features") if dict(rows.dtypes)["features"] == "vector" else F.col("features")
    table = rows.withColumns({"key": F.lit("all"), "row_id": F.col("unit_id").cast("string"), "features": features})
    made = kernel_svm.fit_machines(table, "key", [candidate], list(range(folds)))
    margins = kernel_svm.fold_margins(table.select("key", "row_id", "label", "fold", "features"), "key", made, [candidate])
    sigmoid = kernel_svm.calibrate(materialise(margins.select("key", "label", F.get("unseen", F.lit(0)).alias("margin"))), "key")["all"]
    return PipelineModel([kernel_svm.chosen_machine(made["all"], [candidate], 0, sigmoid)])


@dataclass
class TunedDevices:
    """What one search over all receivers gives: scores of all candidates, margins of unseen train units, and on demand the models."""

    table: UnitTable
    devices: list[str]
    candidates: list[kernel_svm.Candidate]
    rows: DataFrame
    components: DataFrame
    scores: DataFrame
    margins: DataFrame

    @cached_property
    def artifacts(self) -> dict[str, Artifact]:
        return fitted_artifacts(self)


def receiver_components(table: UnitTable) -> DataFrame:
    """Bounds, scaling and components of the train units of every receiver, from one grouped pass."""
    grams = gram.gram_table(table.side("train"), "device", units.UNIT_FEATURES)
    return materialise(gram.component_table(grams, "device", len(units.UNIT_FEATURES)))


def receiver_rows(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Units clipped to the bounds of their receiver and projected on its components, as ``features`` (array)."""
    fit = components.select("device", F.struct("low", "high", "mean", "scale", "loadings", "k_95").alias("_fit"))
    values = gram.clipped_values(units.UNIT_FEATURES, F.col("_fit.low"), F.col("_fit.high"))
    features = gram.projected(values, F.col("_fit.mean"), F.col("_fit.scale"), F.col("_fit.loadings"), F.col("_fit.k_95"))
    return lookup_join(rows, fit, ["device"]).withColumn("features", features).drop("_fit")


def tune_devices(table: UnitTable, devices: list[str], candidates: list[kernel_svm.Candidate] = DEVICE_GRID, folds: int = FOLDS) -> TunedDevices:
    """A tuned and calibrated kernel machine for every receiver.

    All receivers, candidates and folds are fitted together; scores and calibration come from one scan of the margins of
    unseen units. With all units only the candidates that were chosen are fitted, when the models are asked for. The number of jobs
    does not depend on the number of receivers, candidates or folds.
    """
    components = receiver_components(table)
    train = receiver_rows(table.side("train"), components).filter(F.col("device").isin(devices))
    train = train.select("device", F.col("unit_id").alias("row_id"), F.col("label").alias("label_name"), F.col("y").alias("label"), "features")
    dealt = splits.fold_table(train, "row_id", ["device", "label_name"], folds)
    rows = materialise(train.join(dealt, ["row_id", "device", "label_name"]))
    missing = sorted(set(devices) - {r["device"] for r in rows.select("device").distinct().collect()})
    if missing:
        raise ValueError(f"no train units of {missing}")
    made = kernel_svm.fit_machines(rows, "device", candidates, list(range(folds)), whole=False)
    margins = materialise(kernel_svm.fold_margins(rows, "device", made, candidates))
    scores = materialise(kernel_svm.grid_scores(margins, "device"))
    return TunedDevices(table, devices, candidates, rows, components, scores, margins)


def fitted_artifacts(tuned: TunedDevices) -> dict[str, Artifact]:
    """The chosen machine of every receiver on all its train units, calibrated, with its bundle and its metadata."""
    table, devices, candidates, components, margins = tuned.table, tuned.devices, tuned.candidates, tuned.components, tuned.margins
    best = kernel_svm.best_candidates(tuned.scores, "device")
    chosen = sorted({c for c, _ in best.values()})
    picked = [candidates[c] for c in chosen]
    made = kernel_svm.fit_machines(tuned.rows, "device", picked, [])
    place = F.create_map(*[F.lit(v) for d, (c, _) in best.items() for v in (d, c)])[F.col("device")]
    sigmoids = kernel_svm.calibrate(margins.withColumn("margin", F.get("unseen", place)), "device")
    scales = {r["device"]: r for r in table.bounds.collect()}
    artifacts = {}
    for row in components.filter(F.col("device").isin(devices)).collect():
        device = row["device"]
        candidate, score = best[device]
        bundle = {
            "esp_id": device, "median_width": table.median_width, "global_min": scales[device]["global_min"], "global_max": scales[device]["global_max"],
            "feature_cols": list(units.UNIT_FEATURES), "feature_min": list(row["low"]), "feature_max": list(row["high"]), "k_95": row["k_95"], "model_type": "svm",
        }
        metadata = {
            "model": "svm", "selection": "grid search per receiver", "esp_id": device, "best_params": candidates[candidate].name(), "best_cv_score_f1": score, "split": SPLIT_NOTE,
        }
        model = PipelineModel([kernel_svm.chosen_machine(made[device], picked, chosen.index(candidate), sigmoids[device])])
        artifacts[device] = Artifact(bundle, PipelineModel([gram.projection(units.UNIT_FEATURES, row)]), model, metadata)
    return {d: artifacts[d] for d in devices}


def score_units(rows: DataFrame, artifacts: dict[str, Artifact]) -> DataFrame:
    """Predictions of every unit by the model of its receiver; units of a receiver without a model are an error."""
    missing = [r["device"] for r in rows.filter(~F.col("device").isin(list(artifacts))).select("device").distinct().limit(5).collect()]
    if missing:
        raise ValueError(f"no model for units of {missing}")
    out = None
    for device, artifact in artifacts.items():
        ready = embedded(rows.filter(F.col("device") == device), artifact).withColumnRenamed("label", "label_name")
        scored = models.predict(artifact.model, ready).select(
            "unit_id", "recording_id", "device", "label_name", "label_class", "n_packets", "y_pred", "score",
            F.lit(artifact.bundle["model_type"]).alias("model_type"), F.lit(artifact.bundle["k_95"]).alias("k_95"),
        )
        out = scored if out is None else out.unionByName(scored)
    return out


def inference_report(scored: DataFrame, unit: str = "unit_id", names: dict[int, str] | None = None) -> DataFrame:
    """One record per unit: class, name, probabilities, model type, components and packets."""
    if names is None:
        label = F.when(F.col("y_pred") == 0, "label_00").otherwise("other_labels")
    else:
        label = class_name(F.col("y_pred"), names)
    return scored.select(
        F.col(unit).cast("string").alias("data_file"),
        F.col("y_pred").alias("predicted_class"),
        label.alias("predicted_label_name"),
        (1 - F.col("score")).alias("probability_class_0"),
        F.col("score").alias("probability_class_1"),
        "model_type",
        "k_95",
        "n_packets",
    )


def multiclass_report(scored: DataFrame, names: dict[int, str], unit: str = "unit_id") -> DataFrame:
    """One record per unit: class, name, and the probability of every class by its name; classes without a name are ``class_<n>``."""
    numbers = F.sequence(F.lit(0), F.size("scores") - 1)
    named = F.transform(numbers, lambda i: class_name(i, names))
    return scored.select(
        F.col(unit).cast("string").alias("data_file"),
        F.col("y_pred").alias("predicted_class"),
        class_name(F.col("y_pred"), names).alias("predicted_label_name"),
        F.map_from_arrays(named, F.transform("scores", lambda p: F.round(p, 6))).alias("probabilities_by_class"),
    )


def json_records(report: DataFrame) -> DataFrame:
    return report.select("data_file", F.to_json(F.struct(*report.columns)).alias("record"))



def group_votes(scored: DataFrame, devices: list[str], group: str = "recording_id") -> DataFrame:
    """Unit predictions to a vote of every receiver, then of the group, next to the true class of the group."""
    votes.assert_single_truth(scored, group, "label_class")
    voted = votes.vote_binary(scored, group, devices, "y_pred")
    truth = scored.groupBy(group).agg(F.max("label_class").alias("y_true"))
    return voted.join(truth, group).withColumnRenamed("pred", "y_pred")
