"""Votes, metrics, labels and models."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import functions as F

from motefield.functions import labels, scaling
from motefield.operators import metrics, models, votes
from motefield.operators.normalise import PreprocessConfig

RNG = np.random.default_rng(11)


def test_vote_ties(spark):
    rows = [("g1", "dev1", 1), ("g1", "dev1", 0), ("g1", "dev2", 0), ("g2", "dev1", 0), ("g2", "dev2", 0), ("g2", "dev3", 1)]
    df = spark.createDataFrame(rows, "g string, device string, pred int")
    got = {r["g"]: r for r in votes.vote_binary(df, "g", ["dev1", "dev2", "dev3"]).collect()}
    assert got["g1"]["pred"] == 1 and got["g1"]["pred_dev3"] is None and got["g2"]["pred"] == 0
    assert [r["g"] for r in votes.vote_binary(df, "g", ["dev1", "dev2", "dev3"], complete=True).collect()] == ["g2"]
    assert {r["g"]: r["pred"] for r in votes.vote_of_three(df, "g").collect()} == {"g2": 0}
    multi = {r["g"]: r for r in votes.vote_multiclass(df, "g").collect()}
    assert multi["g1"]["pred"] == 0 and multi["g1"]["vote_counts"] == {0: 2, 1: 1}


def test_votes_do_not_depend_on_order(spark):
    rows = [(int(g), f"dev{d}", int(p)) for g, d, p in zip(RNG.integers(0, 9, 200), RNG.integers(1, 4, 200), RNG.integers(0, 4, 200))]
    results = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "g int, device string, pred int").repartition(5)
        out = votes.vote_multiclass_two_level(df, "g", ["dev1", "dev2", "dev3"]).orderBy("g").collect()
        results.append([(r["g"], r["pred"], r["vote_counts"]) for r in out])
    assert results[0] == results[1]


def test_vote_guards(spark):
    bad = spark.createDataFrame([("g", "dev1", 2)], "g string, device string, pred int")
    with pytest.raises(Exception, match="outside 0/1"):
        votes.vote_binary(bad, "g", ["dev1"]).collect()
    mixed = spark.createDataFrame([("g", 1), ("g", 2)], "g string, y int")
    with pytest.raises(ValueError):
        votes.assert_single_truth(mixed, "g", "y")


def test_report_with_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y_true int, y_pred int")
    rows = {r["class"]: r for r in metrics.per_class(df, [0, 1, 2]).collect()}
    assert (rows[2]["precision"], rows[2]["recall"], rows[2]["f1"], rows[2]["support"]) == (0, 0, 0, 0)
    assert rows[1]["precision"] == pytest.approx(2 / 3) and rows[0]["recall"] == 0.5
    assert metrics.basic(df, [0, 1, 2]).first()["balanced_accuracy"] == pytest.approx(0.75)


def test_unpaired_predictions_fail(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "u int, y_pred int")
    b = spark.createDataFrame([(1, 0)], "u int, y_true int")
    with pytest.raises(Exception, match="without prediction or truth"):
        metrics.paired_predictions(a, b, "u").collect()


def test_unknown_labels_fail(spark):
    df = spark.createDataFrame([("label_09",)], "label string")
    with pytest.raises(Exception, match="label_09"):
        df.select(labels.distance(F.col("label"))).collect()
    with pytest.raises(Exception, match="exceed"):
        spark.range(1).select(scaling.minmax(F.lit(1.0), F.lit(2.0), F.lit(2.0))).collect()


@pytest.fixture(scope="module")
def blobs(spark):
    x = RNG.normal(size=(240, 3))
    inside = (x**2).sum(1) < 2.2
    rows = [(i, *map(float, r), int(c), float(c), i % 5) for i, (r, c) in enumerate(zip(x, inside))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y int, label double, fold int")
    return df.withColumn("features", array_to_vector(F.array("a", "b", "c"))).coalesce(1).cache()


def accuracy(model, df):
    return metrics.basic(models.predict(model, df).withColumn("y_true", F.col("y")), [0, 1]).first()["accuracy"]


def test_kernel_machine_beats_majority_and_is_saved(spark, blobs, tmp_path):
    share = blobs.agg(F.avg("label")).first()[0]
    model = models.rbf_svm(240, 5.0, landmarks=40).fit(blobs)
    got = accuracy(model, blobs)
    assert got > max(share, 1 - share) + 0.1
    model.write().save(str(tmp_path / "m"))
    assert accuracy(PipelineModel.load(str(tmp_path / "m")), blobs) == got
    assert accuracy(models.rbf_svm(240, 5.0, landmarks=40).fit(blobs), blobs) == got


def test_tuning_picks_the_better_candidate(blobs):
    family = models.device_family(240, costs=(5.0,), gammas=("scale", "0.0001"))
    _, score, params = models.tune(blobs, family, models.positive_f1())
    assert params["gamma"] == "scale" and score > 0.5


def test_embedding_matches_numpy(blobs):
    emb = models.fit_embedding(blobs, ["a", "b", "c"])
    x = np.array([[r["a"], r["b"], r["c"]] for r in blobs.collect()])
    z = (x - x.mean(0)) / x.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    np.testing.assert_allclose(emb.variance, values / values.sum(), atol=1e-9)
    rows = models.embed(blobs.drop("features"), emb).select("features").collect()
    got = np.array([r[0].toArray() for r in rows])
    np.testing.assert_allclose((got**2).sum(1), (z**2).sum(1) if emb.k_95 == 3 else (got**2).sum(1), atol=1e-9)
    assert models.first_reaching([0.6, 0.3, 0.06, 0.04]) == 3


def test_gaussian_and_majority(blobs):
    nb = models.fit_gaussian(blobs, ["a", "b", "c"], "y")
    out = nb.predict(blobs).agg(F.avg((F.col("pred") == F.col("y")).cast("int"))).first()[0]
    share = blobs.agg(F.avg("label")).first()[0]
    assert out > max(share, 1 - share)
    assert models.majority_class(blobs, "y") == int(share > 0.5)


def test_clip_ignores_bounds_of_other_width(spark):
    df = spark.createDataFrame([(5.0, [0.0], [1.0]), (5.0, [0.0, 1.0], [1.0, 2.0]), (5.0, None, None)], "a double, feature_min array<double>, feature_max array<double>")
    assert [r["a"] for r in models.clip_to_bounds(df, ["a"]).collect()] == [1.0, 5.0, 5.0]


def test_macro_f1(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 2.0)], "label double, prediction double")
    assert models.MacroF1().evaluate(df) == pytest.approx((2 / 3 + 2 / 3 + 1) / 3)


def test_model_spaces():
    sizes = {f.name: len(f.maps()) for f in models.binary_families(100)}
    assert sizes == {"boosting": 12, "logistic": 3, "forest": 12, "svm_linear": 3, "svm_rbf": 6}
    assert len(models.device_family(100).maps()) == 20
    assert len({f.name for f in models.multiclass_families(100, 4)}) == len(models.multiclass_families(100, 4))


def test_single_receiver_settings():
    config = PreprocessConfig.single_receiver("median", median_window=6)
    assert config.median_window == 7 and config.apply_detrend and config.apply_zscore
    assert not PreprocessConfig.single_receiver("none").apply_zscore
