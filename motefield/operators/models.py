"""Feature transforms, classifiers and their tuning on Spark ML.

A *feature table* has one row per unit or window with double columns or a ``features``
vector, ``label`` (double) and optional ``weight``. It is small compared with the packets,
but every fit here is distributed and nothing is collected except parameters and scores.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import ElementwiseProduct, PolynomialExpansion, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motefield.operators import gram
from motefield.operators.gram import first_reaching as first_reaching
from motefield.operators.windows import feature_scope
from motefield.runtime import materialise

# Train rows times trees of a forest whose nodes are on the driver at one time.
FOREST_ROWS = 2_400_000

# --- exact transforms ---------------------------------------------------------------------


def column_bounds(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Minimum and maximum of every column as parallel arrays."""
    return df.groupBy(*by).agg(
        F.array(*[F.min(c) for c in columns]).alias("feature_min"),
        F.array(*[F.max(c) for c in columns]).alias("feature_max"),
    )


def clip_to_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    """Clip columns to the arrays ``feature_min`` / ``feature_max`` of the row.

    Missing bounds, or bounds for another number of columns, leave the row as it is.
    """
    low, high = F.col("feature_min"), F.col("feature_max")
    usable = F.coalesce((F.size(low) == len(columns)) & (F.size(high) == len(columns)), F.lit(False))
    clipped = {
        c: F.when(usable, F.least(F.greatest(F.col(c), F.get(low, F.lit(i))), F.get(high, F.lit(i)))).otherwise(F.col(c))
        for i, c in enumerate(columns)
    }
    return df.withColumns(clipped).drop("feature_min", "feature_max")


def standardize(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the train side; a constant column becomes 0."""
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).first()
    return df.withColumns(
        {c: (F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"] or 1.0) for c in columns}
    )


def majority_class(train: DataFrame, label: str) -> int:
    """Most frequent label, ties to the smallest."""
    sizes = train.groupBy(label).agg(F.count("*").alias("n"))
    return sizes.agg(F.max_by(label, F.struct(F.col("n"), -F.col(label)))).first()[0]


@dataclass
class GaussianClasses:
    """Class priors with mean and variance of every column."""

    columns: list[str]
    classes: list[int]
    priors: list[float]
    means: list[list[float]]
    variances: list[list[float]]

    def log_posterior(self, i: int) -> Column:
        out = F.lit(float(np.log(self.priors[i])))
        for c, m, v in zip(self.columns, self.means[i], self.variances[i]):
            out = out - 0.5 * float(np.log(2 * np.pi * v)) - (F.col(c) - m) ** 2 / (2 * v)
        return out

    def predict(self, df: DataFrame, out: str = "pred") -> DataFrame:
        """Class with the largest posterior, ties to the smallest class."""
        scored = [F.struct(self.log_posterior(i).alias("s"), F.lit(-c).alias("c")) for i, c in enumerate(self.classes)]
        best = F.array_max(F.array(*scored))
        return df.withColumn(out, (-best["c"]).cast("int"))


def fit_gaussian(train: DataFrame, columns: list[str], label: str, var_smoothing: float = 1e-9) -> GaussianClasses:
    """Gaussian naive Bayes with the largest column variance times ``var_smoothing`` added."""
    widest = train.agg(F.greatest(*[F.var_pop(c) for c in columns], F.lit(0.0))).first()[0]
    rows = train.groupBy(label).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns]
    ).orderBy(label).collect()
    total = sum(r["n"] for r in rows)
    extra = var_smoothing * widest
    return GaussianClasses(
        columns,
        [r[label] for r in rows],
        [r["n"] / total for r in rows],
        [[r[f"m_{c}"] for c in columns] for r in rows],
        [[r[f"v_{c}"] + extra for c in columns] for r in rows],
    )


# --- embedding ----------------------------------------------------------------------------


@dataclass
class Embedding:
    """Fitted standardisation, PCA and cut to the leading components."""

    pipeline: PipelineModel
    variance: list[float]
    loadings: np.ndarray
    k_95: int


def population_scaler(source: str, target: str, n: int, width: int) -> list:
    """Stages that standardise by the population deviation of ``n`` rows.

    Spark divides by the sample deviation; a factor turns it into the population one.
    """
    factor = float(np.sqrt(n / (n - 1))) if n > 1 else 1.0
    return [
        StandardScaler(inputCol=source, outputCol="_std", withMean=True, withStd=True),
        ElementwiseProduct(scalingVec=Vectors.dense([factor] * width), inputCol="_std", outputCol=target),
    ]


def fit_embedding(train: DataFrame, columns: list[str]) -> Embedding:
    """Standardise by the population deviation, principal components, keep those up to 95 % variance; one pass over the rows."""
    row = gram.component_table(gram.gram_table(train.withColumn("_all", F.lit("")), "_all", columns), "_all", len(columns)).first()
    return Embedding(PipelineModel([gram.projection(columns, row)]), list(row["evr"]), np.array(row["loadings"]).T, row["k_95"])


def embed(df: DataFrame, embedding: Embedding | PipelineModel) -> DataFrame:
    model = embedding.pipeline if isinstance(embedding, Embedding) else embedding
    return model.transform(df)


def variance_table(spark: SparkSession, shares: list[float]) -> DataFrame:
    """Component, share and running share; one row per component."""
    rows = [(i + 1, float(v), float(c)) for i, (v, c) in enumerate(zip(shares, np.cumsum(shares)))]
    return spark.createDataFrame(rows, "component int, evr double, cumulative double")


def component_importance(spark: SparkSession, embedding: Embedding, columns: list[str]) -> DataFrame:
    """Squared loadings weighted by explained variance, over the kept components."""
    k = embedding.k_95
    weight = (embedding.loadings[:, :k] ** 2) @ np.array(embedding.variance[:k])
    return spark.createDataFrame([(c, float(w)) for c, w in zip(columns, weight)], "feature string, importance double")


def as_features(df: DataFrame, values: str = "features") -> DataFrame:
    """Array column to vector column ``features``."""
    return df.withColumn("features", array_to_vector(F.col(values)))


# --- rbf feature map ----------------------------------------------------------------------


class RbfMap(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Kernel features of a row: its RBF similarities to the landmarks, whitened."""

    state = Param(Params._dummy(), "state", "landmarks, whitening and gamma as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, state=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        made = json.loads(self.getOrDefault(self.state))
        marks, white, gamma = np.array(made["landmarks"]), np.array(made["whitening"]), made["gamma"]

        @F.pandas_udf("array<double>")
        def similar(x: pd.Series) -> pd.Series:
            points = np.stack(x.to_numpy())
            gaps = ((points[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2)
            return pd.Series(list(np.exp(-gamma * gaps) @ white))

        return df.withColumn(
            self.getOutputCol(), array_to_vector(similar(vector_to_array(F.col(self.getInputCol()))))
        )


class RbfFeatures(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fits :class:`RbfMap`. ``gamma`` is a number, ``scale`` (1 / (d * variance)) or ``auto`` (1 / d)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toString)
    landmarks = Param(Params._dummy(), "landmarks", "number of landmark rows", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel", gamma="scale", landmarks=64):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="kernel", gamma="scale", landmarks=64)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> RbfMap:
        values = df.select(vector_to_array(F.col(self.getInputCol())).alias("_v"))
        picked = values.orderBy(F.xxhash64("_v"), "_v").limit(self.getOrDefault(self.landmarks)).collect()
        marks = np.unique(np.array([r[0] for r in picked], dtype=float), axis=0)
        width = marks.shape[1]
        gamma = self.getOrDefault(self.gamma)
        if gamma == "scale":
            spread = values.select(F.explode_outer("_v").alias("v")).agg(F.var_pop("v")).first()[0]
            gamma = 1.0 / (width * spread) if spread else 1.0
        elif gamma == "auto":
            gamma = 1.0 / width
        gamma = float(gamma)
        gaps = ((marks[:, None, :] - marks[None, :, :]) ** 2).sum(axis=2)
        values_, vectors = np.linalg.eigh(np.exp(-gamma * gaps))
        kept = values_ > 1e-10
        white = vectors[:, kept] / np.sqrt(values_[kept])
        state = json.dumps({"landmarks": marks.tolist(), "whitening": white.tolist(), "gamma": gamma})
        return RbfMap(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), state=state)


# --- classifiers --------------------------------------------------------------------------


def strength(c: float, n: int) -> float:
    """Regularisation weight that equals the inverse strength ``C`` on ``n`` rows."""
    return 1.0 / (c * n)


def logistic(n: int, c: float = 1.0, weight: str | None = None, family: str = "auto") -> LogisticRegression:
    return _weighted(
        LogisticRegression(regParam=strength(c, n), standardization=False, maxIter=200, family=family), weight
    )


def forest(
    trees: int = 300, depth: int | None = None, leaf: int = 1, subset: str = "sqrt", bootstrap: bool = True,
    weight: str | None = None, seed: int = 42,
) -> RandomForestClassifier:
    """Random forest; ``bootstrap=False`` gives trees on the whole sample. No depth means Spark's limit."""
    return _weighted(
        RandomForestClassifier(
            numTrees=trees, maxDepth=depth or 30, minInstancesPerNode=leaf, featureSubsetStrategy=subset or "all",
            bootstrap=bootstrap, seed=seed, cacheNodeIds=True,
        ),
        weight,
    )


def forest_predict(estimator: RandomForestClassifier, train: DataFrame, test: DataFrame, forest_rows: int = FOREST_ROWS) -> DataFrame:
    """Fit a forest on ``train`` and :func:`predict` ``test``, with the nodes of only a part of the trees on the driver at a time.

    Trees of a forest do not depend on each other: with many rows it is fitted in parts of so many trees that trees times rows stay below
    ``forest_rows``, each with a seed of its own, and the votes of the parts are added up with the test rows.
    """
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    size = max(1, forest_rows // max(1, train.count()))
    if size >= trees:
        return predict(estimator.fit(train), test)
    rows = test.withColumn("_votes", F.array().cast("array<double>"))
    for start in range(0, trees, size):
        model = estimator.copy({estimator.numTrees: min(size, trees - start), estimator.seed: seed + start}).fit(train)
        raw = vector_to_array("rawPrediction")
        added = F.when(F.size("_votes") == 0, raw).otherwise(F.zip_with("_votes", raw, lambda a, b: a + b))
        rows = materialise(model.transform(rows).select(*test.columns, added.alias("_votes")))
        del model
    total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
    scores = F.transform("_votes", lambda v: v / total)
    best = F.array_max(F.transform("_votes", lambda v, i: F.struct(v.alias("v"), (-i).alias("c"))))
    out = rows.withColumns({"y_pred": (-best["c"]).cast("int"), "scores": scores}).drop("_votes")
    return with_score(out)


def forest_importance(
    estimator: RandomForestClassifier, train: DataFrame, rows: int, forest_rows: int = FOREST_ROWS, parallelism: int = 2
) -> np.ndarray:
    """Importance of every feature in a forest on ``train`` (of ``rows`` rows), which with many rows is fitted in parts side by side.

    Parts, with seeds of their own, are of so many trees that the nodes of those in work stay below ``forest_rows``. A task of a deep level sends the
    bins of every node, so parts on few partitions cost less than a forest on many. A tree counts by shares that add up to 1,
    and one without a split not at all: parts are weighted by their trees that split.
    """
    trees, seed = estimator.getNumTrees(), estimator.getSeed()
    size = min(trees, max(1, forest_rows // parallelism // max(1, rows)))
    if size == trees:
        return estimator.fit(train).featureImportances.toArray()

    def part(start: int) -> np.ndarray:
        model = estimator.copy({estimator.numTrees: min(size, trees - start), estimator.seed: seed + start}).fit(train)
        return model.featureImportances.toArray() * sum(tree.depth > 0 for tree in model.trees)

    total = np.sum(run_parallel([lambda s=s: part(s) for s in range(0, trees, size)], parallelism), axis=0)
    return total / (total.sum() or 1.0)


def boosting(depth: int = 4, rate: float = 0.1, rounds: int = 20, classes: int = 2, seed: int = 42):
    trees = GBTClassifier(maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed)
    return trees if classes == 2 else OneVsRest(classifier=trees)


def linear_svm(n: int, c: float = 1.0, weight: str | None = None, classes: int = 2, input_col: str = "features"):
    svm = _weighted(
        LinearSVC(regParam=strength(c, n), standardization=False, maxIter=50, tol=1e-4, featuresCol=input_col), weight
    )
    return svm if classes == 2 else OneVsRest(classifier=svm, featuresCol=input_col)


def rbf_svm(n: int, c: float = 1.0, gamma: str = "scale", weight: str | None = None, classes: int = 2, landmarks: int = 64) -> Pipeline:
    """Support vector machine on RBF features of landmark rows: an approximation of the kernel machine."""
    return Pipeline(
        stages=[RbfFeatures(gamma=str(gamma), landmarks=landmarks), linear_svm(n, c, weight, classes, "kernel")]
    )


def poly_svm(n: int, c: float = 1.0, degree: int = 3, weight: str | None = None, classes: int = 2) -> Pipeline:
    expand = PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded")
    return Pipeline(stages=[expand, linear_svm(n, c, weight, classes, "expanded")])


def naive_bayes() -> NaiveBayes:
    return NaiveBayes(modelType="gaussian")


def _weighted(estimator, weight: str | None):
    return estimator.setWeightCol(weight) if weight else estimator


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``y_pred``, ``scores`` of all classes and ``score``.

    Scores are probabilities, else logistics of the margins; NULL for models that have neither. With two classes ``score`` is that of
    the positive one, with more that of the predicted one.
    """
    out = model.transform(df)
    if "probability" in out.columns:
        scores = vector_to_array(F.col("probability"))
    elif "rawPrediction" in out.columns:
        scores = F.transform(vector_to_array(F.col("rawPrediction")), lambda m: 1 / (1 + F.exp(-m)))
    else:
        scores = F.lit(None).cast("array<double>")
    return with_score(out.withColumns({"y_pred": F.col("prediction").cast("int"), "scores": scores}))


def with_score(out: DataFrame) -> DataFrame:
    """Score of the positive of two classes, else of the predicted class."""
    return out.withColumn("score", F.when(F.size("scores") == 2, F.get("scores", F.lit(1))).otherwise(F.get("scores", F.col("y_pred"))))


# --- tuning -------------------------------------------------------------------------------


class MacroF1(Evaluator):
    """Unweighted mean of the F1 of all classes that occur as truth or prediction."""

    def __init__(self, label: str = "label", pred: str = "prediction"):
        super().__init__()
        self.label, self.pred = label, pred

    def _evaluate(self, df: DataFrame) -> float:
        t, p = F.col(self.label), F.col(self.pred)
        pairs = df.groupBy(t.alias("t"), p.alias("p")).agg(F.count("*").alias("n")).collect()
        classes = {r["t"] for r in pairs} | {r["p"] for r in pairs}
        total = 0.0
        for c in classes:
            hit = sum(r["n"] for r in pairs if r["t"] == c and r["p"] == c)
            size = sum(r["n"] for r in pairs if r["t"] == c) + sum(r["n"] for r in pairs if r["p"] == c)
            total += 2 * hit / size if size else 0.0
        return total / len(classes) if classes else 0.0

    def isLargerBetter(self) -> bool:
        return True


def positive_f1() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)


@dataclass
class Family:
    """An estimator with its parameter grid; the grid maps a Param to its values."""

    name: str
    estimator: Estimator
    grid: list[tuple[Param, list]]

    def maps(self) -> list[dict]:
        builder = ParamGridBuilder()
        for param, values in self.grid:
            builder = builder.addGrid(param, values)
        return builder.build()


def binary_families(n: int) -> list[Family]:
    """The model space of the binary task (fixed values)."""
    gbt, lr, rf = boosting(), logistic(n), forest()
    rbf, svc = RbfFeatures(), linear_svm(n, input_col="kernel")
    line = linear_svm(n)
    return [
        Family("boosting", gbt, [(gbt.maxDepth, [4, 6, 8]), (gbt.stepSize, [0.03, 0.1]), (gbt.maxIter, [200, 400])]),
        Family("logistic", lr, [(lr.regParam, [strength(c, n) for c in (0.1, 1.0, 10.0)])]),
        Family(
            "forest", rf,
            [(rf.numTrees, [300, 600]), (rf.maxDepth, [30, 12, 24]), (rf.minInstancesPerNode, [1, 2])],
        ),
        Family("svm_linear", line, [(line.regParam, [strength(c, n) for c in (0.5, 1.0, 5.0)])]),
        Family(
            "svm_rbf", Pipeline(stages=[rbf, svc]),
            [(svc.regParam, [strength(c, n) for c in (0.5, 1.0, 5.0)]), (rbf.gamma, ["scale", "auto"])],
        ),
    ]


def device_family(n: int, costs=(0.5, 1.0, 5.0, 10.0), gammas=("scale", "auto", "0.01", "0.1", "1.0")) -> Family:
    """The model space of the per-receiver task (fixed values)."""
    rbf, svc = RbfFeatures(), linear_svm(n, input_col="kernel")
    return Family(
        "svm_rbf", Pipeline(stages=[rbf, svc]), [(svc.regParam, [strength(c, n) for c in costs]), (rbf.gamma, list(gammas))]
    )


def multiclass_families(n: int, classes: int) -> list[Family]:
    """The model space of the multiclass task (fixed values); boosting and SVM one class against the rest."""
    rf, et = forest(), forest(bootstrap=False)
    subsets, leaves = ["sqrt", "log2", "all"], [1, 2, 4]
    out = [
        Family(
            "forest", rf,
            [(rf.numTrees, [300, 600, 1000]), (rf.maxDepth, [30, 8, 12, 24]), (rf.minInstancesPerNode, leaves),
             (rf.featureSubsetStrategy, subsets)],
        ),
        Family(
            "trees_nobootstrap", et,
            [(et.numTrees, [300, 600]), (et.maxDepth, [30, 8, 12, 24]), (et.minInstancesPerNode, leaves),
             (et.featureSubsetStrategy, subsets)],
        ),
        Family("naive_bayes", naive_bayes(), []),
    ]
    for depth in (4, 6):
        for rate in (0.03, 0.07, 0.1):
            for rounds in (200, 400):
                out.append(Family(f"boosting_{depth}_{rate}_{rounds}", boosting(depth, rate, rounds, classes), []))
    for c in (0.1, 0.5, 1.0, 5.0, 10.0):
        out.append(Family(f"svm_linear_{c}", linear_svm(n, c, None, classes), []))
        out.append(Family(f"svm_poly_{c}", poly_svm(n, c, 3, None, classes), []))
        for gamma in ("scale", "auto"):
            out.append(Family(f"svm_rbf_{gamma}_{c}", rbf_svm(n, c, gamma, None, classes), []))
    return out


def tune(
    train: DataFrame, family: Family, evaluator: Evaluator, fold_column: str = "fold", folds: int = 5, parallelism: int = 4
) -> tuple[CrossValidatorModel, float, dict[str, str]]:
    """Cross-validated grid search over given folds, refitted on all rows."""
    cv = CrossValidator(
        estimator=family.estimator, estimatorParamMaps=family.maps(), evaluator=evaluator, numFolds=folds,
        foldCol=fold_column, parallelism=parallelism,
    )
    fitted = cv.fit(train)
    best = int(np.argmax(fitted.avgMetrics))
    params = {p.name: str(v) for p, v in family.maps()[best].items()}
    return fitted, float(fitted.avgMetrics[best]), params


def ranking(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    """Families by cross-validation score, best first."""
    table = spark.createDataFrame(rows, "model string, cv_score double, test_score double")
    place = F.row_number().over(Window.orderBy(F.desc("cv_score"), "model"))
    return table.withColumn("place", place)


def run_parallel(tasks: list, parallelism: int = 4) -> list:
    """Run independent fits at the same time; each is a Spark job of its own."""
    with ThreadPool(parallelism) as pool:
        return pool.map(lambda task: task(), tasks)


def importance_table(spark: SparkSession, importance: np.ndarray, names: list[str]) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, importance)]
    return spark.createDataFrame(rows, "feature string, importance double")


def importance_groups(table: DataFrame, devices: list[str]) -> DataFrame:
    """Importance summed by what the window features describe: all receivers, one, or pairs with and without the last one."""
    last = devices[-1]
    sums: dict[str, float] = {}
    for row in table.collect():
        kind, receivers = feature_scope(row["feature"])
        group = {"global": "global", "receiver": "".join(receivers)}.get(kind)
        if kind == "pair":
            group = f"pairs_with_{last}" if last in receivers else "_".join(["pair", *receivers])
        if group:
            sums[group] = sums.get(group, 0.0) + row["importance"]
    return table.sparkSession.createDataFrame(list(sums.items()), "feature_group string, importance_mass double")
