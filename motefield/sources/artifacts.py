"""Saving and loading what training produces, one folder per receiver.

``<root>/<device>/bundle``     JSON row: widths, bounds, feature columns, k_95
``<root>/<device>/embedding``  Spark ML pipeline (standardise, PCA, cut)
``<root>/<device>/model``      Spark ML pipeline of the classifier
``<root>/<device>/metadata``   JSON row: model, parameters, score, split
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BUNDLE = T.StructType(
    [
        T.StructField("esp_id", T.StringType()),
        T.StructField("median_width", T.IntegerType()),
        T.StructField("global_min", T.DoubleType()),
        T.StructField("global_max", T.DoubleType()),
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("feature_min", T.ArrayType(T.DoubleType())),
        T.StructField("feature_max", T.ArrayType(T.DoubleType())),
        T.StructField("k_95", T.IntegerType()),
        T.StructField("model_type", T.StringType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("selection", T.StringType()),
        T.StructField("esp_id", T.StringType()),
        # A parameter may be a number or a word ("scale"), so all are kept as text.
        T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
        T.StructField("best_cv_score_f1", T.DoubleType()),
        T.StructField("split", T.StringType()),
        T.StructField("class_mapping", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass
class Artifact:
    bundle: dict
    embedding: PipelineModel
    model: PipelineModel
    metadata: dict


def save_artifact(spark: SparkSession, root: str, artifact: Artifact) -> str:
    path = f"{root}/{artifact.bundle['esp_id']}"
    for name, schema, row in (("bundle", BUNDLE, artifact.bundle), ("metadata", METADATA, artifact.metadata)):
        spark.createDataFrame([{f.name: row.get(f.name) for f in schema.fields}], schema).coalesce(1).write.json(
            f"{path}/{name}"
        )
    artifact.embedding.write().save(f"{path}/embedding")
    artifact.model.write().save(f"{path}/model")
    return path


def load_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Bundle rows of all receivers below ``root``."""
    return spark.read.schema(BUNDLE).json(f"{root}/*/bundle")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows; a file of another tool may span several lines."""
    return spark.read.schema(METADATA).option("multiLine", "true").json(path)


def load_artifact(spark: SparkSession, root: str, device: str) -> Artifact:
    path = f"{root}/{device}"
    bundle = spark.read.schema(BUNDLE).json(f"{path}/bundle").first().asDict()
    metadata = load_metadata(spark, f"{path}/metadata").first().asDict()
    return Artifact(
        bundle, PipelineModel.load(f"{path}/embedding"), PipelineModel.load(f"{path}/model"), metadata
    )
