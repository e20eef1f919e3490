"""The second log format: CSV with ``type``, ``sig_mode`` and ``data``, one folder per activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motefield.functions.iq import cell_length, drop_null_positions, iq_amplitude, iq_array
from motefield.sources.logs import number_rows, with_origin

SCHEMA = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("sig_mode", T.IntegerType()), T.StructField("data", T.StringType())]
)


def read_activity(spark: SparkSession, root: str, views: list[str], schema: T.StructType = SCHEMA) -> DataFrame:
    """Rows of ``root/<view>/<activity>/*.csv`` with ``file``, ``view``, ``activity`` and ``row_no``."""
    glob = f"{root}/{{{','.join(views)}}}/*/*.csv"
    rows = with_origin(spark.read.schema(schema).option("header", "true").option("escape", '"').csv(glob))
    rows = rows.withColumn("file", F.col("_file"))
    parts = F.split("file", "/")
    return number_rows(rows, "file", "row_no", 0).withColumns(
        {"view": F.element_at(parts, -3), "activity": F.element_at(parts, -2)}
    )


def keep_valid(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("type") == "CSI_DATA") & F.col("data").isNotNull())


def with_sig_mode(rows: DataFrame, mode: int = 1) -> DataFrame:
    return rows.filter(F.col("sig_mode") == mode) if "sig_mode" in rows.columns else rows


def with_cells(rows: DataFrame) -> DataFrame:
    """Rows with a non-empty cell and its ``length``, which is counted without parsing."""
    return rows.withColumn("length", cell_length(F.col("data"))).filter(F.col("length") > 0)


def modal_length(rows: DataFrame, file: str = "file") -> DataFrame:
    """Most frequent cell length per file, ties to the shorter."""
    counts = rows.groupBy(file, "length").agg(F.count("*").alias("n"))
    return counts.groupBy(file).agg(
        F.max_by("length", F.struct(F.col("n"), -F.col("length"))).alias("length"), F.max("n").alias("n")
    )


def keep_modal_length(rows: DataFrame, file: str = "file") -> DataFrame:
    """Rows of the most frequent length; the other side has one row per file."""
    return rows.join(modal_length(rows, file).select(file, "length"), [file, "length"], "left_semi")


def parse_activity(rows: DataFrame, mode: int = 1) -> DataFrame:
    """Valid rows of one length per file, silent positions removed, with amplitude."""
    kept = keep_modal_length(with_cells(with_sig_mode(keep_valid(rows), mode)))
    clean = kept.withColumn("iq", drop_null_positions(iq_array(F.col("data"))))
    return clean.withColumn("amplitude", iq_amplitude(F.col("iq"))).drop("data", "length")


def file_counts(files: DataFrame, activities: list[str]) -> DataFrame:
    """Number of files per listed activity, 0 for activities without files."""
    counts = files.agg(*[F.count_if(F.col("activity") == a).alias(f"n{i}") for i, a in enumerate(activities)])
    entry = [F.struct(F.lit(a).alias("activity"), F.col(f"n{i}").alias("n_files")) for i, a in enumerate(activities)]
    return counts.select(F.explode(F.array(*entry)).alias("_e")).select("_e.*")
