"""Counts, cross tables and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.labels import binary_class, binary_name, distance
from motefield.functions.paths import device_of, label_of, person_of, recording_dir, test_number, test_of
from motefield.ranking import BUCKET, QUANTILE_ROWS, range_bucket, running_totals


def crosstab(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` x ``column``, 0 where nothing occurs."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def value_counts(df: DataFrame, column: str, distinct: str | None = None) -> DataFrame:
    aggs = [F.count("*").alias("n")]
    if distinct:
        aggs.append(F.countDistinct(distinct).alias("n_groups"))
    return df.groupBy(column).agg(*aggs)


def pivot_mean(df: DataFrame, index: list[str], column: str, values: list[str], value: str) -> DataFrame:
    return df.groupBy(*index).pivot(column, values).agg(F.avg(value))


def top(df: DataFrame, by: str, count: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.col(by).desc(), *ties).limit(count)


def with_path_meta(df: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return df.withColumns(
        {
            "person_id": person_of(p),
            "label": label_of(p),
            "test_id": test_of(p),
            "device": device_of(p),
            "recording": recording_dir(p),
        }
    )


def recording_index(files: DataFrame, devices: list[str], path: str = "path") -> DataFrame:
    """One row per recording folder with one path column per receiver.

    When a receiver has several files, the last path in sorted order is used.
    """
    meta = with_path_meta(files.select(path).distinct(), path).filter("recording is not null")
    wanted = F.array(*[F.lit(d) for d in devices])
    found = F.collect_set("device")
    rows = meta.groupBy("recording").agg(
        F.first("person_id").alias("person"),
        F.first("label").alias("source_label"),
        F.first("test_id").alias("test"),
        F.size(found).alias("n_devices"),
        F.array_join(F.array_except(wanted, found), ",").alias("missing_devices"),
        *[F.max(F.when(F.col("device") == d, F.col(path))).alias(f"{d}_path") for d in devices],
    )
    label = F.col("source_label")
    return rows.withColumns(
        {
            "binary_label": binary_class(label),
            "binary_name": binary_name(binary_class(label)),
            "distance_m": distance(label),
        }
    )


def complete_recordings(index: DataFrame) -> DataFrame:
    return index.filter(F.col("missing_devices") == "")


def incomplete_recordings(index: DataFrame) -> DataFrame:
    return index.filter(F.col("missing_devices") != "").select("recording", "missing_devices")


def observed_labels(*labels: DataFrame) -> DataFrame:
    """Every label that any of the one-column tables holds, once, with its place in sorted order from 0."""
    every = None
    for table in labels:
        own = table.toDF("label").filter("label is not null").distinct()
        every = own if every is None else every.unionByName(own)
    known = sorted(r["label"] for r in every.distinct().collect())
    return every.sparkSession.createDataFrame(list(enumerate(known)), "label_class int, label string").select("label", "label_class")


def unknown_labels(used: DataFrame, known: DataFrame) -> DataFrame:
    """Labels of a one-column table that ``known`` does not list."""
    return used.toDF("label").filter("label is not null").distinct().join(known.select("label"), "label", "left_anti")


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """Place of each name when sorted by its trailing test number, then by name."""
    along = [F.col("natural_key"), F.col(name)]
    keyed = range_bucket(df.withColumn("natural_key", test_number(F.col(name))), along, QUANTILE_ROWS)
    placed = running_totals(keyed, [], along, {"place": F.lit(1)}, BUCKET)
    return placed.select(name, "natural_key", F.col("place").cast("long").alias("place"))
