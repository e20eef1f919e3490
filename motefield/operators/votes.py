"""Combining file predictions into one prediction per group of receivers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binary(pred: str) -> Column:
    ok = F.col(pred).isin(0, 1)
    return F.when(ok, F.col(pred)).otherwise(
        F.raise_error(F.concat(F.lit("prediction outside 0/1: "), F.col(pred).cast("string"))).cast("int")
    )


def _majority_or_one(pred: Column) -> Column:
    """1 when at least half of the votes are 1."""
    return (F.sum(pred) * 2 >= F.count(pred)).cast("int")


def vote_of_three(preds: DataFrame, group: str, pred: str = "pred", devices: int = 3) -> DataFrame:
    """Groups with exactly one prediction of every receiver; at least two of three decide."""
    votes = preds.groupBy(group).agg(
        F.sum(_binary(pred)).alias("ones"), F.countDistinct("device").alias("_d"), F.count("*").alias("_n")
    )
    full = votes.filter((F.col("_d") == devices) & (F.col("_n") == devices))
    return full.select(group, "ones", (F.col("ones") * 2 > devices).cast("int").alias("pred"))


def device_votes(files: DataFrame, group: str, pred: str) -> DataFrame:
    """First level: one binary vote per group and receiver, ties count as 1."""
    return files.groupBy(group, "device").agg(
        _majority_or_one(_binary(pred)).alias("pred"), F.count("*").alias("n_files")
    )


def vote_binary(
    files: DataFrame, group: str, devices: list[str], pred: str = "pred", complete: bool = False
) -> DataFrame:
    """Files to receiver votes to group vote, ties count as 1 on both levels.

    An absent receiver has a NULL column; ``complete`` keeps only groups with all receivers.
    """
    votes = device_votes(files, group, pred)
    picks = [F.max(F.when(F.col("device") == d, F.col("pred"))).alias(f"pred_{d}") for d in devices]
    out = votes.groupBy(group).agg(
        _majority_or_one(F.col("pred")).alias("pred"),
        F.count("*").alias("n_devices"),
        F.sum("n_files").alias("n_files"),
        *picks,
    )
    return out.filter(F.col("n_devices") == len(devices)) if complete else out


def majority(counts: DataFrame, keys: list[str], pred: str, n: str) -> DataFrame:
    """Most frequent class, ties to the smallest, with the count of every class."""
    return counts.groupBy(*keys).agg(
        F.max_by(pred, F.struct(F.col(n), -F.col(pred))).alias("pred"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(pred), F.col(n))))).alias("vote_counts"),
        F.sum(n).alias("n_votes"),
    )


def vote_multiclass(files: DataFrame, group: str, pred: str = "pred") -> DataFrame:
    counts = files.groupBy(group, pred).agg(F.count("*").alias("_n"))
    return majority(counts, [group], pred, "_n")


def vote_multiclass_two_level(files: DataFrame, group: str, devices: list[str], pred: str = "pred") -> DataFrame:
    """Receiver vote, then group vote, for groups with all receivers."""
    first = majority(
        files.groupBy(group, "device", pred).agg(F.count("*").alias("_n")), [group, "device"], pred, "_n"
    )
    full = first.groupBy(group).agg(F.countDistinct("device").alias("_d")).filter(F.col("_d") == len(devices))
    counts = first.join(full, group, "left_semi").groupBy(group, "pred").agg(F.count("*").alias("_n"))
    return majority(counts, [group], "pred", "_n")


def vote_summary(voted: DataFrame, files: DataFrame) -> DataFrame:
    """How many groups were voted on, and how many receivers and files there are."""
    sides = files.agg(F.countDistinct("device").alias("n_models"), F.count("*").alias("n_files"))
    counted = voted.agg(F.count("*").alias("n_groups"))
    return counted.withColumn("_one", F.lit(1)).join(sides.withColumn("_one", F.lit(1)), "_one").drop("_one")


def mixed_truth(files: DataFrame, group: str, truth: str) -> DataFrame:
    """Groups whose files do not agree on the true class; must be empty before voting."""
    return files.groupBy(group).agg(F.countDistinct(truth).alias("n_true")).filter(F.col("n_true") > 1)


def assert_single_truth(files: DataFrame, group: str, truth: str) -> None:
    found = mixed_truth(files, group, truth).limit(5).collect()
    if found:
        raise ValueError(f"groups with more than one true class: {[r[0] for r in found]}")


def counts_text(counts: Column) -> Column:
    """Vote counts as ``class:count`` pairs."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(counts)),
            lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string")),
        ),
        ",",
    )
