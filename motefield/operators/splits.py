"""Train/test splits and folds by whole groups, fixed by a hash of the group and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.ranking import hashed_rank


def digest(group: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}")))


def _ranked_groups(units: DataFrame, group: str, within: list[str], seed: int) -> DataFrame:
    groups = units.select(*dict.fromkeys([group, *within])).distinct()
    return hashed_rank(groups.withColumn("_digest", digest(group, seed)), within, "_digest", [group])


def stratified_split(
    units: DataFrame, group: str, strata: list[str], share: float = 0.2, seed: int = 42
) -> DataFrame:
    """One row per group with ``role``; each stratum gives ``ceil(share * groups)`` to the test side."""
    ranked = _ranked_groups(units, group, strata, seed)
    role = F.when(F.col("rank") <= F.ceil(F.lit(share) * F.col("group_rows")), "test").otherwise("train")
    return ranked.select(group, *[s for s in strata if s != group], role.alias("role"))


def group_shuffle_split(units: DataFrame, group: str, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Split of the groups as a whole, without strata."""
    return stratified_split(units, group, [], share, seed)


def fold_table(units: DataFrame, group: str, strata: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """One row per group with its validation fold; strata are dealt out evenly."""
    ranked = _ranked_groups(units, group, strata, seed)
    return ranked.select(
        group, *[s for s in strata if s != group], ((F.col("rank") - 1) % folds).cast("int").alias("fold")
    )


def leave_one_out_sizes(units: DataFrame, holder: str) -> DataFrame:
    """Train and test sizes when each value of ``holder`` is held out once."""
    sizes = units.groupBy(holder).agg(F.count("*").alias("n_test"))
    return sizes.select(
        F.col(holder).alias("held_out"),
        (F.sum("n_test").over(Window.partitionBy()) - F.col("n_test")).alias("n_train"),
        "n_test",
    )


def leaking_groups(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups on both sides; must be empty."""
    return train.select(group).intersect(test.select(group))


def assert_no_leak(train: DataFrame, test: DataFrame, group: str) -> None:
    found = leaking_groups(train, test, group).limit(5).collect()
    if found:
        raise ValueError(f"groups in train and test: {[r[0] for r in found]}")
