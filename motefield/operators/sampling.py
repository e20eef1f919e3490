"""Sampling by turns over groups, fixed by a hash of the row id and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.ranking import BUCKET, hashed_rank, running_totals
from motefield.series import BLOCK_ROWS


def round_robin_sample(
    df: DataFrame, row_id: str, group: str, n: int | None, seed: int | Column = 42, by: list[str] | None = None
) -> DataFrame:
    """Take rows in turns from the sorted groups until ``n`` are taken (per ``by`` class).

    Row ``r`` of a shuffled group is taken in round ``r``; the place of a row in the order
    (round, group) decides, so no task sorts the whole table. Fewer than ``n`` rows, or
    ``n=None``, keep everything. Adds ``turn``, the 1-based place.
    """
    by = by or []
    seed_text = seed if isinstance(seed, Column) else F.lit(seed)
    shuffled = df.withColumn(
        "_digest", F.md5(F.concat(F.col(row_id).cast("string"), F.lit(":"), seed_text.cast("string")))
    )
    ranked = hashed_rank(shuffled, [*by, group], "_digest", [row_id]).drop("_digest", "group_rows")
    rounds = ranked.withColumn(BUCKET, F.floor(F.col("rank") / BLOCK_ROWS))
    order = [F.col("rank"), F.col(group)]
    placed = running_totals(rounds, by, order, {"turn": F.lit(1)}, BUCKET).drop("turn_total", "rank", BUCKET)
    return placed if n is None else placed.filter(F.col("turn") <= n)


def balanced_sample(
    df: DataFrame, row_id: str, label_class: str, group: str, cap: int | None = None, seed: int = 42, balance: bool = True
) -> DataFrame:
    """As many rows of each class as the smallest class has (at most ``cap``), by turns over ``group``."""
    target = cap
    if balance:
        least = int(df.groupBy(label_class).count().agg(F.min("count")).first()[0])
        target = least if cap is None else min(least, cap)
    return round_robin_sample(df, row_id, group, target, F.lit(seed) + F.col(label_class), [label_class])
