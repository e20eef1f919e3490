"""Elementwise scaling and clipping against bounds fitted elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1] and clip; an empty range fails the query."""
    spread = F.when(high > low, high - low).otherwise(
        F.raise_error(F.lit("upper bound must exceed lower bound")).cast("double")
    )
    return clip((x - low) / spread, F.lit(0.0), F.lit(1.0))
