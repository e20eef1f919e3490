"""Order-dependent totals (row numbers, running sums, exact quantiles) without hot tasks.

A plain ``row_number() over (partition by key order by x)`` puts all rows of a key into one
task. Here the order is cut into buckets by a monotone bucket number. Totals per
(key, bucket) are small; their running sum gives each bucket its start value, and the rows
are only ever ordered inside one (key, bucket).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.runtime import materialise
from motefield.series import BLOCK_ROWS, longest_group

BUCKET = "_bucket"
# Hex digits of a digest that make its bucket.
DIGITS = 5
# Groups up to this size are given to the built-in exact ``percentile``.
QUANTILE_ROWS = 1_000_000


def hash_bucket(hex_digest: Column) -> Column:
    """Leading hex digits as a number: a million even buckets, monotone in the digest, whatever the number of rows."""
    return F.conv(F.substring(hex_digest, 1, DIGITS), 16, 10).cast("long")


def range_bucket(df: DataFrame, order: list[Column], bucket_rows: int, total: int | None = None) -> DataFrame:
    """Add a bucket number that does not decrease along ``order``, about ``bucket_rows`` rows each.

    Ranges are cut on all order columns together, so rows that share the first one are spread by the next. The table is computed once,
    as a bucket is the place of a row in that one layout.
    """
    total = df.count() if total is None else total
    wanted = math.ceil(total / bucket_rows)
    if wanted <= 1:
        return df.withColumn(BUCKET, F.lit(0))
    return materialise(df.repartitionByRange(wanted, *order).withColumn(BUCKET, F.spark_partition_id()))


def value_bucket(df: DataFrame, column: str, bucket_rows: int, total: int | None = None) -> DataFrame:
    """Add a bucket number monotone in a numeric column, about ``bucket_rows`` rows each if its values are distinct.

    ``total`` is the row count (or a larger number) when the caller knows it.
    """
    total = df.count() if total is None else total
    wanted = math.ceil(total / bucket_rows)
    marks: list[float] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        found = df.select(F.col(column).cast("double").alias("_v")).approxQuantile(
            "_v", shares, 0.25 / wanted
        )
        marks = sorted(set(found))
    splits = [-math.inf, *[m for m in marks if math.isfinite(m)], math.inf]
    with_value = df.withColumn("_v", F.col(column).cast("double"))
    if len(splits) == 2:
        return with_value.withColumn(BUCKET, F.lit(0)).drop("_v")
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol=BUCKET, handleInvalid="keep")
    return cut.transform(with_value).withColumn(BUCKET, F.col(BUCKET).cast("int")).drop("_v")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    measures: dict[str, Column],
    bucket: str | None = None,
) -> DataFrame:
    """Add ``<name>`` (inclusive running sum) and ``<name>_total`` for each measure.

    With ``bucket`` the named column must not decrease along ``order``; every bucket is then
    ordered on its own. Without it one window per key is used, which suits groups known
    to be small.
    """
    if bucket is None:
        along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        whole = Window.partitionBy(*keys)
        return df.withColumns(
            {name: F.sum(m).over(along) for name, m in measures.items()}
            | {f"{name}_total": F.sum(m).over(whole) for name, m in measures.items()}
        )
    parts = df.groupBy(*keys, bucket).agg(
        *[F.sum(m).alias(f"_part_{name}") for name, m in measures.items()]
    )
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = parts.select(
        *keys,
        bucket,
        *[F.coalesce(F.sum(f"_part_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in measures],
        *[F.sum(f"_part_{n}").over(whole).alias(f"{n}_total") for n in measures],
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = df.join(starts, [*keys, bucket], "inner").withColumns(
        {name: F.col(f"_start_{name}") + F.sum(m).over(inside) for name, m in measures.items()}
    )
    return out.drop(*[f"_start_{n}" for n in measures])


def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str = "t", block_rows: int = BLOCK_ROWS, longest: int | None = None
) -> DataFrame:
    """Dense 0-based position of each row in its series, in the order of ``order``.

    ``longest`` is the length of the longest series when it is known.
    """
    if (longest_group(df, keys) if longest is None else longest) <= block_rows:
        along = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(along) - 1).cast("long"))
    along = [F.col(c) for c in order]
    cut = range_bucket(df, along, block_rows)
    ranked = running_totals(cut, keys, along, {"_rank": F.lit(1)}, BUCKET)
    return ranked.withColumn(name, (F.col("_rank") - 1).cast("long")).drop(
        "_rank", "_rank_total", BUCKET
    )


def hashed_rank(df: DataFrame, keys: list[str], digest: str, ties: list[str]) -> DataFrame:
    """Add ``rank`` (1-based, by digest inside ``keys``) and ``group_rows``.

    The digest is uniform, so its leading digits cut any group evenly, however large; rows need not be counted first.
    """
    cut = df.withColumn(BUCKET, hash_bucket(F.col(digest)))
    ranked = running_totals(
        cut, keys, [F.col(digest), *[F.col(c) for c in ties]], {"rank": F.lit(1)}, BUCKET
    )
    return ranked.withColumnRenamed("rank_total", "group_rows").drop(BUCKET)


def percentiles(value: str, shares: dict[str, float]) -> Column:
    """All wanted percentiles by one aggregate, which keeps one table of values per group."""
    return F.percentile(value, F.array(*[F.lit(float(p)) for p in shares.values()])).alias("_shares")


def spread_percentiles(df: DataFrame, shares: dict[str, float]) -> DataFrame:
    found = {name: F.get("_shares", F.lit(i)) for i, name in enumerate(shares)}
    return df.withColumns(found).drop("_shares")


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    shares: dict[str, float],
    largest: int | None = None,
    limit: int = QUANTILE_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Small groups use the built-in aggregate. Beyond ``limit`` rows per group the values are
    counted, ordered in buckets, and the rows at the wanted ranks are picked.
    """
    if largest is None:
        largest = longest_group(df, keys)
    if largest <= limit:
        return spread_percentiles(df.groupBy(*keys).agg(percentiles(value, shares)), shares)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    cut = value_bucket(counted, value, limit)
    run = running_totals(cut, keys, [F.col(value)], {"_upto": F.col("_c")}, BUCKET)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    picks = {}
    for name, p in shares.items():
        place = (F.col("_upto_total") - 1) * F.lit(float(p))
        picks[name] = (place, F.floor(place), F.ceil(place))
    wanted = None
    for _, low, high in picks.values():
        hit = low.between(first, last) | high.between(first, last)
        wanted = hit if wanted is None else wanted | hit
    chosen = run.filter(wanted)
    ends = [F.max("_upto_total").alias("_n")]
    for name, (_, low, high) in picks.items():
        ends.append(F.max(F.when(low.between(first, last), F.col(value))).alias(f"_low_{name}"))
        ends.append(F.max(F.when(high.between(first, last), F.col(value))).alias(f"_high_{name}"))
    edge = chosen.groupBy(*keys).agg(*ends)
    out = []
    for name, p in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return edge.select(*keys, *out)


def summarise(
    df: DataFrame,
    keys: list[str],
    aggs: list[Column],
    value: str,
    shares: dict[str, float],
    largest: int | None = None,
    limit: int = QUANTILE_ROWS,
) -> DataFrame:
    """Mergeable aggregates and exact quantiles of ``value`` in one table.

    One aggregation when every group is small, otherwise two that are joined on the keys
    (one row per group on each side).
    """
    if largest is None:
        largest = longest_group(df, keys)
    if largest <= limit:
        return spread_percentiles(df.groupBy(*keys).agg(*aggs, percentiles(value, shares)), shares)
    base = df.groupBy(*keys).agg(*aggs)
    spots = quantiles(df, keys, value, shares, largest, limit)
    if not keys:
        return base.withColumn("_one", F.lit(1)).join(spots.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return base.join(spots, keys, "inner")
