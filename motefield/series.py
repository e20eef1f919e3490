"""How ordered series are spread over tasks.

A *series* is all rows that share ``keys``, ordered by a dense 0-based position column.
Series are usually short (hundreds of packets), but one series may hold a large part of the
data. ``SeriesLayout`` carries the measured length of the longest series and decides:

* short series: one hash partitioning by ``keys`` serves every window and aggregate;
* long series: rows are cut into blocks of ``block_rows`` positions. Rows near a block
  border are copied to the neighbouring block (a halo as wide as the operator reaches), so
  that each block is computed alone and no task ever holds a whole series.

Operators are written once against ``layout.window()`` and work in both modes.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK = "_block"
CORE = "_core"
BLOCK_ROWS = 65_536
RECORDING_ROWS = 4_000_000


@dataclass(frozen=True)
class SeriesLayout:
    keys: tuple[str, ...]
    longest: int
    order: str = "t"
    block_rows: int = BLOCK_ROWS
    # Rows of the largest recording (all its series), when measured.
    recording_rows: int | None = None

    @property
    def blocked(self) -> bool:
        return self.longest > self.block_rows

    @property
    def by(self) -> list[str]:
        return [*self.keys, BLOCK] if self.blocked else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.order)

    @property
    def recording_fits(self) -> bool:
        """Whether a whole recording may be handled by one task."""
        return not self.blocked and self.recording_rows is not None and self.recording_rows <= RECORDING_ROWS

    def with_keys(self, *keys: str) -> "SeriesLayout":
        return replace(self, keys=tuple(keys))


def longest_group(df: DataFrame, keys: list[str] | tuple[str, ...]) -> int:
    """Row count of the largest group; one map-side combined job over the key columns."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    return int(counts.agg(F.max("count")).first()[0] or 0)


def measure(
    df: DataFrame, keys: list[str], order: str = "t", block_rows: int = BLOCK_ROWS, recording: list[str] | None = None, factor: int = 1
) -> SeriesLayout:
    """Measure the longest series and, when ``recording`` is given, the largest recording.

    ``factor`` is how many rows one row of ``df`` becomes later (subcarriers per packet).
    """
    if recording is None:
        return SeriesLayout(tuple(keys), longest_group(df, keys), order, block_rows)
    per_series = df.groupBy(*keys).count()
    sizes = per_series.groupBy(*recording).agg(F.max("count").alias("longest"), F.sum("count").alias("whole"))
    row = sizes.agg(F.max("longest"), F.max("whole")).first()
    return SeriesLayout(tuple(keys), int(row[0] or 0), order, block_rows, int(row[1] or 0) * factor)


def open_blocks(df: DataFrame, layout: SeriesLayout, reach: int) -> DataFrame:
    """Add block number and halo rows for operators that look ``reach`` rows away."""
    if not layout.blocked:
        return df
    if reach >= layout.block_rows:
        raise ValueError("block_rows must exceed the reach of the operator")
    size = F.lit(layout.block_rows)
    pos = F.col(layout.order)
    own = F.floor(pos / size).cast("long")
    within = pos - own * size
    homes = F.array(
        own,
        F.when((within < reach) & (own > 0), own - 1),
        F.when(within >= size - reach, own + 1),
    )
    return (
        df.withColumn(BLOCK, F.explode_outer(F.array_compact(homes)))
        .withColumn(CORE, F.col(BLOCK) == own)
    )


def close_blocks(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Drop the halo rows again."""
    return df.filter(CORE).drop(BLOCK, CORE) if layout.blocked else df


def attach_stats(df: DataFrame, layout: SeriesLayout, **aggs: Column) -> DataFrame:
    """Attach per-series aggregates to each row of an opened frame.

    Short series use a window over the partitioning that is there anyway. Long series are
    aggregated with map-side combine; the one row per series is repeated once per block
    (n / block_rows rows) and joined on (keys, block), so a long series stays spread out.
    """
    if not layout.blocked:
        over = Window.partitionBy(*layout.keys)
        return df.withColumns({name: agg.over(over) for name, agg in aggs.items()})
    per_series = df.filter(CORE).groupBy(*layout.keys).agg(
        F.max(layout.order).alias("_last"), *[agg.alias(name) for name, agg in aggs.items()]
    )
    # One block more than the series fills: halo rows may sit in it.
    last_block = F.floor(F.col("_last") / F.lit(layout.block_rows)).cast("long") + 1
    per_block = per_series.withColumn(
        BLOCK, F.explode(F.sequence(F.lit(0).cast("long"), last_block))
    ).drop("_last")
    return df.join(per_block, layout.by, "inner")


def attach_table(df: DataFrame, layout: SeriesLayout, table: DataFrame) -> DataFrame:
    """Join one row per series to the rows of the series, block by block when series are long."""
    keys = list(layout.keys)
    if not layout.blocked:
        return df.join(table, keys, "inner")
    block = F.floor(F.col(layout.order) / F.lit(layout.block_rows)).cast("long")
    rows = df.withColumn(BLOCK, block)
    used = rows.select(*keys, BLOCK).distinct()
    return rows.join(used.join(table, keys, "inner"), [*keys, BLOCK], "inner").drop(BLOCK)
