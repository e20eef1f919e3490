"""CSV records that may run over several lines, from files that stay splittable.

Whether a line break ends a record depends on the quotes of all lines before it. A line is therefore summed up as a map of two
states, outside of a quoted cell and inside of one: which state it leads to from either. Such maps compose: the state after a line
is that of the last line that leads to one state only, turned once by every later line that swaps the two. So each part of a file
is one small row, the rows of a file are composed in order, and every part learns its first state; no file is read by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.runtime import materialise

# Lines of one part.
PART_LINES = 10_000

# Cells that end on their line: quoted, with doubled quotes inside and whatever follows the closing quote; bare; empty.
_CLOSED = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
# A cell whose quote is not closed on the line.
_LEFT_OPEN = r'"[^"]*+(?:""[^"]*+)*+$'
# The rest of a cell that was open before the line.
_CLOSES = r'^[^"]*+(?:""[^"]*+)*+"[^,]*+'
OPENS = rf"^(?:{_CLOSED},)*+{_LEFT_OPEN}"
REOPENS = rf"{_CLOSES},(?:{_CLOSED},)*+{_LEFT_OPEN}"


def from_outside(line: Column) -> Column:
    """Whether a line that begins outside of a cell ends inside of one."""
    return line.rlike(OPENS)


def from_inside(line: Column) -> Column:
    """Whether a line that begins inside of a quoted cell ends inside of one."""
    return ~line.rlike(_CLOSES) | line.rlike(REOPENS)


def _turned(state: Column, swaps: Column) -> Column:
    return F.when(swaps % 2 == 1, ~state).otherwise(state)


def _composed(df: DataFrame, keys: list[str], order: str, certain: Column, swaps: Column) -> DataFrame:
    """Add ``_sure`` and ``_swaps``: the last certain state up to a row of its key, and the swaps after it (from the first row on if there is none)."""
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(swaps).over(along)
    df = df.withColumns({"_total": total, "_sure": F.last(certain, ignorenulls=True).over(along)})
    at = F.last(F.when(certain.isNotNull(), F.col("_total")), ignorenulls=True).over(along)
    return df.withColumn("_swaps", F.col("_total") - F.coalesce(at, F.lit(0))).drop("_total")


def quoted_records(lines: DataFrame, part_lines: int = PART_LINES) -> tuple[DataFrame, DataFrame]:
    """Records of all files, and the files that end inside of a quoted cell.

    ``lines`` has ``path, line_no, line``. Records come as ``path, line_no, line``: numbered from 1 in their file, their lines joined by line breaks. What follows a
    quote that is never closed is no record; its file stands in the second table, ``path, line_no`` (the line where that record begins). If no
    line leaves a cell open, lines are records and keep their numbers. Empty tables give empty ones.
    """
    lines = lines.select("path", "line_no", "line")
    none = lines.where("1 = 0")
    if lines.where(from_outside(F.col("line"))).isEmpty():
        return lines, none.select("path", "line_no")
    o, i = from_outside(F.col("line")), from_inside(F.col("line"))
    mapped = lines.withColumns({"_part": F.floor(F.col("line_no") / part_lines), "_certain": F.when(o == i, o), "_swap": (o & ~i).cast("long")})
    inner = materialise(_composed(mapped, ["path", "_part"], "line_no", F.col("_certain"), F.col("_swap")))
    ends = inner.groupBy("path", "_part").agg(F.max_by(F.struct("_sure", "_swaps"), "line_no").alias("_end"))
    # A part with a certain line leads to one state, else it keeps the states or swaps them.
    ends = ends.select("path", "_part", _turned(F.col("_end._sure"), F.col("_end._swaps")).alias("_certain"), F.col("_end._swaps").alias("_swap"))
    ends = _composed(ends.withColumn("_swap", F.when(F.col("_certain").isNull(), F.col("_swap")).otherwise(0)), ["path"], "_part", F.col("_certain"), F.col("_swap"))
    after = _turned(F.coalesce("_sure", F.lit(False)), F.col("_swaps"))
    starts = ends.select("path", "_part", F.coalesce(F.lag(after).over(Window.partitionBy("path").orderBy("_part")), F.lit(False)).alias("_first"))

    known = inner.join(starts, ["path", "_part"])
    in_part = Window.partitionBy("path", "_part").orderBy("line_no")
    leaves = _turned(F.coalesce("_sure", "_first"), F.col("_swaps"))
    known = known.withColumn("_inside", leaves).withColumn("_began_inside", F.coalesce(F.lag("_inside").over(in_part), F.col("_first")))
    known = known.withColumn("_new", (~F.col("_began_inside")).cast("long"))
    known = materialise(known.withColumn("_in_part", F.sum("_new").over(in_part)).select("path", "_part", "line_no", "line", "_new", "_in_part", "_inside"))
    counts = known.groupBy("path", "_part").agg(F.sum("_new").alias("_n"), F.max_by("_inside", "line_no").alias("_open"))
    before = Window.partitionBy("path").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    numbered = known.join(counts.select("path", "_part", "_before"), ["path", "_part"]).withColumn("_record", F.col("_before") + F.col("_in_part"))
    last = counts.groupBy("path").agg(F.max_by("_open", "_part").alias("_open"), (F.sum("_n")).alias("_record")).where("_open").select("path", "_record")
    broken = numbered.join(last, ["path", "_record"], "left_semi").groupBy("path").agg(F.min("line_no").alias("line_no"))
    whole = numbered.join(last, ["path", "_record"], "left_anti").groupBy("path", "_record").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda e: e["line"]), "\n")
    return whole.select("path", F.col("_record").alias("line_no"), text.alias("line")), broken
