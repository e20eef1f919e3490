"""Reading and writing of log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motefield.functions.iq import iq_amplitude, iq_array, iq_complex, complex_phase, lenient_int
from motefield.functions.paths import is_log_file
from motefield.operators.repair import HEADER
from motefield.ranking import positions
from motefield.runtime import written

FIXED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in HEADER])
INTEGER_COLUMNS = ("packet_seq", "rssi_dbm", "wifi_channel")


def number_rows(df: DataFrame, unit: str, name: str, start: int = 1) -> DataFrame:
    """Number the rows of each unit in file order.

    Files stay splittable and are read once: a row is written with its file, the byte offset of its split and its
    position in the split; the table of one small row per split, which tells where a split starts, reads those columns only.
    Needs the columns ``_file``, ``_offset`` and ``_row`` of :func:`with_origin`.
    """
    split = [unit, "_file", "_offset"]
    df = written(df, "placed-rows")
    sizes = df.groupBy(*split).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(unit).orderBy("_file", "_offset").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    placed = df.join(starts, split)
    return placed.withColumn(name, F.col("_start") + F.col("_row") - F.col("_first") + start).drop(
        "_file", "_offset", "_row", "_start", "_first"
    )


def with_origin(df: DataFrame) -> DataFrame:
    """Add where a row was read. Must directly follow the scan."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_offset"),
        F.monotonically_increasing_id().alias("_row"),
    )


def escaped(path: Column) -> Column:
    """A path without tabs or line breaks."""
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        path = F.replace(path, F.lit(plain), F.lit(code))
    return path


def unescaped(text: Column) -> Column:
    """The path of :func:`escaped`; a doubled backslash is kept apart while the others are undone."""
    apart = "\x00"
    text = F.replace(text, F.lit("\\\\"), F.lit(apart))
    for code, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), (apart, "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def read_lines(spark: SparkSession, root: str, tagged: bool = False) -> DataFrame:
    """``lines(path, line_no, line)`` of all ``.csv`` / ``.data`` logs below ``root``.

    Tagged text, as written by :func:`write_lines`, names the log before a tab in each line;
    without it every file is a log of its own.
    """
    rows = with_origin(spark.read.option("recursiveFileLookup", "true").text(root))
    if tagged:
        # The path is the first cell; its tabs and backslashes are escaped, those of the line are not.
        path = F.regexp_extract("value", r"^([^\t]*)\t", 1)
        rows = rows.withColumns({"path": unescaped(path), "value": F.expr("substring(value, instr(value, '\t') + 1)")})
    else:
        rows = rows.withColumn("path", F.col("_file"))
    numbered = number_rows(rows, "path", "line_no")
    return numbered.filter(is_log_file(F.col("path"))).select("path", "line_no", F.col("value").alias("line"))


def _by_unit(df: DataFrame, order: str) -> DataFrame:
    """Range partition so that a unit is written in order, large units in several files."""
    return df.repartitionByRange("path", order).sortWithinPartitions("path", order)


def positions_of_lines(lines: DataFrame) -> DataFrame:
    """0-based ``row_no`` of each line in its file, from line numbers that may have gaps."""
    return positions(lines, ["path"], ["line_no"], "row_no")


def write_lines(lines: DataFrame, root: str) -> None:
    """Write many logs as one table of text, each line after the path of its log and a tab."""
    _by_unit(lines, "line_no").select(F.concat(escaped(F.col("path")), F.lit("\t"), F.coalesce("line", F.lit(""))).alias("value")).write.text(root)


def write_fixed(rows: DataFrame, root: str) -> None:
    """Write repaired logs as one CSV table with header, the log's path in front; nothing is replaced."""
    ordered = _by_unit(rows, "row_no").select("path", *HEADER)
    ordered.write.option("header", "true").csv(root)


def read_fixed(spark: SparkSession, root: str, unit: str | None = None) -> DataFrame:
    """Repaired logs as text columns with ``path`` and the 0-based packet position ``t``.

    ``unit`` names the leading column that holds the path, as :func:`write_fixed` writes it;
    without it every file is a log of its own.
    """
    schema = FIXED_SCHEMA if unit is None else T.StructType([T.StructField(unit, T.StringType()), *FIXED_SCHEMA.fields])
    reader = spark.read.schema(schema).option("header", "true").option("quote", '"').option("escape", '"')
    rows = with_origin(reader.option("recursiveFileLookup", "true").csv(root))
    path = F.col(unit) if unit else F.col("_file")
    return number_rows(rows.withColumn("path", path), "path", "t", 0).filter(is_log_file(F.col("path")))


def parse_packets(rows: DataFrame) -> DataFrame:
    """Typed packets: integers, I/Q array, complex values, amplitude and phase.

    Other columns pass through. Columns nobody selects cost nothing.
    """
    typed = rows.withColumns({c: lenient_int(F.col(c)) for c in INTEGER_COLUMNS})
    typed = typed.withColumn("iq", iq_array(F.col("csi_data")))
    return typed.withColumns({"csi": iq_complex(F.col("iq")), "amplitude": iq_amplitude(F.col("iq"))}).withColumn(
        "phase", complex_phase(F.col("csi"))
    )
