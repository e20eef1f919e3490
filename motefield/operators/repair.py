"""Repair of log lines: split fused stamps, restore a damaged first row, drop broken rows.

Input is ``lines(path, line_no, line)``. Rows of a file are numbered among its non-blank
lines; only the first rows of a file look at their neighbours, so files of any size are cut
into blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.functions.text import csv_fields, has_merged_stamp, split_merged_stamp, strip
from motefield.ranking import positions
from motefield.series import SeriesLayout, close_blocks, measure, open_blocks

# The column names of a repaired log, in file order.
HEADER = [
    "logger_timestamp", "record_type", "packet_seq", "source_mac", "rssi_dbm", "rate_code", "sig_mode",
    "mcs_index", "bandwidth", "smoothing", "not_sounding", "aggregation", "stbc", "fec_coding", "sgi",
    "noise_floor_dbm", "ampdu_count", "wifi_channel", "secondary_channel", "local_timestamp", "antenna",
    "signal_length", "rx_state", "csi_len", "first_word", "csi_data",
]
FIELDS = len(HEADER)


def parse_lines(lines: DataFrame, longest: int | None = None) -> DataFrame:
    """Non-blank lines with ``row_no``, their fields and whether a fused stamp was split."""
    seen = lines.filter(F.col("line").rlike(r"\S")).withColumn("line", strip(F.col("line")))
    numbered = positions(seen, ["path"], ["line_no"], "row_no", longest=longest)
    raw = csv_fields(F.col("line"))
    return (
        numbered.withColumn("_raw", raw)
        .withColumns({"merged": has_merged_stamp(F.col("_raw")), "fields": split_merged_stamp(F.col("_raw"))})
        .drop("_raw", "line")
    )


def _is_list_cell(cell):
    bare = F.trim(F.regexp_replace(F.trim(cell), '^"(.*)"$', "$1"))
    return bare.startswith("[") & bare.endswith("]")


def repaired_rows(lines: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """Every non-blank row with its repaired fields and the flags of what happened to it."""
    if layout is None:
        layout = measure(lines, ["path"], "row_no")
    rows = parse_lines(lines, layout.longest)
    opened = open_blocks(rows, layout, 2)
    w = layout.window()
    f = F.col("fields")
    header = (
        (F.col("row_no") == 0) & (F.get(f, F.lit(0)) == HEADER[0]) & (F.get(f, F.lit(1)) == HEADER[1])
    )
    opened = opened.withColumn("is_header", F.coalesce(header, F.lit(False)))
    after_header = F.coalesce(F.lag("is_header").over(w), F.lit(False))
    first = ~F.col("is_header") & ((F.col("row_no") == 0) | ((F.col("row_no") == 1) & after_header))
    following = F.lead(f).over(w)
    whole = F.size(f) == FIELDS
    broken = ~whole | ~_is_list_cell(F.element_at(f, -1))
    fix = first & (F.size(following) == FIELDS) & (F.size(f) >= 3) & broken
    out = opened.withColumns({"_next": following, "first_repaired": F.coalesce(fix, F.lit(False))})
    out = out.withColumn(
        "fields",
        F.when(F.col("first_repaired"), F.concat(F.slice(f, 1, 3), F.slice("_next", 4, FIELDS))).otherwise(f),
    ).drop("_next")
    out = close_blocks(out, layout)
    return out.withColumn("kept", ~F.col("is_header") & (F.size("fields") == FIELDS))


def repaired_log(rows: DataFrame) -> DataFrame:
    """The kept rows with one text column per field."""
    kept = rows.filter("kept")
    return kept.select("path", "row_no", *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(HEADER)])


def dropped_rows(rows: DataFrame) -> DataFrame:
    """Rows that stay broken, for quarantine."""
    return rows.filter(~F.col("kept") & ~F.col("is_header")).select("path", "line_no", "fields")


def repair_stats(rows: DataFrame) -> DataFrame:
    """Counters per file and whether its repaired form differs."""
    stats = rows.groupBy("path").agg(
        F.count("*").alias("rows_in"),
        F.count_if(F.col("kept")).alias("kept_rows"),
        F.count_if(~F.col("kept") & ~F.col("is_header")).alias("dropped_rows"),
        F.count_if(F.col("merged")).alias("merged_rows"),
        F.bool_or("first_repaired").alias("first_row_repaired"),
        F.bool_or("is_header").alias("had_header"),
    )
    changed = (
        (F.col("merged_rows") > 0) | F.col("first_row_repaired") | (F.col("dropped_rows") > 0) | ~F.col("had_header")
    )
    return stats.withColumn("changed", changed)


def repair_summary(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("processed"), F.count_if(F.col("changed")).alias("changed"))
