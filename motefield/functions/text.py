"""Column functions on log lines and cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the log format.
MERGED_STAMP = r"^(\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+[+-]\d{2}:\d{2})\s+([A-Z_]+)$"
RAW_FIRST_FIELD = r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}\.\d{3} [+-]\d{2}:\d{2} CSI_DATA$"
STAMP = r"^\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+[+-]\d{2}:\d{2}$"
MAC = r"^[0-9a-fA-F]{2}(?::[0-9a-fA-F]{2}){5}$"
INTEGER = r"^[+-]?\d+$"

# One field: a quoted cell up to its closing quote (or the end of the line), else up to the comma.
# Possessive groups keep the scan linear and the stack flat on cells of any length.
_FIELD = r',("[^"]*+(?:""[^"]*+)*+"?[^,]*|[^,]*)'
_QUOTED = r'^"([^"]*+(?:""[^"]*+)*+)"?([^,]*)$'


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def csv_fields(line: Column, strip_cells: bool = True) -> Column:
    """Fields of one CSV line; commas inside quotes do not separate."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))

    def clean(cell: Column) -> Column:
        bare = F.when(
            cell.startswith('"'), F.replace(F.regexp_replace(cell, _QUOTED, "$1$2"), F.lit('""'), F.lit('"'))
        ).otherwise(cell)
        return strip(bare) if strip_cells else bare

    return F.transform(cells, clean)


def has_merged_stamp(fields: Column) -> Column:
    return F.coalesce(F.get(fields, F.lit(0)).rlike(MERGED_STAMP), F.lit(False))


def split_merged_stamp(fields: Column) -> Column:
    """``<timestamp> <TYPE>`` in the first field becomes two fields."""
    first = F.get(fields, F.lit(0))
    parts = F.array(F.regexp_extract(first, MERGED_STAMP, 1), F.regexp_extract(first, MERGED_STAMP, 2))
    return F.when(has_merged_stamp(fields), F.concat(parts, F.slice(fields, F.lit(2), F.size(fields)))).otherwise(fields)


def quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def int_list_items(cell: Column) -> Column:
    """Trimmed entries of ``[a,b,…]``; NULL when the cell is not enclosed in brackets."""
    inside = cell.substr(F.lit(2), F.length(cell) - 2)
    return F.when(
        cell.startswith("[") & cell.endswith("]"),
        F.when(F.length(cell) <= 2, F.array().cast("array<string>")).otherwise(
            F.transform(F.split(inside, ","), strip)
        ),
    )


def int_list_error(cell: Column) -> Column:
    """What is wrong with an integer list cell, NULL when it is fine."""
    items = int_list_items(cell)
    bad = F.array_position(F.transform(items, lambda v: v.rlike(INTEGER)), False).cast("int")
    return F.when(items.isNull(), "no brackets").when(
        bad > 0,
        F.concat(F.lit("entry "), bad.cast("string"), F.lit(": "), quoted(F.get(items, bad - 1))),
    )


def log_timestamp(text: Column) -> Column:
    """Timestamp of a log row, NULL when it cannot be read."""
    return F.try_to_timestamp(text, F.lit("dd.MM.yyyy HH:mm:ss.SSS XXX"))
