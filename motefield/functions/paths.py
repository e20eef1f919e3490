"""What a log path says about its unit: person, label, recording, device."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = 1_000_000_000


def _part(path: Column, prefix: str) -> Column:
    found = F.regexp_extract(path, f"(?:^|/)({prefix}[^/]*)", 1)
    return F.when(found != "", found).otherwise("unknown")


def person_of(path: Column) -> Column:
    return _part(path, "id_person_")


def label_of(path: Column) -> Column:
    return _part(path, "label_")


def test_of(path: Column) -> Column:
    return _part(path, "test_")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")


def device_of(path: Column) -> Column:
    """``dev<number>`` from the file name without leading zeros; NULL when absent."""
    digits = F.regexp_extract(stem(path), r"(?i)dev(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("dev"), digits.cast("int").cast("string")))


def recording_dir(path: Column) -> Column:
    """Nearest folder above the file whose name starts with ``test_``; NULL when none."""
    found = F.regexp_extract(path, "^((?:.*/)?test_[^/]*)/", 1)
    return F.when(found != "", found)


def test_number(name: Column) -> Column:
    """Trailing number of ``test_<n>``; names of another form sort last."""
    digits = F.regexp_extract(name, r"test_(\d+)$", 1)
    return F.coalesce(digits.try_cast("long"), F.lit(LAST).cast("long"))


def is_log_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(csv|data)$")
