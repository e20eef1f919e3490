"""Checks of log files against the structure of a reference file.

Problems are rows ``(path, line, rule, field, expected, found)``; ``line`` is NULL for a whole file, ``field`` names the
cell (raw logs: its number from 1) or is NULL for a whole line.
Input is ``lines(path, line_no, line)`` with every line of the file, blank ones included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.functions import text as tx
from motefield.runtime import lookup_join, materialise
from motefield.sources.quotes import quoted_records

TEXT_COLUMNS = ("logger_timestamp", "record_type", "source_mac", "csi_data")


@dataclass(frozen=True)
class RawStructure:
    csv_fields: int
    csi_values: int
    lines: int

    @property
    def metadata_fields(self) -> int:
        return self.csv_fields - 1


@dataclass(frozen=True)
class FixedStructure:
    header: tuple[str, ...]
    rows: int
    csi_values: int


def data_files(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("path").endswith(".data"))


def _split(lines: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    fields = F.when(F.col("line") == "", empty).otherwise(tx.csv_fields(F.col("line"), strip_cells=False))
    return lines.select("path", "line_no", "line", fields.alias("f"))


def _records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed records, read once, and the problem of files that a CSV reader cannot finish: a quote that is never closed."""
    records, broken = quoted_records(materialise(lines.select("path", "line_no", "line")))
    return materialise(_split(records)), _file_problem(broken, "csv", "closed quote", F.concat(F.lit("open from line "), F.col("line_no").cast("string")))


def infer_raw(lines: DataFrame, reference: str) -> DataFrame:
    """Field count, value count of the first row and line count of the reference file."""
    ref = _split(lines.filter(F.col("path") == reference))
    first = F.min_by("f", "line_no")
    return ref.agg(
        F.size(first).alias("csv_fields"),
        F.size(tx.int_list_items(F.element_at(first, -1))).alias("csi_values"),
        F.count("*").alias("lines"),
    )


def raw_structure(lines: DataFrame, reference: str) -> RawStructure:
    row = infer_raw(lines, reference).first()
    if not row["lines"]:
        raise ValueError(f"reference file is empty: {reference}")
    return RawStructure(row["csv_fields"], row["csi_values"], row["lines"])


def infer_fixed(lines: DataFrame, reference: str) -> DataFrame:
    """Header, data row count and value count of the first data row of the reference file."""
    ref = _split(lines.filter(F.col("path") == reference))
    header = F.min_by("f", "line_no")
    # The first data row is the smallest line number after the header line.
    second = F.min_by(F.when(F.col("line_no") > 1, F.col("f")), F.when(F.col("line_no") > 1, F.col("line_no")))
    facts = ref.agg(header.alias("header"), second.alias("_row"), (F.count("*") - 1).alias("rows"))
    place = F.array_position("header", "csi_data").cast("int")
    return facts.select(
        "header", "rows", F.size(tx.int_list_items(F.get("_row", place - 1))).alias("csi_values")
    )


def fixed_structure(lines: DataFrame, reference: str) -> FixedStructure:
    row = infer_fixed(lines, reference).first()
    if row["header"] is None:
        raise ValueError(f"reference file is empty: {reference}")
    if "csi_data" not in row["header"]:
        raise ValueError("header does not contain csi_data column")
    if row["rows"] < 1:
        raise ValueError("reference file has only a header")
    return FixedStructure(tuple(row["header"]), row["rows"], row["csi_values"])


PROBLEM = ("rule", "field", "expected", "found")


def _problem(rule: str, field: str | None, expected: str | Column, found: Column | None) -> Column:
    values = (rule, field, expected, found)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("string").alias(n) for n, v in zip(PROBLEM, values)])


def _rule(broken: Column, rule: str, field: str | None, expected: str | Column, found: Column | None) -> Column:
    """A problem entry when ``broken`` holds, else NULL."""
    return F.when(F.coalesce(broken, F.lit(True)), _problem(rule, field, expected, found))


def _text(number: Column) -> Column:
    return number.cast("string")


def _emit(rows: DataFrame, size: Column, wanted: int, checks: list[Column], list_checks: list[Column], cell: Column) -> DataFrame:
    """A row of another width reports only that; a broken list cell hides the checks on its length."""
    width = _rule(size != wanted, "field_count", None, str(wanted), _text(size))
    error = tx.int_list_error(cell)
    broken = F.when(error.isNotNull(), _problem("csi", None, "integers in brackets", error))
    found = F.when(size != wanted, F.array(width)).otherwise(
        F.concat(
            F.array(*checks, broken),
            F.when(error.isNull(), F.array(*list_checks)).otherwise(F.array().cast("array<struct<rule:string,field:string,expected:string,found:string>>")),
        )
    )
    exploded = rows.select("path", F.col("line_no").alias("line"), F.explode_outer(F.array_compact(found)).alias("_p"))
    return exploded.filter(F.col("_p").isNotNull()).select("path", "line", "_p.*")


def _file_problem(df: DataFrame, rule: str, expected: str, found: Column | None = None, line: int | None = None) -> DataFrame:
    problem = _problem(rule, None, expected, found).alias("_p")
    return df.select("path", F.lit(line).cast("long").alias("line"), problem).select("path", "line", "_p.*")


def _not_ascii(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").rlike(r"[^\x00-\x7F]")).select("path").distinct()


def validate_raw(lines: DataFrame, structure: RawStructure, check_line_count: bool = True) -> DataFrame:
    # Text is read and parsed once; all checks look at that table.
    source = lines
    lines, unreadable = _records(lines)
    rows = lines
    f = F.col("f")
    size, n, meta = F.size(f), structure.csv_fields, structure.metadata_fields
    get = lambda i: F.get(f, F.lit(i))
    checks = [
        _rule(
            ~get(0).rlike(tx.RAW_FIRST_FIELD), "first_field", "1", "stamp and type", get(0)
        ),
        _rule(~get(2).rlike(tx.MAC), "mac", "3", "hardware address", get(2)),
    ]
    for i in range(1, meta):
        if i != 2:
            checks.append(
                _rule(~get(i).rlike(tx.INTEGER), "integer", str(i + 1), "integer", get(i))
            )
    cell = get(n - 1)
    actual = F.size(tx.int_list_items(cell))
    declared = get(meta - 2)
    list_checks = [
        _rule(actual != structure.csi_values, "csi_length", None, str(structure.csi_values), _text(actual)),
        _rule(
            F.when(declared.rlike(r"^\d+$"), declared.try_cast("long") != actual).otherwise(False),
            "declared_length", None, declared, _text(actual),
        ),
    ]
    found = _with_file_problems(lines, _emit(rows, size, n, checks, list_checks, cell), structure.lines, check_line_count, 0)
    return _or_unreadable(found, unreadable, source)


def validate_fixed(lines: DataFrame, structure: FixedStructure, check_row_count: bool = True) -> DataFrame:
    # Text is read and parsed once; all checks look at that table.
    source = lines
    lines, unreadable = _records(lines)
    rows = lines
    f = F.col("f")
    header = structure.header
    where = {name: i for i, name in enumerate(header)}
    get = lambda name: F.get(f, F.lit(where[name]))
    checks = [
        _rule(
            ~get("logger_timestamp").rlike(tx.STAMP), "timestamp", "logger_timestamp", "stamp", get("logger_timestamp")
        ),
        _rule(
            get("record_type") != "CSI_DATA", "record_type", "record_type", "CSI_DATA", get("record_type")
        ),
        _rule(~get("source_mac").rlike(tx.MAC), "mac", "source_mac", "hardware address", get("source_mac")),
    ]
    for name in header:
        if name not in TEXT_COLUMNS:
            checks.append(
                _rule(~get(name).rlike(tx.INTEGER), "integer", name, "integer", get(name))
            )
    cell = get("csi_data")
    actual = F.size(tx.int_list_items(cell))
    list_checks = [
        _rule(actual != structure.csi_values, "csi_length", None, str(structure.csi_values), _text(actual))
    ]
    if "csi_len" in where:
        declared = get("csi_len")
        list_checks.append(
            _rule(
                F.when(declared.rlike(tx.INTEGER), declared.try_cast("long") != actual).otherwise(False),
                "declared_length", None, _text(declared.try_cast("long")), _text(actual),
            )
        )
    expected = F.array(*[F.lit(h) for h in header])
    heads = rows.filter("line_no = 1")
    wrong = heads.filter(f != expected)
    wrong_problems = _file_problem(wrong, "header", "reference header", line=1)
    body = _emit(rows.filter("line_no > 1"), F.size(f), len(header), checks, list_checks, cell)
    found = _with_file_problems(lines, body, structure.rows, check_row_count, 1)
    # A file with another header reports only that (unless it could not be read as text at all).
    found = lookup_join(found.filter("rule <> 'ascii'"), wrong.select("path"), ["path"], "left_anti").unionByName(
        found.filter("rule = 'ascii'")
    )
    return _or_unreadable(found.unionByName(wrong_problems.join(_not_ascii(lines), "path", "left_anti")), unreadable, source)


def _or_unreadable(found: DataFrame, unreadable: DataFrame, source: DataFrame) -> DataFrame:
    """A file that cannot be parsed to its end reports only that, unless it is not ASCII text, which is seen first."""
    if unreadable.isEmpty():
        return found
    foreign = _not_ascii(source)
    rest = lookup_join(found.filter("rule <> 'ascii'"), unreadable.select("path"), ["path"], "left_anti")
    ascii_ = _file_problem(foreign, "ascii", "ASCII text")
    return lookup_join(rest, foreign, ["path"], "left_anti").unionByName(ascii_).unionByName(lookup_join(unreadable, foreign, ["path"], "left_anti"))


def _with_file_problems(
    lines: DataFrame, body: DataFrame, wanted: int, check_count: bool, header_rows: int
) -> DataFrame:
    """Add whole-file problems; a file that is not ASCII reports only that."""
    if check_count:
        sizes = lines.groupBy("path").agg((F.count("*") - header_rows).alias("_n")).filter(F.col("_n") != wanted)
        body = body.unionByName(
            _file_problem(sizes, "row_count", str(wanted), _text(F.col("_n")))
        )
    foreign = _not_ascii(lines)
    return lookup_join(body, foreign, ["path"], "left_anti").unionByName(
        _file_problem(foreign, "ascii", "ASCII text")
    )


def problem_report(problems: DataFrame, max_files: int) -> DataFrame:
    """Problem counts of the first ``max_files`` paths with the totals of the whole run."""
    per_file = problems.groupBy("path").agg(F.count("*").alias("n_problems"))
    totals = per_file.agg(F.count("*").alias("files"), F.sum("n_problems").alias("problems")).first()
    shown = per_file.orderBy("path").limit(max_files)
    return shown.withColumns(
        {
            "total_files": F.lit(totals["files"]).cast("long"),
            "total_problems": F.lit(totals["problems"] or 0).cast("long"),
            "hidden_files": F.lit(max(totals["files"] - max_files, 0)).cast("long"),
        }
    )
