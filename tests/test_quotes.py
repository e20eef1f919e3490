"""Records over several lines against Python's csv reader."""

import csv
import random

import pytest

from motefield.operators import validate
from motefield.sources.quotes import quoted_records


def made_files(seed, n=60):
    rng = random.Random(seed)
    cells = ["a", "", "1", '"x"', '"x,y"', '"say ""hi"""', '"', '""', '"open', 'end"', 'p"q', '"two\nlines"', '"a\n\n,b"', '"""', '"x"y', '"x"y"', " ", '","']
    return {f"f{k}": "\n".join(",".join(rng.choice(cells) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))) for k in range(n)}


def read(text):
    """Records by Python's reader, and the line at which one begins that is still open at the end."""
    lines = text.split("\n")
    rows, ends = [], []
    reader = csv.reader(line + "\n" for line in lines)
    for row in reader:
        rows.append(row)
        ends.append(reader.line_num)
    first = 1 if len(ends) < 2 else ends[-2] + 1
    try:
        list(csv.reader((line + "\n" for line in lines), strict=False))
        tail = list(csv.reader(line + "\n" for line in [*lines, "zz,zz"]))
        unfinished = len(tail) == len(rows)
    except csv.Error:
        unfinished = True
    return (rows[:-1], first) if unfinished else (rows, None)


@pytest.mark.parametrize("part_lines", [1, 2, 3, 10_000])
def test_records_equal_the_csv_module(spark, part_lines):
    """However the lines of a file are dealt to parts."""
    files = made_files(part_lines)
    table = [(p, i, line) for p, text in files.items() for i, line in enumerate(text.split("\n"), 1)]
    lines = spark.createDataFrame(table, "path string, line_no long, line string").repartition(5)
    records, broken = quoted_records(lines, part_lines)
    got = {}
    for r in records.orderBy("path", "line_no").collect():
        assert r.line_no == len(got.setdefault(r.path, [])) + 1
        got[r.path].append(next(csv.reader(part + "\n" for part in r.line.split("\n"))) if r.line else [])
    ends = {r.path: r.line_no for r in broken.collect()}
    want = {p: read(text) for p, text in files.items()}
    assert got == {p: rows for p, (rows, _) in want.items() if rows} and ends == {p: at for p, (_, at) in want.items() if at is not None}
    assert 5 < len(ends) < 55 and any("\n" in c for rows, _ in want.values() for row in rows for c in row)


def test_lines_without_open_cells_keep_their_numbers(spark):
    lines = spark.createDataFrame([("a", 3, 'x,"y"'), ("a", 7, "")], "path string, line_no long, line string")
    records, broken = quoted_records(lines)
    assert sorted(map(tuple, records.collect())) == [("a", 3, 'x,"y"'), ("a", 7, "")] and broken.count() == 0
    assert all(t.count() == 0 for t in quoted_records(lines.where("1 = 0")))


def test_unclosed_quote_is_a_problem_of_the_file(spark):
    head = "01.01.2024 10:00:00.000 +03:00 CSI_DATA,7,64:E8:33:57:AA:F4"
    good, two = f'{head},4,"[1,2,3,4]"', f'{head},4,"[1,2,\n3,4]"'
    files = {"good.data": [good, good], "lines.data": [*two.split("\n"), good], "open.data": [good, f'{head},4,"[1,2,3,4]', "more"], "foreign.data": ["é", f'{head},4,"[1']}
    table = [(p, i, line) for p, own in files.items() for i, line in enumerate(own, 1)]
    lines = spark.createDataFrame(table, "path string, line_no long, line string")
    found = validate.validate_raw(lines, validate.RawStructure(5, 4, 2))
    assert sorted((r.path, r.line, r.rule, r.found) for r in found.collect()) == [("foreign.data", None, "ascii", None), ("open.data", None, "csv", "open from line 2")]
