"""Log sources, repair, parsing and validation on files."""

import pytest
from pyspark.sql import functions as F

from motefield.functions import iq, text
from motefield.operators import repair, validate
from motefield.operators.packets import accepted_packets, rejected_units
from motefield.operators.repair import HEADER
from motefield.series import SeriesLayout
from motefield.sources import activity, artifacts, logs

GOOD = "01.01.2024 10:00:00.000 +03:00,CSI_DATA,7,64:E8:33:57:AA:F4,-40,11,1,7,0,1,1,0,0,0,0,-96,0,6,2,1000,0,128,0,4,0"
MERGED = GOOD.replace("+03:00,CSI", "+03:00 CSI")


def line(cell="[1,2,3,4]", head=GOOD):
    return f'{head},"{cell}"'


def fields_of(spark, *lines):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    return [r[0] for r in df.orderBy("i").select(text.csv_fields(F.col("line"))).collect()]


def test_csv_fields(spark):
    got = fields_of(spark, 'a,"b,c",d', ",x,", '"say ""hi""" ,2', 'a,"open,b', 'p"q,r', "", 'x,"' + "1," * 20000 + '1"')
    assert got[:6] == [["a", "b,c", "d"], ["", "x", ""], ['say "hi"', "2"], ["a", "open,b"], ['p"q', "r"], [""]]
    assert len(got[6]) == 2 and len(got[6][1]) == 40001


def test_read_lines_keeps_order_in_small_splits(spark, tmp_path):
    folder = tmp_path / "id_person_01" / "label_00" / "test_01"
    folder.mkdir(parents=True)
    body = [f"line {i}" if i % 7 else "" for i in range(500)]
    (folder / "test1__dev1_AA.data").write_text("\r\n".join(body) + "\r\n")
    (folder / "test1__dev2_AA.DATA").write_text("only\n")
    (folder / "notes.txt").write_text("skip\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in rows:
        by_file.setdefault(r["path"].rsplit("/", 1)[1], {})[r["line_no"]] = r["line"]
    assert set(by_file) == {"test1__dev1_AA.data", "test1__dev2_AA.DATA"}
    assert [by_file["test1__dev1_AA.data"][i + 1] for i in range(500)] == body


@pytest.mark.parametrize("block_rows", [65_536, 4])
def test_repair(spark, block_rows):
    cut = line("[1,2", MERGED)
    files = {
        "a.data": [cut, line("[5,6,7,8]", MERGED), "bad,row", "", line(head=MERGED), line("[9,9,9,9]", MERGED)],
        "b.data": [",".join(HEADER), line(), line("[0,0,0,0]")],
        "c.data": [",".join(HEADER), "x,y,z,broken", line("[4,4,4,4]")],
        "d.data": ["a,b", line("[4,4,4,4]")],
    }
    rows = [(p, i + 1, s) for p, ls in files.items() for i, s in enumerate(ls)]
    df = spark.createDataFrame(rows, "path string, line_no long, line string")
    done = repair.repaired_rows(df, SeriesLayout(("path",), 6, "row_no", block_rows)).cache()
    stats = {r["path"]: r for r in repair.repair_stats(done).collect()}
    a = stats["a.data"]
    assert (a["rows_in"], a["kept_rows"], a["dropped_rows"], a["merged_rows"], a["first_row_repaired"]) == (5, 4, 1, 4, True)
    assert not stats["b.data"]["changed"] and stats["b.data"]["had_header"]
    assert stats["c.data"]["first_row_repaired"] and stats["c.data"]["kept_rows"] == 2
    # Fewer than three fields in the first row: nothing to build on, so it is dropped.
    assert stats["d.data"]["dropped_rows"] == 1 and not stats["d.data"]["first_row_repaired"]
    first = repair.repaired_log(done).filter("path = 'a.data' and row_no = 0").first()
    assert first["csi_data"] == "[5,6,7,8]" and first["packet_seq"] == "7"
    assert [r["line_no"] for r in repair.dropped_rows(done).filter("path = 'a.data'").collect()] == [3]


def test_write_and_parse_round_trip(spark, tmp_path):
    rows = [("p/x.data", i, *(GOOD.split(",")), f"[{i},{i + 1},-3,4]") for i in range(40)]
    df = spark.createDataFrame(rows, "path string, row_no long, " + ", ".join(f"{h} string" for h in HEADER))
    logs.write_fixed(df, str(tmp_path / "out"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = logs.parse_packets(logs.read_fixed(spark, str(tmp_path / "out"), "path")).orderBy("t").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["iq"][0] for r in got] == list(range(40)) and [r["t"] for r in got] == list(range(40))
    assert got[3]["amplitude"] == pytest.approx([5.0, 5.0]) and got[3]["csi"][0] == (4.0, 3.0)
    assert got[0]["packet_seq"] == 7 and got[0]["rssi_dbm"] == -40


def test_cells(spark):
    cells = ["[1, 2,+3,-4]", "[]", "[1,a]", "1,2", '"[5,6]"', None, "[1,2"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [tuple(r) for r in df.orderBy("i").select(iq.iq_array(F.col("c")), text.int_list_error(F.col("c"))).collect()]
    assert [g[0] for g in got] == [[1, 2, 3, -4], [], [1, None], None, [5, 6], None, None]
    assert got[0][1] is None and got[1][1] is None
    assert got[2][1] == "entry 2: 'a'"
    assert got[3][1] == got[6][1] == "no brackets"


def test_lenient_int_and_timestamp(spark):
    df = spark.createDataFrame([(" 12 ",), ("",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(iq.lenient_int(F.col("c"))).collect()] == [12, 0, 0, 0]
    stamp = spark.createDataFrame([("01.02.2024 10:00:00.250 +03:00",), ("no",)], "s string")
    got = stamp.select(text.log_timestamp(F.col("s")).cast("string")).collect()
    assert got[0][0] == "2024-02-01 07:00:00.25" and got[1][0] is None


def as_lines(spark, files):
    rows = [(p, i + 1, s) for p, ls in files.items() for i, s in enumerate(ls)]
    return spark.createDataFrame(rows, "path string, line_no long, line string")


def found(df):
    return {(r["path"], r["line"], r["rule"]) for r in df.collect()}


def test_raw_validation(spark):
    ref = [line(head=MERGED)] * 2
    files = as_lines(spark, {
        "ref.data": ref,
        "short.data": ref[:1],
        "broken.data": [line(head=MERGED.replace("64:E8", "zz")), "", ],
        "lists.data": [line("[1,2,3]", MERGED), line("1,2", MERGED)],
        "foreign.data": ["Привет", "x"],
    })
    structure = validate.raw_structure(files, "ref.data")
    assert (structure.csv_fields, structure.csi_values, structure.lines) == (25, 4, 2)
    assert found(validate.validate_raw(files, structure)) == {
        ("short.data", None, "row_count"),
        ("broken.data", 1, "mac"),
        ("broken.data", 2, "field_count"),
        ("lists.data", 1, "csi_length"),
        ("lists.data", 1, "declared_length"),
        ("lists.data", 2, "csi"),
        ("foreign.data", None, "ascii"),
    }
    assert ("short.data", None, "row_count") not in found(validate.validate_raw(files, structure, False))
    with pytest.raises(ValueError):
        validate.raw_structure(files, "absent.data")


def test_fixed_validation(spark):
    head = ",".join(HEADER)
    files = as_lines(spark, {
        "ref.data": [head, line(), line()],
        "head.data": [head.replace("antenna", "aerial"), "x"],
        "rows.data": [head, line(head=GOOD.replace("CSI_DATA", "OTHER"))],
        "ints.data": [head, line(head=GOOD.replace(",-40,", ",?,")), line(head=GOOD.replace("01.01.2024", "1.1.2024"))],
    })
    structure = validate.fixed_structure(files, "ref.data")
    assert structure.rows == 2 and structure.csi_values == 4
    assert found(validate.validate_fixed(files, structure)) == {
        ("head.data", 1, "header"),
        ("rows.data", None, "row_count"),
        ("rows.data", 2, "record_type"),
        ("ints.data", 2, "integer"),
        ("ints.data", 3, "timestamp"),
    }
    report = validate.problem_report(validate.validate_fixed(files, structure), 1).collect()
    assert len(report) == 1 and report[0]["path"] == "head.data" and report[0]["hidden_files"] == 2


def test_rejected_units(spark):
    rows = [("ok", [1, 2]), ("ok", [3, 4]), ("odd", [1, 2, 3]), ("mixed", [1, 2]), ("mixed", [1, 2, 3, 4]), ("bad", None), ("bad2", [1, None])]
    df = spark.createDataFrame(rows, "path string, iq array<int>")
    assert {r["path"]: r["reason"] for r in rejected_units(df, "path").collect()} == {
        "odd": "odd csi_data length",
        "mixed": "inconsistent subcarrier count",
        "bad": "invalid csi_data",
        "bad2": "invalid csi_data",
    }
    assert {r["path"] for r in accepted_packets(df, "path").collect()} == {"ok"}


def test_activity_files(spark, tmp_path):
    for view, name in (("front", "jump"), ("side", "standing")):
        d = tmp_path / view / name
        d.mkdir(parents=True)
        cells = ["[" + ",".join(["1"] * 128) + "]"] * 3 + ["[" + ",".join(["2"] * 384) + "]", ""]
        body = ["type,sig_mode,data"] + [f'CSI_DATA,1,"{c}"' if c else "CSI_DATA,1," for c in cells] + ['OTHER,1,"[1,2]"']
        (d / "one.csv").write_text("\n".join(body) + "\n")
    rows = activity.read_activity(spark, str(tmp_path), ["front", "side"])
    assert rows.count() == 12
    parsed = activity.parse_activity(rows).orderBy("view", "row_no").collect()
    assert [(r["view"], r["activity"], r["row_no"], len(r["amplitude"])) for r in parsed] == [
        (v, a, i, 52) for v, a in (("front", "jump"), ("side", "standing")) for i in range(3)
    ]
    files = rows.select("file", "activity").distinct()
    assert {r[0]: r[1] for r in activity.file_counts(files, ["jump", "waving"]).collect()} == {"jump": 1, "waving": 0}


def test_metadata_with_mixed_parameter_types(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "model": "SVM",\n "best_params": {"C": 10.0, "gamma": 0.1},\n "best_cv_score_f1": 0.5}')
    (tmp_path / "b.json").write_text('{"model": "SVM", "best_params": {"C": 1.0, "gamma": "scale"}}')
    got = {r["best_params"]["gamma"] for r in artifacts.load_metadata(spark, str(tmp_path / "*.json")).collect()}
    assert got == {"0.1", "scale"}


def test_paths_with_tabs_and_backslashes_come_back(spark, tmp_path):
    paths = ["a\tb.data", "a\\tb.data", "a\\\\\tb.data", "plain.data", "line\nbreak.data"]
    lines = spark.createDataFrame([(p, i, f"l{i}\tx\\t") for p in paths for i in (1, 2)], "path string, line_no long, line string")
    logs.write_lines(lines, f"{tmp_path}/out")
    got = logs.read_lines(spark, f"{tmp_path}/out", tagged=True)
    assert sorted(map(tuple, got.collect())) == sorted((p, i, f"l{i}\tx\\t") for p in paths for i in (1, 2))
    assert got._jdf.queryExecution().toString().count("FileScan text") == 0
