"""Queries on log text: repair, validation, parsing, path metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog.common import r6
from motefield.catalog.registry import query
from motefield.catalog.views import DEVICES, PACKETS_SQL, lines, lines_sql, log_path, packets
from motefield.functions import iq, labels, paths
from motefield.functions import text as tx
from motefield.operators import packets as packet_ops
from motefield.operators import repair, reports, validate
from motefield.operators.repair import HEADER
from motefield.runtime import new_table_path
from motefield.sources import activity, logs

LINES = lines_sql()

# --- repair -------------------------------------------------------------------------------

PARSED = LINES + r""",
cells as (select path, line_no, regexp_extract_all(','||trim(line), ',("[^"]*(?:""[^"]*)*"?[^,]*|[^,]*)', 1) as cells, line from lines where trim(line)<>''),
parsed as (select path, line_no, row_number() over (partition by path order by line_no)-1 as row_no,
  list_transform(cells, lambda c: trim(case when c[1]='"' then replace(regexp_replace(c, '^"([^"]*(?:""[^"]*)*)"?([^,]*)$', '\1\2'), '""', '"') else c end)) as raw
  from cells),
split_rows as (select path, line_no, row_no, raw,
  regexp_matches(raw[1], '^\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+[+-]\d{2}:\d{2}\s+[A-Z_]+$') as merged from parsed),
normal as (select path, line_no, row_no, merged,
  case when merged then list_concat([regexp_extract(raw[1], '^(.*\S)\s+([A-Z_]+)$', 1), regexp_extract(raw[1], '^(.*\S)\s+([A-Z_]+)$', 2)], raw[2:]) else raw end as f
  from split_rows)"""
REPAIRED = PARSED + """,
flagged as (select *, row_no=0 and f[1]='logger_timestamp' and f[2]='record_type' as is_header from normal),
firsts as (select *, not is_header and (row_no=0 or (row_no=1 and coalesce(lag(is_header) over w, false))) as is_first,
  lead(f) over w as nxt from flagged window w as (partition by path order by row_no)),
fixing as (select *, coalesce(is_first and len(nxt)=26 and len(f)>=3 and (len(f)<>26 or not (f[len(f)][1]='[' and right(f[len(f)],1)=']')), false) as first_repaired from firsts),
fixed as (select path, line_no, row_no, merged, is_header, first_repaired,
  case when first_repaired then list_concat(f[1:3], nxt[4:26]) else f end as f from fixing),
repaired as (select *, not is_header and len(f)=26 as kept from fixed)"""
STATS = """stats as (select path, count(*) as rows_in, count(*) filter (where kept) as kept_rows, count(*) filter (where not kept and not is_header) as dropped_rows,
  count(*) filter (where merged) as merged_rows, bool_or(first_repaired) as first_row_repaired, bool_or(is_header) as had_header from repaired group by 1),
changed_stats as (select *, merged_rows>0 or first_row_repaired or dropped_rows>0 or not had_header as changed from stats)"""


@query("scan_log_lines", f"with {LINES} select path, cast(line_no as bigint) as line_no, line from lines")
def scan_log_lines(spark, sf_dir):
    """The lines are written as log folders and read back with their line numbers."""
    root = new_table_path(spark, "logs")
    logs.write_lines(lines(spark, sf_dir), root)
    return logs.read_lines(spark, root, tagged=True)


@query("line_fields", f"with {PARSED} select path, row_no, len(raw) as n_fields, raw[1] as first_field, raw[len(raw)] as last_field from parsed")
def line_fields(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("f", tx.csv_fields(tx.strip(F.col("line"))))
    numbered = logs.positions_of_lines(rows)
    return numbered.select(
        "path", "row_no", F.size("f").cast("long").alias("n_fields"), F.get("f", F.lit(0)).alias("first_field"),
        F.element_at("f", -1).alias("last_field"),
    )


@query("split_merged_ts", f"with {PARSED} select path, row_no, merged, len(f) as n_fields, f[1] as stamp, f[2] as record_type from normal")
def split_merged_ts(spark, sf_dir):
    rows = repair.parse_lines(lines(spark, sf_dir))
    return rows.select(
        "path", "row_no", "merged", F.size("fields").cast("long").alias("n_fields"),
        F.get("fields", F.lit(0)).alias("stamp"), F.get("fields", F.lit(1)).alias("record_type"),
    )


@query("first_row_repair", f"with {REPAIRED} select path, row_no, f[3] as packet_seq, f[4] as source_mac, f[26] as csi_data from repaired where first_repaired")
def first_row_repair(spark, sf_dir):
    rows = repair.repaired_rows(lines(spark, sf_dir)).filter("first_repaired")
    f = lambda i: F.get("fields", F.lit(i))
    return rows.select("path", "row_no", f(2).alias("packet_seq"), f(3).alias("source_mac"), f(25).alias("csi_data"))


@query("repair_log", f"with {REPAIRED} select path, row_no, {', '.join(f'f[{i + 1}] as {n}' for i, n in enumerate(HEADER))} from repaired where kept")
def repair_log(spark, sf_dir):
    return repair.repaired_log(repair.repaired_rows(lines(spark, sf_dir)))


@query("repair_stats", f"with {REPAIRED}, {STATS} select * from changed_stats")
def repair_stats(spark, sf_dir):
    return repair.repair_stats(repair.repaired_rows(lines(spark, sf_dir)))


@query("repair_summary", f"with {REPAIRED}, {STATS} select count(*) as processed, count(*) filter (where changed) as changed from changed_stats")
def repair_summary(spark, sf_dir):
    return repair.repair_summary(repair.repair_stats(repair.repaired_rows(lines(spark, sf_dir))))


# --- validation ---------------------------------------------------------------------------

RAW_REFERENCE = "root/id_person_02/label_00/test_4/test4__dev2_AA_BB.data"


@query("infer_structure", f"""with {PARSED} select len(raw) as csv_fields, len(string_split(raw[len(raw)], ',')) as csi_values,
 (select count(*) from lines where path='{RAW_REFERENCE}') as lines from parsed where path='{RAW_REFERENCE}' and row_no=0""".replace(
     "len(raw) as", "cast(len(raw) as int) as").replace("len(string_split(raw[len(raw)], ','))", "cast(len(string_split(raw[len(raw)], ',')) as int)"))
def infer_structure(spark, sf_dir):
    return validate.infer_raw(lines(spark, sf_dir), RAW_REFERENCE)


INT = r"'^[+-]?\d+$'"
LIST_ERROR = r"""case when not (cell[1]='[' and right(cell,1)=']') then 'no brackets'
  when list_position(list_transform(items, lambda v: regexp_matches(v, '^[+-]?\d+$')), false) > 0
  then 'entry '||list_position(list_transform(items, lambda v: regexp_matches(v, '^[+-]?\d+$')), false)||': '''||
       items[list_position(list_transform(items, lambda v: regexp_matches(v, '^[+-]?\d+$')), false)]||'''' end"""
ITEMS = "list_transform(string_split(substr(cell, 2, len(cell)-2), ','), lambda v: trim(v))"

RAW_RULES = r"""rows_ as (select path, line_no, raw as f, raw[len(raw)] as cell from parsed where path like '%.data'),
checked as (select *, {items} as items from rows_),
err as (select *, {error} as error, len(f)<>25 as wide from checked),
problems as (
  select path, line_no as line, 'field_count' as rule, null::varchar as field, '25' as expected, cast(len(f) as varchar) as found from err where wide
  union all select path, line_no, 'first_field', '1', 'stamp and type', f[1] from err
    where not wide and not regexp_matches(f[1], '^\d{{2}}\.\d{{2}}\.\d{{4}} \d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}} [+-]\d{{2}}:\d{{2}} CSI_DATA$')
  union all select path, line_no, 'mac', '3', 'hardware address', f[3] from err where not wide and not regexp_matches(f[3], '^[0-9a-fA-F]{{2}}(:[0-9a-fA-F]{{2}}){{5}}$')
  union all select path, line_no, 'integer', cast(i+1 as varchar), 'integer', f[i+1] from err, unnest(generate_series(1, 23)) as g(i)
    where not wide and i<>2 and not regexp_matches(f[i+1], '^[+-]?\d+$')
  union all select path, line_no, 'csi', null, 'integers in brackets', error from err where not wide and error is not null
  union all select path, line_no, 'csi_length', null, '64', cast(len(items) as varchar) from err where not wide and error is null and len(items)<>64
  union all select path, line_no, 'declared_length', null, f[23], cast(len(items) as varchar) from err
    where not wide and error is null and regexp_matches(f[23], '^\d+$') and try_cast(f[23] as bigint)<>len(items)
  union all select path, null, 'row_count', null, '20', cast(count(*) as varchar) from rows_ group by path having count(*)<>20)""".format(
    items=ITEMS, error=LIST_ERROR
)


def raw_problems(spark, sf_dir):
    files = validate.data_files(lines(spark, sf_dir))
    return validate.validate_raw(files, validate.raw_structure(files, RAW_REFERENCE))


@query("validate_raw", f"with {PARSED}, {RAW_RULES} select path, cast(line as bigint) as line, rule, field, expected, found from problems")
def validate_raw(spark, sf_dir):
    return raw_problems(spark, sf_dir)


@query("problem_report", f"""with {PARSED}, {RAW_RULES}
select path, count(*) as n_problems, (select count(distinct path) from problems) as total_files, (select count(*) from problems) as total_problems,
 greatest((select count(distinct path) from problems)-10, 0) as hidden_files from problems group by path order by path limit 10""")
def problem_report(spark, sf_dir):
    return validate.problem_report(raw_problems(spark, sf_dir), 10)


# Repaired logs of all receivers with damage that follows from position and recording.
def damaged_fixed(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("path", F.regexp_replace(log_path(), "DATA$", "data"))
    code = (F.col("t") + F.col("recording_id") * 3) % 40

    def hurt(number, bad, good):
        return F.when(code == number, bad).otherwise(good)

    whole = F.concat(F.lit("["), F.array_join("iq", ","), F.lit("]"))
    n2 = F.lpad(F.col("t").cast("string"), 2, "0")
    cell = hurt(
        17, F.array_join("iq", ","),
        hurt(18, F.concat(F.lit("[q,"), F.array_join(F.slice("iq", 2, 63), ","), F.lit("]")),
             hurt(19, F.concat(F.lit("["), F.array_join(F.slice("iq", 1, 63), ","), F.lit("]")), whole)),
    )
    fields = [
        F.concat(F.lit("01.01.2024 10:00:"), n2, hurt(13, F.lit(""), F.lit(".000")), F.lit(" +03:00")),
        hurt(14, F.lit("OTHER"), F.lit("CSI_DATA")), F.col("vec_id").cast("string"),
        hurt(15, F.lit("64:E8"), F.lit("64:E8:33:57:AA:F4")), hurt(16, F.lit("x1"), F.col("rssi").cast("string")),
        *[F.lit("0")] * 18, hurt(20, F.lit("63"), F.lit("64")), F.lit("0"), F.concat(F.lit('"'), cell, F.lit('"')),
    ]
    text = F.when(code == 21, F.concat_ws(",", *fields[:5], *fields[6:])).otherwise(F.concat_ws(",", *fields))
    body = p.select("path", (F.col("t") + 2).alias("line_no"), text.alias("line"))
    head = F.when(F.col("recording_id") % 5 == 4, ",".join(HEADER).replace("csi_len", "length")).otherwise(",".join(HEADER))
    first = p.filter("t = 0").select("path", F.lit(1).cast("long").alias("line_no"), head.alias("line"))
    return body.unionByName(first)


def _damaged_sql() -> str:
    zeros = "||','||".join(["'0'"] * 18)
    head = ",".join(HEADER)
    return (
        PACKETS_SQL
        + f""",
dp as (select *, 'root/'||person_id||'/'||label||'/test_'||recording_id||'/test'||recording_id||'__'||device||'_AA_BB.data' as path,
  (t+recording_id*3)%40 as code from packets),
dcell as (select *, case when code=17 then array_to_string(iq, ',') when code=18 then '[q,'||array_to_string(iq[2:64], ',')||']'
   when code=19 then '['||array_to_string(iq[1:63], ',')||']' else '['||array_to_string(iq, ',')||']' end as cell,
  '01.01.2024 10:00:'||lpad(cast(t as varchar),2,'0')||case when code=13 then '' else '.000' end||' +03:00' as stamp from dp),
lines as (
  select path, t+2 as line_no, stamp||','||case when code=14 then 'OTHER' else 'CSI_DATA' end||','||vec_id||','||
    case when code=15 then '64:E8' else '64:E8:33:57:AA:F4' end||','||case when code=16 then 'x1' else cast(rssi as varchar) end||','||
    case when code=21 then {"||','||".join(["'0'"] * 17)} else {zeros} end||','||case when code=20 then '63' else '64' end||',0,'||'"'||cell||'"' as line from dcell
  union all select path, 1, case when recording_id%5=4 then '{head.replace("csi_len", "length")}' else '{head}' end from dp where t=0)"""
    )


DAMAGED = _damaged_sql() + r""",
parsed as (select path, line_no, list_transform(regexp_extract_all(','||line, ',("[^"]*(?:""[^"]*)*"?[^,]*|[^,]*)', 1),
  lambda c: case when c[1]='"' then replace(regexp_replace(c, '^"([^"]*(?:""[^"]*)*)"?([^,]*)$', '\1\2'), '""', '"') else c end) as f from lines)"""
FIXED_REFERENCE = "root/id_person_01/label_00/test_0/test0__dev1_AA_BB.data"


@query("infer_structure_fixed", f"""with {DAMAGED} select (select array_to_string(f, ',') from parsed where path='{FIXED_REFERENCE}' and line_no=1) as header,
 cast((select count(*)-1 from parsed where path='{FIXED_REFERENCE}') as bigint) as rows,
 (select cast(len(string_split(f[26], ',')) as int) from parsed where path='{FIXED_REFERENCE}' and line_no=2) as csi_values""")
def infer_structure_fixed(spark, sf_dir):
    out = validate.infer_fixed(damaged_fixed(spark, sf_dir), FIXED_REFERENCE)
    return out.withColumn("header", F.array_join("header", ","))


INT_COLUMNS = [(i, n) for i, n in enumerate(HEADER) if n not in validate.TEXT_COLUMNS]
FIXED_RULES = r"""heads as (select path, array_to_string(f, ',')=(select array_to_string(f, ',') from parsed where path='{ref}' and line_no=1) as good from parsed where line_no=1),
rows_ as (select p.path, p.line_no, f, f[len(f)] as cell from parsed p join heads h on h.path=p.path and h.good where line_no>1),
checked as (select *, {items} as items from rows_),
err as (select *, {error} as error, len(f)<>26 as wide from checked),
problems as (
  select path, 1 as line, 'header' as rule, null::varchar as field, 'reference header' as expected, null::varchar as found from heads where not good
  union all select path, line_no, 'field_count', null, '26', cast(len(f) as varchar) from err where wide
  union all select path, line_no, 'timestamp', 'logger_timestamp', 'stamp', f[1] from err
    where not wide and not regexp_matches(f[1], '^\d{{2}}\.\d{{2}}\.\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}\s+[+-]\d{{2}}:\d{{2}}$')
  union all select path, line_no, 'record_type', 'record_type', 'CSI_DATA', f[2] from err where not wide and f[2]<>'CSI_DATA'
  union all select path, line_no, 'mac', 'source_mac', 'hardware address', f[4] from err where not wide and not regexp_matches(f[4], '^[0-9a-fA-F]{{2}}(:[0-9a-fA-F]{{2}}){{5}}$')
  {ints}
  union all select path, line_no, 'csi', null, 'integers in brackets', error from err where not wide and error is not null
  union all select path, line_no, 'csi_length', null, '64', cast(len(items) as varchar) from err where not wide and error is null and len(items)<>64
  union all select path, line_no, 'declared_length', null, f[24], cast(len(items) as varchar) from err
    where not wide and error is null and try_cast(f[24] as bigint)<>len(items)
  union all select path, null, 'row_count', null, '20', cast(count(*) as varchar) from rows_ group by path having count(*)<>20)""".format(
    ref=FIXED_REFERENCE,
    items=ITEMS,
    error=LIST_ERROR,
    ints="\n".join(
        f"union all select path, line_no, 'integer', '{n}', 'integer', f[{i + 1}] from err where not wide and not regexp_matches(f[{i + 1}], {INT})"
        for i, n in INT_COLUMNS
    ),
)


@query("validate_fixed", f"with {DAMAGED}, {FIXED_RULES} select path, cast(line as bigint) as line, rule, field, expected, found from problems")
def validate_fixed(spark, sf_dir):
    files = damaged_fixed(spark, sf_dir)
    return validate.validate_fixed(files, validate.fixed_structure(files, FIXED_REFERENCE))


@query("csi_int_list", f"""with {DAMAGED}, c as (select path, line_no, f[len(f)] as cell from parsed where line_no>1),
i as (select *, {ITEMS} as items from c)
select path, line_no, case when cell[1]='[' then cast(len(items) as int) end as n_values, {LIST_ERROR} as error from i""")
def csi_int_list(spark, sf_dir):
    f = tx.csv_fields(F.col("line"), strip_cells=False)
    rows = damaged_fixed(spark, sf_dir).filter("line_no > 1").withColumn("cell", F.element_at(f, -1))
    items = tx.int_list_items(F.col("cell"))
    return rows.select(
        "path", "line_no", F.when(items.isNotNull(), F.size(items)).alias("n_values"), tx.int_list_error(F.col("cell")).alias("error")
    )


@query("unit_accept", f"""with {DAMAGED}, c as (select path, f[len(f)] as cell from parsed where line_no>1),
i as (select *, {ITEMS} as items, {LIST_ERROR.replace('items[', ITEMS + '[').replace('list_transform(items', 'list_transform(' + ITEMS)} as error from c),
uu as (select path, max(case when error is not null then 1 else 0 end) as bad, max(case when error is null and len(items)%2=1 then 1 else 0 end) as odd,
  min(len(items)) filter (where error is null and len(items)%2=0) as lo, max(len(items)) filter (where error is null and len(items)%2=0) as hi from i group by 1)
select path, case when bad=1 then 'invalid csi_data' when odd=1 then 'odd csi_data length' else 'inconsistent subcarrier count' end as reason
from uu where bad=1 or odd=1 or lo<>hi""")
def unit_accept(spark, sf_dir):
    f = tx.csv_fields(F.col("line"), strip_cells=False)
    rows = damaged_fixed(spark, sf_dir).filter("line_no > 1").withColumn("iq", iq.iq_array(F.element_at(f, -1)))
    return packet_ops.rejected_units(rows, "path")


# --- parsing ------------------------------------------------------------------------------


@query("packet_parse", f"""with {REPAIRED},
k as (select path, row_number() over (partition by path order by row_no)-1 as t, f from repaired where kept),
v as (select path, t, f, list_transform(string_split(substr(f[26], 2, len(f[26])-2), ','), lambda x: cast(x as int)) as iq from k)
select path, t, cast(f[3] as int) as packet_seq, cast(f[5] as int) as rssi_dbm, cast(f[18] as int) as wifi_channel, f[20] as local_timestamp,
  cast(len(iq)//2 as int) as n_subcarriers, round((select sum(sqrt(cast(iq[2*k+1]**2+iq[2*k+2]**2 as double))) from unnest(generate_series(0,31)) as g(k)),4) as amplitude_sum,
  round((select sum(atan2(cast(iq[2*k+1] as double), cast(iq[2*k+2] as double))) from unnest(generate_series(0,31)) as g(k)),4) as phase_sum
from v""")
def packet_parse(spark, sf_dir):
    """Repair, write the fixed logs, read them back and parse the packets."""
    root = new_table_path(spark, "fixed")
    logs.write_fixed(repair.repaired_log(repair.repaired_rows(lines(spark, sf_dir))), root)
    parsed = logs.parse_packets(logs.read_fixed(spark, root, "path"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return parsed.select(
        "path", "t", "packet_seq", "rssi_dbm", "wifi_channel", "local_timestamp", F.size("amplitude").alias("n_subcarriers"),
        F.round(total("amplitude"), 4).alias("amplitude_sum"), F.round(total("phase"), 4).alias("phase_sum"),
    )


@query("lenient_int", """select event_id, event_type, coalesce(try_cast(trim(regexp_extract(props, '([0-9]+)', 1)||case when event_id%3=0 then 'x' else ' ' end) as int), 0) as k,
 coalesce(try_cast(event_type as int), 0) as none from events""")
def lenient_int(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.regexp_extract("props", "([0-9]+)", 1), F.when(F.col("event_id") % 3 == 0, "x").otherwise(" "))
    return ev.select("event_id", "event_type", iq.lenient_int(text).alias("k"), iq.lenient_int(F.col("event_type")).alias("none"))


# --- second format ------------------------------------------------------------------------


def activity_rows(spark, sf_dir):
    """Packets in the second format: two lengths, other record types, missing cells."""
    p = packets(spark, sf_dir)
    v = F.col("vec_id")
    long_cell = F.array_join(F.flatten(F.array_repeat("iq", 6)), ",")
    short_cell = F.array_join(F.flatten(F.array_repeat("iq", 2)), ",")
    body = F.when(v % 5 == 0, long_cell).otherwise(short_cell)
    return p.select(
        F.concat_ws("/", F.col("device"), F.col("recording_id").cast("string")).alias("file"),
        v.alias("row_no"),
        F.when(v % 11 == 3, "OTHER").otherwise("CSI_DATA").alias("type"),
        F.when(v % 4 == 0, 0).otherwise(1).alias("sig_mode"),
        F.when(v % 13 != 5, F.concat(F.lit("["), body, F.lit("]"))).alias("data"),
        "recording_id",
    )


ACTIVITY = PACKETS_SQL + """,
act as (select device||'/'||recording_id as file, vec_id as row_no, case when vec_id%11=3 then 'OTHER' else 'CSI_DATA' end as type,
  case when vec_id%4=0 then 0 else 1 end as sig_mode,
  case when vec_id%13<>5 then case when vec_id%5=0 then list_concat(iq,iq,iq,iq,iq,iq) else list_concat(iq,iq) end end as raw from packets),
good as (select * from act where type='CSI_DATA' and raw is not null and sig_mode=1),
modal as (select file, arg_max(length, n*1000-length) as length, max(n) as n from (select file, len(raw) as length, count(*) as n from good group by 1,2) group by 1)"""
NULL_LIST = str(iq.NULL_POSITIONS)


@query("modal_length", f"with {ACTIVITY} select file, cast(length as int) as length, n from modal")
def modal_length(spark, sf_dir):
    rows = activity.with_sig_mode(activity.keep_valid(activity_rows(spark, sf_dir)))
    return activity.modal_length(activity.with_cells(rows))


@query("alt_packet_parse", f"""with {ACTIVITY},
k as (select g.file, row_no, raw from good g join modal m on m.file=g.file and m.length=len(raw)),
x as (select file, row_no, i, v from (select file, row_no, len(raw) as n, cast(generate_subscripts(raw,1)-1 as int) as i, unnest(raw) as v from k)
  where not list_contains(case when n=128 then {NULL_LIST}[1:24] else {NULL_LIST} end, i)),
p as (select *, row_number() over (partition by file, row_no order by i)-1 as j from x)
select file, row_no, cast(j//2 as int) as sc, round(sqrt(cast(sum(v*v) as double)),6) as amplitude from p group by 1,2,3""")
def alt_packet_parse(spark, sf_dir):
    out = activity.parse_activity(activity_rows(spark, sf_dir))
    return iq.exploded(out, ["file", "row_no"], F.col("amplitude"), "sc", "amplitude").select("file", "row_no", "sc", r6("amplitude"))


ACTIVITIES = labels.STATIC_ACTIVITIES + labels.MACRO_ACTIVITIES


@query("label_file_counts", f"""with {PACKETS_SQL}, f as (select distinct device, recording_id from packets),
a as (select unnest({ACTIVITIES}) as activity, unnest([0,1,2,3,4,5,6,7]) as i)
select activity, count(recording_id) as n_files from a left join f on recording_id%7=i group by 1""")
def label_file_counts(spark, sf_dir):
    names = F.array(*[F.lit(a) for a in ACTIVITIES])
    files = packets(spark, sf_dir).select("device", "recording_id").distinct()
    return activity.file_counts(files.withColumn("activity", F.get(names, F.col("recording_id") % 7)), ACTIVITIES)


# --- paths and labels ---------------------------------------------------------------------

PATHS = PACKETS_SQL + """,
paths as (select distinct person_id, label, recording_id, device, 'root/'||case when recording_id%3=2 then 'x' else person_id end||'/'||label||'/test_'||recording_id||
  '/test'||recording_id||'__'||replace(device, 'dev', case when device='dev2' then 'DEV0' else 'dev' end)||'_AA.data' as path from packets)"""


def odd_paths(spark, sf_dir):
    rec = F.col("recording_id").cast("string")
    person = F.when(F.col("recording_id") % 3 == 2, "x").otherwise(F.col("person_id"))
    device = F.regexp_replace("device", "dev2", "DEV02")
    return packets(spark, sf_dir).select(
        F.concat(
            F.lit("root/"), person, F.lit("/"), F.col("label"), F.lit("/test_"), rec, F.lit("/test"), rec, F.lit("__"), device, F.lit("_AA.data")
        ).alias("path")
    ).distinct()


@query("path_meta", f"""with {PATHS} select path, case when recording_id%3=2 then 'unknown' else person_id end as person_id, label, 'test_'||recording_id as test_id,
 device, regexp_replace(path, '/[^/]*$', '') as recording from paths""")
def path_meta(spark, sf_dir):
    return reports.with_path_meta(odd_paths(spark, sf_dir))


@query("natural_order", f"""with {PACKETS_SQL}, n as (select distinct 'test_'||recording_id||case when recording_id%5=2 then '_4b' else '' end as name,
  case when recording_id%5=2 then 1000000000 else recording_id end as key from packets)
select name, cast(key as bigint) as natural_key, row_number() over (order by key, name) as place from n""")
def natural_order(spark, sf_dir):
    rec = F.col("recording_id").cast("string")
    suffix = F.when(F.col("recording_id") % 5 == 2, "_4b").otherwise("")
    names = packets(spark, sf_dir).select(F.concat(F.lit("test_"), rec, suffix).alias("name")).distinct()
    return reports.natural_order(names, "name")


@query("recording_index", f"""with {PATHS}, d as (select distinct recording_id, person_id, label, device, path from paths where not (recording_id%4=1 and device='dev2')),
i as (select recording_id, count(distinct device) as n_devices, max(case when device='dev1' then path end) as dev1_path, max(case when device='dev2' then path end) as dev2_path,
  max(case when device='dev3' then path end) as dev3_path, max(path) as any_path, max(label) as label from d group by 1)
select regexp_replace(any_path, '/[^/]*$', '') as recording, case when recording_id%3=2 then 'unknown' else 'id_person_0'||(1+(recording_id//4)%4) end as person, label as source_label,
  'test_'||recording_id as test, cast(n_devices as int) as n_devices, case when dev2_path is null then 'dev2' else '' end as missing_devices, dev1_path, dev2_path, dev3_path,
  cast(recording_id%4>0 as int) as binary_label, case when recording_id%4>0 then 'motion' else 'no_motion' end as binary_name, recording_id%4 as distance_m from i""")
def recording_index(spark, sf_dir):
    """Recordings of label 1 have no second receiver in this listing."""
    listed = odd_paths(spark, sf_dir).filter(~(F.col("path").contains("label_01") & F.col("path").contains("DEV02")))
    return reports.recording_index(listed, DEVICES)


@query("label_map", f"""with {PACKETS_SQL}, a as (select distinct recording_id, label from packets)
select recording_id, label, cast(label<>'label_00' as int) as binary_class, case when label='label_00' then 'no_motion' else 'motion' end as binary_name,
 cast(right(label,1) as int) as distance_m, {ACTIVITIES}[1+recording_id%8] as activity, cast(recording_id%8>=2 as int) as activity_class,
 case when recording_id%3=0 then 'near' else 'class_'||recording_id%3 end as class_name from a""")
def label_map(spark, sf_dir):
    names = F.array(*[F.lit(a) for a in ACTIVITIES])
    rows = packets(spark, sf_dir).select("recording_id", "label").distinct()
    activity_name = F.get(names, F.col("recording_id") % 8)
    return rows.select(
        "recording_id", "label", labels.binary_class(F.col("label")).alias("binary_class"),
        labels.binary_name(labels.binary_class(F.col("label"))).alias("binary_name"), labels.distance(F.col("label")).alias("distance_m"),
        activity_name.alias("activity"), labels.activity_class(activity_name).alias("activity_class"),
        labels.class_name(F.col("recording_id") % 3, {0: "near"}).alias("class_name"),
    )
