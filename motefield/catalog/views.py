"""Sensor views over the benchmark tables, as DataFrames and as SQL for the checks.

``signal``   one 1-D series per user from ``events``
``packets``  one row per packet from ``embeddings`` (integer I/Q array, RSSI)
``samples``  the same packets, one row per subcarrier amplitude
``lines``    log text of those packets, partly damaged
``preds``    a binary result table from ``labels``
``votes``    file-level predictions from ``embeddings``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.functions.iq import exploded, iq_amplitude
from motefield.ranking import positions
from motefield.series import SeriesLayout, measure

DEVICES = ["dev1", "dev2", "dev3"]
SUBCARRIERS = 32
PACKETS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- signal -----------------------------------------------------------------------------


def signal(spark: SparkSession, sf_dir: str, layout: SeriesLayout | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("unit_id"),
        "ts",
        "event_id",
        F.col("value").alias("x"),
        (-30 - F.regexp_extract("props", "([0-9]+)", 1).cast("int")).alias("rssi"),
    )
    return unit_names(positions(rows, ["unit_id"], ["ts", "event_id"], longest=layout.longest if layout else None)).drop("ts", "event_id")


def unit_names(df: DataFrame) -> DataFrame:
    """Recording, device, label and person that follow from ``unit_id``."""
    recording = F.floor(F.col("unit_id") / 3).cast("int")
    return df.withColumns(
        {
            "recording_id": recording,
            "device": F.concat(F.lit("dev"), (F.col("unit_id") % 3 + 1).cast("string")),
            "label": F.concat(F.lit("label_0"), (recording % 4).cast("string")),
            "person_id": F.concat(
                F.lit("id_person_0"), (1 + F.floor(F.col("unit_id") / 12) % 4).cast("string")
            ),
        }
    )


def signal_layout(spark: SparkSession, sf_dir: str) -> SeriesLayout:
    base = measure(table(spark, sf_dir, "events"), ["user_id"])
    return base.with_keys("unit_id")


SIGNAL = """signal as (
  select user_id as unit_id, cast(floor(user_id/3) as int) as recording_id,
         concat('dev', cast(user_id%3+1 as string)) as device,
         concat('label_0', cast(cast(floor(user_id/3) as int)%4 as string)) as label,
         concat('id_person_0', cast(1+cast(floor(user_id/12) as int)%4 as string)) as person_id,
         row_number() over (partition by user_id order by ts, event_id)-1 as t,
         value as x, -30-cast(regexp_extract(props,'([0-9]+)',1) as int) as rssi
  from events)"""


def sql_padded(x: str, half: int, over: str) -> list[str]:
    """SQL for the edge-padded neighbours of ``x`` in the named window."""
    out = []
    for k in range(-half, half + 1):
        if k < 0:
            out.append(f"coalesce(lag({x},{-k}) over {over}, first_value({x}) over {over})")
        elif k > 0:
            out.append(
                f"coalesce(lead({x},{k}) over {over}, last_value({x}) over "
                f"({over} rows between unbounded preceding and unbounded following))"
            )
        else:
            out.append(x)
    return out


def sql_median(x: str, half: int, over: str) -> str:
    return f"list_sort([{', '.join(sql_padded(x, half, over))}])[{half + 1}]"


FILTERED = (
    SIGNAL
    + f""", filtered as (
  select unit_id, recording_id, device, label, person_id, t, rssi, {sql_median('x', 2, 'w')} as x
  from signal window w as (partition by unit_id order by t))"""
)

# --- packets and samples ----------------------------------------------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.floor(F.col("vec_id") / 3)
    recording = F.floor(place / PACKETS).cast("int")
    silent = F.array(*[F.lit(i) for i in (0, 1, 62, 63)])
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        recording.alias("recording_id"),
        F.concat(F.lit("dev"), (F.col("vec_id") % 3 + 1).cast("string")).alias("device"),
        F.concat(F.lit("label_0"), (recording % 4).cast("string")).alias("label"),
        F.concat(F.lit("id_person_0"), (1 + F.floor(recording / 4) % 4).cast("string")).alias("person_id"),
        (place % PACKETS).alias("t"),
        (-30 - F.col("label")).alias("rssi"),
        F.transform(
            "embedding",
            lambda v, i: F.when(F.array_contains(silent, i), 0).otherwise(
                F.floor(v.cast("double") * 100 + 0.5).cast("int")
            ),
        ).alias("iq"),
    )


def to_samples(frames: DataFrame, *keep: str) -> DataFrame:
    """One row per subcarrier amplitude, in packet order of ``t``."""
    kept = list(keep) or ["recording_id", "device", "t"]
    return exploded(frames, kept, iq_amplitude(F.col("iq")), "sc", "x")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_samples(packets(spark, sf_dir))


def packet_layout(spark: SparkSession, sf_dir: str) -> SeriesLayout:
    """Layout of per-receiver packet series; per-subcarrier series are as long."""
    keys = packets(spark, sf_dir).select("recording_id", "device")
    return measure(keys, ["recording_id", "device"], recording=["recording_id"], factor=SUBCARRIERS)


PACKETS_SQL = """u as (
  select vec_id, label as lab, cast(generate_subscripts(embedding,1)-1 as int) as i, cast(unnest(embedding) as double) as v
  from embeddings),
q as (
  select vec_id, lab, i, cast(floor(vec_id/3) as int) as pos, concat('dev', cast(vec_id%3+1 as string)) as device,
         case when i in (0,1,62,63) then 0 else cast(floor(v*100+0.5) as int) end as q
  from u),
packets as (
  select vec_id, cast(floor(pos/20) as int) as recording_id, device, cast(pos%20 as bigint) as t, -30-lab as rssi,
         concat('label_0', cast(cast(floor(pos/20) as int)%4 as string)) as label,
         concat('id_person_0', cast(1+cast(floor(cast(floor(pos/20) as int)/4) as int)%4 as string)) as person_id,
         list(q order by i) as iq
  from q group by vec_id, pos, device, lab)"""

SAMPLES = (
    PACKETS_SQL
    + """,
samples as (
  select cast(floor(pos/20) as int) as recording_id, device, cast(pos%20 as bigint) as t, cast(floor(i/2) as int) as sc,
         max(case when i%2=0 then q end) as im, max(case when i%2=1 then q end) as re, sqrt(cast(sum(q*q) as double)) as x
  from q group by 1,2,3,4)"""
)

# --- log lines --------------------------------------------------------------------------

CONSTANT_FIELDS = [11, 1, 7, 0, 1, 1, 0, 0, 0, 0, -96, 0, 6, 2]


def log_path() -> F.Column:
    suffix = F.when((F.col("recording_id") < 4) & (F.col("device") == "dev2"), ".DATA").otherwise(".data")
    rec = F.col("recording_id").cast("string")
    return F.concat(
        F.lit("root/"), F.col("person_id"), F.lit("/"), F.col("label"), F.lit("/test_"), rec,
        F.lit("/test"), rec, F.lit("__"), F.col("device"), F.lit("_AA_BB"), suffix,
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log text: fused timestamps, lost fields, cut first cells; device-3 files are clean."""
    from motefield.operators.repair import HEADER

    p = packets(spark, sf_dir).withColumn("path", log_path())
    n2 = F.lpad(F.col("t").cast("string"), 2, "0")
    stamp = F.concat(
        F.lit("01.01.2024 10:00:"), n2, F.lit("."), F.lpad((F.col("vec_id") % 1000).cast("string"), 3, "0"),
        F.lit(" +03:00"),
    )
    clean = F.col("device") == "dev3"
    whole = F.concat(F.lit("["), F.array_join("iq", ","), F.lit("]"))
    cell = F.when((F.col("device") == "dev1") & (F.col("t") == 0), F.substring(whole, 1, 40)).otherwise(whole)
    fields = [
        stamp, F.lit("CSI_DATA"), F.col("vec_id").cast("string"), F.lit("64:E8:33:57:AA:F4"),
        F.col("rssi").cast("string"), *[F.lit(str(c)) for c in CONSTANT_FIELDS],
        (F.col("vec_id") * 1000).cast("string"), F.lit("0"), F.lit("128"), F.lit("0"), F.lit("64"), F.lit("0"),
        F.concat(F.lit('"'), cell, F.lit('"')),
    ]
    tail = F.concat_ws(",", *fields[2:])
    short_tail = F.concat_ws(",", *fields[2:5], *fields[6:])
    fused = F.concat_ws(" ", fields[0], fields[1])
    text = F.when(clean, F.concat_ws(",", fields[0], fields[1], tail)).otherwise(
        F.concat_ws(",", fused, F.when(F.col("t") % 7 == 5, short_tail).otherwise(tail))
    )
    body = p.select(
        "path", F.when(clean, F.col("t") + 2).otherwise(F.col("t") + 1).alias("line_no"), text.alias("line")
    )
    heads = (
        p.filter(clean & (F.col("t") == 0))
        .select("path", F.lit(1).cast("long").alias("line_no"), F.lit(",".join(HEADER)).alias("line"))
    )
    return body.unionByName(heads)


def _lines_sql() -> str:
    from motefield.operators.repair import HEADER

    const = "||','||".join(f"'{c}'" for c in CONSTANT_FIELDS)
    return (
        PACKETS_SQL
        + f""",
pathed as (
  select *, 'root/'||person_id||'/'||label||'/test_'||recording_id||'/test'||recording_id||'__'||device||'_AA_BB'||
            case when recording_id<4 and device='dev2' then '.DATA' else '.data' end as path,
         '01.01.2024 10:00:'||lpad(cast(t as varchar),2,'0')||'.'||lpad(cast(vec_id%1000 as varchar),3,'0')||' +03:00' as stamp,
         '['||array_to_string(iq, ',')||']' as whole
  from packets),
parts as (
  select *, vec_id||',64:E8:33:57:AA:F4,'||rssi as head,
         {const} as consts,
         (vec_id*1000)||',0,128,0,64,0,'||'"'||(case when device='dev1' and t=0 then substr(whole,1,40) else whole end)||'"' as tail
  from pathed),
lines as (
  select path, case when device='dev3' then t+2 else t+1 end as line_no,
         case when device='dev3' then stamp||',CSI_DATA,'||head||','||consts||','||tail
              when t%7=5 then stamp||' CSI_DATA,'||head||','||substr(consts, instr(consts, ',')+1)||','||tail
              else stamp||' CSI_DATA,'||head||','||consts||','||tail end as line
  from parts
  union all
  select path, 1, '{",".join(HEADER)}' from parts where device='dev3' and t=0)"""
    )


def lines_sql() -> str:
    return _lines_sql()


# --- results ----------------------------------------------------------------------------


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("unit_id"),
        F.col("quality").alias("y_true"),
        (1 - F.col("toxic")).alias("y_pred"),
        (((F.col("doc_id") * 37) % 101) / F.lit(101.0)).alias("score"),
    )


PREDS = """preds as (
  select doc_id as unit_id, quality as y_true, 1-toxic as y_pred, ((doc_id*37)%101)/101.0::double as score from labels)"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files per group; the device follows from the label, so some groups miss a device."""
    v = F.col("embedding")
    group = F.floor(F.col("vec_id") / 4)
    return table(spark, sf_dir, "embeddings").select(
        group.alias("group_id"),
        F.concat(F.lit("dev"), (F.col("label") % 3 + 1).cast("string")).alias("device"),
        F.col("vec_id").alias("file_id"),
        (F.when(v[0] > 0, 2).otherwise(0) + F.when(v[1] > 0, 1).otherwise(0)).alias("pred_class"),
        (group % 4).cast("int").alias("true_class"),
    )


VOTES = """votes as (
  select cast(floor(vec_id/4) as bigint) as group_id, 'dev'||(label%3+1) as device, vec_id as file_id,
         (case when embedding[1]>0 then 2 else 0 end)+(case when embedding[2]>0 then 1 else 0 end) as pred_class,
         cast(cast(floor(vec_id/4) as bigint)%4 as int) as true_class
  from embeddings)"""
