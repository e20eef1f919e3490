"""Queries on amplitude series and row windows of three receivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog.common import r6, rounded
from motefield.catalog.registry import query
from motefield.catalog.views import (
    DEVICES, PACKETS_SQL, SAMPLES, SUBCARRIERS, packet_layout, packets, samples, sql_padded, to_samples,
)
from motefield.functions.iq import complex_map, complex_phase, exploded, iq_complex
from motefield.runtime import lookup_join
from motefield.operators import filters, normalise, recordings, windows
from motefield.operators.normalise import PreprocessConfig
from motefield.operators.packets import align_devices, segment_rows, wide_by_device
from motefield.series import SeriesLayout

SERIES = ["recording_id", "device", "sc"]
WINDOW = ["recording_id", "segment"]
WIDTH, STEP = 6, 4
WEIGHTS = {
    5: ([-3, 12, 17, 12, -3], 35),
    7: ([-2, 3, 6, 7, 6, 3, -2], 21),
    9: ([-21, 14, 39, 54, 59, 54, 39, 14, -21], 231),
    11: ([-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36], 429),
}


def series_layout(spark, sf_dir) -> SeriesLayout:
    return packet_layout(spark, sf_dir).with_keys(*SERIES)


# --- SQL building blocks ------------------------------------------------------------------


def sql_counted(src: str, name: str, keys: str) -> str:
    return f"{name} as (select *, count(*) over (partition by {keys}) as n from {src})"


def sql_fit_median(src: str, name: str, x: str, out: str, keys: str, t: str, width: int = 7) -> str:
    half = width // 2
    pads = ", ".join(sql_padded(x, half, "w"))
    fit = f"(case when n<=1 then 0 else greatest(3, least({width}, n-(1-n%2)))//2 end)"
    return f"""{name}_pad as (select *, [{pads}] as pad, cast({fit} as int) as h from {src} window w as (partition by {keys} order by {t})),
{name} as (select * exclude (pad, h), list_sort(pad[{half + 1}-h:{half + 1}+h])[h+1] as {out} from {name}_pad)"""


def sql_hampel(src: str, name: str, x: str, out: str, keys: str, t: str) -> str:
    return f"""{sql_fit_median(src, name + '_a', x, 'med', keys, t)},
{name}_d as (select *, abs({x}-med) as dev from {name}_a),
{sql_fit_median(name + '_d', name + '_b', 'dev', 'mad', keys, t)},
{name} as (select * exclude (med, dev, mad), case when dev > 3.0::double*1.4826::double*(mad+1e-8::double) then med else {x} end as {out} from {name}_b)"""


def sql_savgol(src: str, name: str, x: str, out: str, keys: str, t: str) -> str:
    pads = ", ".join(sql_padded(x, 5, "w"))
    cases = ""
    for w, (weights, total) in WEIGHTS.items():
        terms = "+".join(f"({c})*pad[{6 - w // 2 + i}]" for i, c in enumerate(weights))
        cases += f" when w={w} then ({terms})/{total}.0::double"
    return f"""{name}_pad as (select *, [{pads}] as pad, case when n>4 then least(11, n-(1-n%2)) end as w from {src} window w as (partition by {keys} order by {t})),
{name} as (select * exclude (pad, w), case{cases} else {x} end as {out} from {name}_pad)"""


def sql_detrend(src: str, name: str, x: str, keys: str, t: str, width: int) -> str:
    return f"""{name}_xs as (select *, list({x}) over (partition by {keys} order by {t} rows between unbounded preceding and unbounded following) as xs,
   least({width}, n) as size from {src}),
{name} as (select * exclude (xs, size), {x}-trend as detrended from (select *,
   (select avg(xs[1+least(greatest({t}+k, 0), n-1)]) from unnest(generate_series(-(size//2), size-size//2-1)) as g(k)) as trend from {name}_xs))"""


def sql_zscore(src: str, name: str, x: str, keys: str, recording: str) -> str:
    return f"""{name}_m as (select *, quantile_cont({x}, 0.5) over (partition by {keys}) as med from {src}),
{name}_s as (select *, 1.4826::double*quantile_cont(abs({x}-med), 0.5) over (partition by {keys}) as scale from {name}_m),
{name}_f as (select {recording}, coalesce(greatest(quantile_cont(scale, 0.1) filter (where scale>0), 1e-6::double), 1.0::double) as scale_floor
  from (select distinct {keys}, scale from {name}_s) group by {recording}),
{name} as (select * exclude (scale), greatest(scale, scale_floor) as norm_scale,
   least(greatest(({x}-med)/greatest(scale, scale_floor), -8.0::double), 8.0::double) as normalized
   from {name}_s join {name}_f using ({recording}))"""


KEYS = "recording_id, device, sc"
COUNTED = f"{SAMPLES}, {sql_counted('samples', 'c', KEYS)}"
ALIGNED = SAMPLES + """,
m as (select recording_id, min(n) as m from (select recording_id, device, count(distinct t) as n from samples group by 1,2) group by 1),
aligned as (select s.* from samples s join m using (recording_id) where t < m)"""
SEGMENTS = ALIGNED + f""",
seg as (
  select a.recording_id, cast(g.segment as bigint) as segment, device, sc, x, t-g.segment*{STEP} as seg_t
  from aligned a join m using (recording_id), unnest(generate_series(0, 4)) as g(segment)
  where t between g.segment*{STEP} and g.segment*{STEP}+{WIDTH - 1} and g.segment*{STEP}+{WIDTH} <= m),
chg as (select *, x-lag(x) over (partition by recording_id, segment, device, sc order by seg_t) as dx from seg)"""
PAIRS = """,
pairs as (
  select a.recording_id, a.segment, a.seg_t, a.sc, a.device||'_'||b.device as pair, abs(a.x-b.x) as p
  from seg a join seg b on a.recording_id=b.recording_id and a.segment=b.segment and a.seg_t=b.seg_t and a.sc=b.sc and a.device<b.device),
pairs2 as (select *, abs(p-lag(p) over (partition by recording_id, segment, pair, sc order by seg_t)) as q from pairs)"""
RSSI = f""",
rseg as (
  select a.recording_id, cast(g.segment as bigint) as segment, device, cast(rssi as double) as rssi, t-g.segment*{STEP} as seg_t
  from packets a join m using (recording_id), unnest(generate_series(0, 4)) as g(segment)
  where t < m and t between g.segment*{STEP} and g.segment*{STEP}+{WIDTH - 1} and g.segment*{STEP}+{WIDTH} <= m),
rchg as (select *, rssi-lag(rssi) over (partition by recording_id, segment, device order by seg_t) as dr from rseg)"""
SEVEN = """round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(min(value),6) as min, round(quantile_cont(value,0.1),6) as p10,
  round(quantile_cont(value,0.5),6) as median, round(quantile_cont(value,0.9),6) as p90, round(max(value),6) as max"""
SPREAD = "select recording_id, segment, 'absolute__receiver_spread' as vector, stddev_pop(x) as value from seg group by recording_id, segment, seg_t, sc"
VEC_PAIRS = """select recording_id, segment, 'absolute__pair_'||pair||'_absdiff' as vector, p as value from pairs2
  union all select recording_id, segment, 'motion__pair_'||pair||'_absdiff_dt', q from pairs2 where q is not null"""
VEC_RSSI = """select recording_id, segment, 'absolute__'||device||'_rssi' as vector, rssi as value from rchg
  union all select recording_id, segment, 'motion__'||device||'_rssi_dt', dr from rchg where dr is not null"""
VEC_BASE = """select recording_id, segment, 'absolute__'||s||'_x' as vector, x as value from scoped
  union all select recording_id, segment, 'absolute__'||s||'_abs_x', abs(x) from scoped
  union all select recording_id, segment, 'motion__'||s||'_dt', dx from scoped where dx is not null
  union all select recording_id, segment, 'motion__'||s||'_abs_dt', abs(dx) from scoped where dx is not null
  union all select recording_id, segment, 'motion__'||s||'_motion_energy', avg(abs(dx)) from scoped where dx is not null group by recording_id, segment, s, seg_t"""
SCOPED = """,
scoped as (select *, device as s from chg union all select *, 'global' as s from chg)"""


# --- packets ------------------------------------------------------------------------------


@query("iq_complex", f"with {PACKETS_SQL} select vec_id, k as sc, iq[2*k+2] as re, iq[2*k+1] as im from packets, unnest(generate_series(0,31)) as g(k)".replace(
    "k as sc", "cast(k as int) as sc").replace("iq[2*k+2] as re", "cast(iq[2*k+2] as double) as re").replace("iq[2*k+1] as im", "cast(iq[2*k+1] as double) as im"))
def iq_complex_query(spark, sf_dir):
    p = exploded(packets(spark, sf_dir), ["vec_id"], iq_complex(F.col("iq")), "sc", "c")
    return p.select("vec_id", "sc", "c.re", "c.im")


@query("iq_amplitude", f"with {SAMPLES} select recording_id, device, t, sc, round(x,6) as x from samples")
def iq_amplitude_query(spark, sf_dir):
    return samples(spark, sf_dir).select("recording_id", "device", "t", "sc", r6("x"))


@query("iq_phase", f"with {SAMPLES} select recording_id, device, t, sc, round(atan2(cast(im as double), cast(re as double)),6) as phase from samples")
def iq_phase(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("csi", iq_complex(F.col("iq")))
    out = exploded(p, ["recording_id", "device", "t"], complex_phase(F.col("csi")), "sc", "phase")
    return rounded(out)


@query("csi_map", f"""with {PACKETS_SQL} select vec_id, cast(k as int) as sc, iq[2*k+2]||'+'||iq[2*k+1]||'j' as c
from packets, unnest(generate_series(0,31)) as g(k)""")
def csi_map(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("csi", complex_map(iq_complex(F.col("iq"))))
    out = p.select("vec_id", F.explode("csi").alias("sc", "c"))
    return out.select(
        "vec_id", "sc", F.concat(F.col("c.re").cast("int"), F.lit("+"), F.col("c.im").cast("int"), F.lit("j")).alias("c")
    )


# --- alignment and windows ----------------------------------------------------------------


def aligned_packets(spark, sf_dir, layout=None):
    layout = layout or packet_layout(spark, sf_dir)
    return align_devices(packets(spark, sf_dir), "recording_id", DEVICES, layout)


def windowed_packets(spark, sf_dir):
    """Aligned packets assigned to windows; the series are the receivers of a recording."""
    layout = packet_layout(spark, sf_dir)
    return segment_rows(aligned_packets(spark, sf_dir, layout), layout, WIDTH, STEP)


def window_samples(spark, sf_dir):
    return to_samples(windowed_packets(spark, sf_dir), "recording_id", "segment", "seg_t", "device")


@query("align_devices", f"""with {PACKETS_SQL},
m as (select recording_id, min(n) as m from (select recording_id, device, count(*) as n from packets group by 1,2) group by 1)
select recording_id, t, max(case when device='dev1' then vec_id end) as vec_id_dev1, max(case when device='dev2' then vec_id end) as vec_id_dev2,
  max(case when device='dev3' then vec_id end) as vec_id_dev3, max(case when device='dev1' then rssi end) as rssi_dev1,
  max(case when device='dev2' then rssi end) as rssi_dev2, max(case when device='dev3' then rssi end) as rssi_dev3
from packets join m using (recording_id) where t < m group by 1,2""")
def align_query(spark, sf_dir):
    return wide_by_device(aligned_packets(spark, sf_dir), ["recording_id", "t"], DEVICES, ["vec_id", "rssi"])


@query("segment_rows", f"with {SEGMENTS} select recording_id, segment, device, seg_t, count(*) as n_sc from seg group by 1,2,3,4")
def segment_query(spark, sf_dir):
    return window_samples(spark, sf_dir).groupBy("recording_id", "segment", "device", "seg_t").agg(F.count("*").alias("n_sc"))


@query("motion_energy", f"""with {SAMPLES},
d as (select recording_id, t, abs(x-lag(x) over (partition by recording_id, device, sc order by t)) as d from samples),
e as (select recording_id, t, avg(d) as energy from d where d is not null group by 1,2),
c as (select cast(recording_id%4>0 as int) as binary_label, greatest(quantile_cont(energy, 0.99)*1.15::double, 1e-6) as upper from e group by 1)
select recording_id, t, binary_label, round(energy,6) as energy, round(upper,6) as upper from e join c on c.binary_label=cast(recording_id%4>0 as int)""")
def motion_energy(spark, sf_dir):
    energy = windows.motion_energy(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), ["recording_id"], "energy")
    energy = energy.withColumn("binary_label", (F.col("recording_id") % 4 > 0).cast("int"))
    limits = windows.energy_limit(energy, "energy", ["binary_label"])
    out = lookup_join(energy, limits, ["binary_label"])
    return rounded(out.select("recording_id", "t", "binary_label", "energy", "upper"))


def wide_rows(spark, sf_dir):
    return windows.wide(window_samples(spark, sf_dir), WINDOW, DEVICES)


@query("window_summary", f"with {SEGMENTS}{PAIRS}{SCOPED} select recording_id, segment, vector, {SEVEN} from ({VEC_BASE} union all {SPREAD} union all {VEC_PAIRS}) group by 1,2,3")
def window_summary(spark, sf_dir):
    return rounded(windows.block_summary(windows.window_blocks(window_samples(spark, sf_dir), WINDOW, DEVICES), WINDOW, DEVICES))


@query("receiver_spread", f"with {SEGMENTS} select recording_id, segment, {SEVEN} from ({SPREAD}) group by 1,2")
def receiver_spread(spark, sf_dir):
    rows = wide_rows(spark, sf_dir).withColumn("spread", windows.receiver_spread(DEVICES))
    return rounded(windows.summary(rows, WINDOW, "spread"))


@query("pair_absdiff", f"with {SEGMENTS}{PAIRS} select recording_id, segment, vector, {SEVEN} from ({VEC_PAIRS}) group by 1,2,3")
def pair_absdiff(spark, sf_dir):
    vectors = windows.sample_vectors(wide_rows(spark, sf_dir), WINDOW, DEVICES)
    return rounded(windows.summarise_vectors(vectors.filter(F.col("vector").contains("__pair_")), WINDOW))


@query("rssi_features", f"with {SEGMENTS}{RSSI} select recording_id, segment, vector, {SEVEN} from ({VEC_RSSI}) group by 1,2,3")
def rssi_features(spark, sf_dir):
    return rounded(windows.summarise_vectors(windows.rssi_vectors(windowed_packets(spark, sf_dir), WINDOW), WINDOW))


SC_SQL = """select recording_id, segment, device, sc, avg(x) as sc_mean, stddev_pop(x) as sc_std, avg(abs(dx)) as sc_energy from chg group by 1,2,3,4"""
T_SQL = """select recording_id, segment, device, seg_t, t_mean, t_std, coalesce(lead(e) over w, e, 0.0) as t_energy from (
  select recording_id, segment, device, seg_t, avg(x) as t_mean, stddev_pop(x) as t_std, avg(abs(dx)) as e from chg group by 1,2,3,4)
  window w as (partition by recording_id, segment, device order by seg_t)"""


@query("sc_profile", f"with {SEGMENTS} select recording_id, segment, device, sc, round(sc_mean,6) as sc_mean, round(sc_std,6) as sc_std, round(sc_energy,6) as sc_energy from ({SC_SQL})")
def sc_profile(spark, sf_dir):
    return rounded(windows.sc_profile(wide_rows(spark, sf_dir), WINDOW, DEVICES))


@query("t_profile", f"with {SEGMENTS} select recording_id, segment, device, seg_t, round(t_mean,6) as t_mean, round(t_std,6) as t_std, round(t_energy,6) as t_energy from ({T_SQL})")
def t_profile(spark, sf_dir):
    return rounded(windows.t_profile(wide_rows(spark, sf_dir), WINDOW, DEVICES))


SEQUENCES = f"""scp as ({SC_SQL}), tp as ({T_SQL}),
sequences as (
  select recording_id, segment, 'absolute__'||device||'_sc_mean' as vector, sc as position, sc_mean as value from scp
  union all select recording_id, segment, 'absolute__'||device||'_sc_std', sc, sc_std from scp
  union all select recording_id, segment, 'motion__'||device||'_sc_energy', sc, sc_energy from scp
  union all select recording_id, segment, 'absolute__'||device||'_t_mean', seg_t, t_mean from tp
  union all select recording_id, segment, 'motion__'||device||'_t_energy', seg_t, t_energy from tp)"""
SEQ_NAMED = "select recording_id, segment, vector||'_'||lpad(cast(position as varchar),3,'0') as feature, value from sequences"


@query("flatten_sequence", f"with {SEGMENTS}, {SEQUENCES} select recording_id, segment, feature, round(value,6) as value from ({SEQ_NAMED})")
def flatten_sequence(spark, sf_dir):
    seq = windows.sequences(wide_rows(spark, sf_dir), WINDOW, DEVICES)
    return seq.select("recording_id", "segment", F.format_string("%s_%03d", "vector", "position").alias("feature"), r6("value"))


FEATURES_SQL = f"""vectors as ({VEC_BASE} union all {SPREAD} union all {VEC_PAIRS} union all {VEC_RSSI}),
seven as (select recording_id, segment, vector, avg(value) as mean, stddev_pop(value) as std, min(value) as min, quantile_cont(value,0.1) as p10,
  quantile_cont(value,0.5) as median, quantile_cont(value,0.9) as p90, max(value) as max from vectors group by 1,2,3),
features as (
  {' union all '.join(f"select recording_id, segment, vector||'_{s}' as feature, {s} as value from seven" for s in windows.STATS)}
  union all {SEQ_NAMED})"""


def features_of(spark, sf_dir):
    p = windowed_packets(spark, sf_dir)
    return windows.window_features(to_samples(p, *WINDOW, "seg_t", "device"), p, WINDOW, DEVICES)


@query("window_features", f"with {SEGMENTS}{PAIRS}{RSSI}{SCOPED}, {SEQUENCES}, {FEATURES_SQL} select recording_id, segment, feature, round(value,6) as value from features")
def window_features(spark, sf_dir):
    return rounded(features_of(spark, sf_dir))


@query("feature_select", f"""with {SEGMENTS}{PAIRS}{RSSI}{SCOPED}, {SEQUENCES}, {FEATURES_SQL}
select recording_id, segment, count(*) as n_features, round(sum(value),4) as total, min(feature) as first_name, max(feature) as last_name
from features where feature like 'motion\\_\\_%' escape '\\' group by 1,2""")
def feature_select(spark, sf_dir):
    table = windows.feature_table(features_of(spark, sf_dir), WINDOW, "motion_only")
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return table.select(
        *WINDOW, F.size("names").cast("long").alias("n_features"), F.round(total, 4).alias("total"),
        F.array_min("names").alias("first_name"), F.array_max("names").alias("last_name"),
    )


SINGLE = ["recording_id", "device", "segment"]


@query("single_receiver_features", f"""with {SEGMENTS}, {SEQUENCES},
v as (
  select recording_id, device, segment, 'x' as vector, x as value from chg
  union all select recording_id, device, segment, 'abs_x', abs(x) from chg
  union all select recording_id, device, segment, 'dt', dx from chg where dx is not null
  union all select recording_id, device, segment, 'abs_dt', abs(dx) from chg where dx is not null
  union all select recording_id, device, segment, 'motion_energy', avg(abs(dx)) from chg where dx is not null group by recording_id, device, segment, seg_t),
seven as (select recording_id, device, segment, vector, avg(value) as mean, stddev_pop(value) as std, min(value) as min, quantile_cont(value,0.1) as p10,
  quantile_cont(value,0.5) as median, quantile_cont(value,0.9) as p90, max(value) as max from v group by 1,2,3,4),
f as (
  {' union all '.join(f"select recording_id, device, segment, vector||'_{s}' as feature, {s} as value from seven" for s in windows.STATS)}
  {' '.join(f"union all select recording_id, device, segment, '{c}_'||lpad(cast(sc as varchar),3,'0'), {c} from scp" for c in ('sc_mean', 'sc_std', 'sc_energy'))}
  {' '.join(f"union all select recording_id, device, segment, '{c}_'||lpad(cast(seg_t as varchar),3,'0'), {c} from tp" for c in ('t_mean', 't_std', 't_energy'))})
select recording_id, device, segment, feature, round(value,6) as value from f""")
def single_receiver_features(spark, sf_dir):
    return rounded(windows.single_receiver_features(window_samples(spark, sf_dir), SINGLE))


@query("binary_windows", f"""with {SEGMENTS}
select recording_id, segment, 'id_person_0'||(1+(recording_id//4)%4) as person_id, 'label_0'||(recording_id%4) as label,
  cast(recording_id%4>0 as int) as binary_label, case when recording_id%4>0 then 'motion' else 'no_motion' end as binary_name,
  recording_id%4 as distance_m, count(distinct seg_t) as n_packets, count(distinct device) as n_devices, count(distinct sc) as n_subcarriers
from seg group by 1,2""")
def binary_windows(spark, sf_dir):
    w = recordings.binary_windows(packets(spark, sf_dir), packet_layout(spark, sf_dir), DEVICES, WIDTH, STEP)
    return recordings.window_metadata(w)


@query("distance_subset", f"""with {SEGMENTS} select recording_id%4 as y_distance, count(distinct recording_id||'-'||segment) as n_windows
from seg where recording_id%4>0 group by 1""")
def distance_subset(spark, sf_dir):
    w = recordings.binary_windows(packets(spark, sf_dir), packet_layout(spark, sf_dir), DEVICES, WIDTH, STEP)
    moving = recordings.distance_subset(recordings.window_metadata(w))
    return moving.groupBy("y_distance").agg(F.count("*").alias("n_windows"))


SCALE_SQL = SEGMENTS + RSSI + """,
lab as (select *, cast(recording_id%4>0 as int) as binary_label, case when recording_id%4>0 then 'motion' else 'no_motion' end as binary_name from chg),
scale as (
  select binary_label, binary_name, device, avg(x) as amp_mean, stddev_pop(x) as amp_std, quantile_cont(x,0.1) as amp_p10, quantile_cont(x,0.9) as amp_p90,
    avg(abs(dx)) as abs_dt_mean, quantile_cont(abs(dx),0.9) as abs_dt_p90, max(r.m) as rssi_mean, max(r.s) as rssi_std
  from lab join (select cast(recording_id%4>0 as int) as bl, device as dv, avg(rssi) as m, stddev_pop(rssi) as s from rseg group by 1,2) r
    on r.bl=binary_label and r.dv=device group by 1,2,3)"""


def scale_table(spark, sf_dir):
    w = recordings.binary_windows(packets(spark, sf_dir), packet_layout(spark, sf_dir), DEVICES, WIDTH, STEP)
    by = ["binary_label", "binary_name", "device"]
    rows = to_samples(w, *WINDOW, "seg_t", *by)
    rows = recordings.with_change(rows, [*WINDOW, "device", "sc"], "seg_t")
    return recordings.device_scale(rows, w, by)


@query("device_scale", f"""with {SCALE_SQL} select binary_label, binary_name, device, {', '.join(f'round({c},6) as {c}' for c in
  ['amp_mean', 'amp_std', 'amp_p10', 'amp_p90', 'abs_dt_mean', 'abs_dt_p90', 'rssi_mean', 'rssi_std'])} from scale""")
def device_scale(spark, sf_dir):
    return rounded(scale_table(spark, sf_dir))


@query("device_scale_pivot", f"""with {SCALE_SQL},
long as ({' union all '.join(f"select '{m}' as metric, device, binary_label, {m} as v from scale" for m in ('amp_mean', 'abs_dt_mean', 'rssi_mean'))}),
p as (select metric, device, max(case when binary_label=0 then v end) as no_motion, max(case when binary_label=1 then v end) as motion from long group by 1,2)
select metric, device, round(no_motion,6) as no_motion, round(motion,6) as motion,
  round(case when metric='rssi_mean' then motion-no_motion else motion/nullif(no_motion,0) end,6) as compared from p""")
def device_scale_pivot(spark, sf_dir):
    return rounded(recordings.device_scale_pivot(scale_table(spark, sf_dir)))


@query("null_subcarriers", f"""with {SAMPLES},
heads as (select recording_id from (select recording_id, row_number() over (partition by recording_id%4 order by recording_id) as r
  from (select distinct recording_id from samples)) where r<=4)
select sc, round(avg(case when abs(x)<=1e-8 then 1.0 else 0.0 end),6) as zero_share from samples join heads using (recording_id)
group by sc having avg(case when abs(x)<=1e-8 then 1.0 else 0.0 end) >= 0.99""")
def null_subcarriers(spark, sf_dir):
    recs = packets(spark, sf_dir).select("recording_id", "label").distinct()
    return rounded(recordings.null_subcarriers(samples(spark, sf_dir), recs))


@query("clean_samples", f"""with {SAMPLES},
heads as (select recording_id from (select recording_id, row_number() over (partition by recording_id%4 order by recording_id) as r
  from (select distinct recording_id from samples)) where r<=4),
nulls as (select sc from samples join heads using (recording_id) group by sc having avg(case when abs(x)<=1e-8 then 1.0 else 0.0 end) >= 0.99)
select recording_id, device, t, cast(sc - (select count(*) from nulls n where n.sc < s.sc) as int) as sc, round(x,6) as x
from samples s where sc not in (select sc from nulls)""")
def clean_samples(spark, sf_dir):
    recs = packets(spark, sf_dir).select("recording_id", "label").distinct()
    every = samples(spark, sf_dir)
    return rounded(recordings.drop_subcarriers(every, recordings.null_subcarriers(every, recs)))


# --- preprocessing ------------------------------------------------------------------------


@query("median_filter_matrix", f"with {COUNTED}, {sql_fit_median('c', 'f', 'x', 'y', KEYS, 't')} select {KEYS}, t, round(y,6) as y from f")
def median_filter_matrix(spark, sf_dir):
    out = filters.median_filter_fitting(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), 7, "y")
    return out.select(*SERIES, "t", r6("y"))


@query("hampel", f"with {COUNTED}, {sql_hampel('c', 'f', 'x', 'y', KEYS, 't')} select {KEYS}, t, round(y,6) as y from f")
def hampel(spark, sf_dir):
    out = filters.hampel_filter(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), "y")
    return out.select(*SERIES, "t", r6("y"))


@query("savgol", f"with {COUNTED}, {sql_savgol('c', 'f', 'x', 'y', KEYS, 't')} select {KEYS}, t, round(y,6) as y from f")
def savgol(spark, sf_dir):
    out = filters.savgol_filter(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), "y")
    return out.select(*SERIES, "t", r6("y"))


@query("detrend", f"with {COUNTED}, {sql_detrend('c', 'f', 'x', KEYS, 't', 8)} select {KEYS}, t, round(trend,6) as trend, round(detrended,6) as detrended from f")
def detrend(spark, sf_dir):
    out = filters.detrend(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), "trend", "detrended", 8)
    return out.select(*SERIES, "t", r6("trend"), r6("detrended"))


@query("robust_zscore", f"with {SAMPLES}, {sql_zscore('samples', 'z', 'x', KEYS, 'recording_id')} select {KEYS}, t, round(normalized,6) as z, round(norm_scale,6) as norm_scale, round(scale_floor,6) as scale_floor from z")
def robust_zscore(spark, sf_dir):
    out = normalise.robust_zscore(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), ["recording_id"], "z")
    return out.select(*SERIES, "t", r6("z"), r6("norm_scale"), r6("scale_floor"))


FULL = PreprocessConfig(apply_detrend=True, apply_zscore=True)
PIPELINE_SQL = f"""{COUNTED}, {sql_hampel('c', 'h', 'x', 'hampel', KEYS, 't')}, {sql_savgol('h', 's', 'hampel', 'smoothed', KEYS, 't')},
{sql_detrend('s', 'd', 'smoothed', KEYS, 't', 51)}, {sql_zscore('d', 'z', 'detrended', KEYS, 'recording_id')}"""


def preprocessed(spark, sf_dir):
    return normalise.preprocess_amplitude(samples(spark, sf_dir), "x", series_layout(spark, sf_dir), ["recording_id"], FULL)


@query("preprocess_pipeline", f"""with {PIPELINE_SQL} select {KEYS}, t, round(hampel,6) as hampel, round(smoothed,6) as smoothed, round(trend,6) as trend,
round(detrended,6) as detrended, round(normalized,6) as normalized from z""")
def preprocess_pipeline(spark, sf_dir):
    cols = ["hampel", "smoothed", "trend", "detrended", "normalized"]
    return preprocessed(spark, sf_dir).select(*SERIES, "t", *[r6(c) for c in cols])


@query("preprocess_diagnostics", f"""with {PIPELINE_SQL}, sers as (select distinct {KEYS}, norm_scale from z),
p as (select recording_id, quantile_cont(norm_scale,0.0) as p0, quantile_cont(norm_scale,0.1) as p10, quantile_cont(norm_scale,0.5) as p50, quantile_cont(norm_scale,0.9) as p90 from sers group by 1)
select recording_id, round(min(normalized),6) as norm_min, round(max(normalized),6) as norm_max, round(max(scale_floor),6) as scale_floor,
  round(max(p0),6) as scale_p0, round(max(p10),6) as scale_p10, round(max(p50),6) as scale_p50, round(max(p90),6) as scale_p90
from z join p using (recording_id) group by recording_id""")
def preprocess_diagnostics(spark, sf_dir):
    return rounded(normalise.preprocess_diagnostics(preprocessed(spark, sf_dir), series_layout(spark, sf_dir), ["recording_id"]))


WKEYS = "recording_id, segment, device, sc"


# Without detrending: removing the trend of a flat six-packet series leaves rounding noise, whose
# tiny but positive scale would decide the scale floor of the window.
@query("preprocess_windows", f"""with {SEGMENTS}, {sql_counted('seg', 'c', WKEYS)}, {sql_hampel('c', 'h', 'x', 'hampel', WKEYS, 'seg_t')},
{sql_savgol('h', 's', 'hampel', 'smoothed', WKEYS, 'seg_t')}, {sql_zscore('s', 'z', 'smoothed', WKEYS, 'recording_id, segment')}
select {WKEYS}, seg_t, round(normalized,6) as normalized from z""")
def preprocess_windows(spark, sf_dir):
    layout = SeriesLayout(
        ("recording_id", "segment", "device", "sc"), WIDTH, "seg_t", recording_rows=WIDTH * len(DEVICES) * SUBCARRIERS
    )
    config = PreprocessConfig(apply_zscore=True)
    out = normalise.preprocess_amplitude(window_samples(spark, sf_dir), "x", layout, WINDOW, config)
    return out.select(*WINDOW, "device", "sc", "seg_t", r6("normalized"))


@query("robust_limits", f"""with {SAMPLES} select device, round(quantile_cont(x,0.01),6) as low, round(quantile_cont(x,0.99),6) as high,
 round(-quantile_cont(abs(x),0.99),6) as centred_low, round(quantile_cont(abs(x),0.99),6) as centred_high from samples group by device""")
def robust_limits(spark, sf_dir):
    s = samples(spark, sf_dir)
    both = normalise.robust_limits(s, "x", ["device"])
    centred = normalise.robust_limits(s, "x", ["device"], centred=True)
    centred = centred.withColumnsRenamed({"low": "centred_low", "high": "centred_high"})
    return rounded(both.join(centred, "device"))
