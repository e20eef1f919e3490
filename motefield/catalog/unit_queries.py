"""Queries on the 1-D unit signal: filters, bounds, statistics, spectrum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.catalog.common import r6, rounded, sql_split
from motefield.catalog.registry import query
from motefield.catalog.views import (
    FILTERED, SIGNAL, packets, packet_layout, PACKETS_SQL, signal, signal_layout, sql_median, sql_padded,
)
from motefield.operators import filters, spectral, splits, units
from motefield.operators.packets import unit_signal
from motefield.runtime import materialise
from motefield.series import SeriesLayout

WIDTH = 5


def filtered_series(spark, sf_dir) -> tuple[DataFrame, SeriesLayout]:
    """The filtered signal with its layout, which is measured once."""
    layout = signal_layout(spark, sf_dir)
    return filters.median_filter(signal(spark, sf_dir, layout), "x", layout, WIDTH, "x"), layout


def filtered(spark, sf_dir) -> DataFrame:
    return filtered_series(spark, sf_dir)[0]


def train_side(df: DataFrame) -> DataFrame:
    roles = splits.stratified_split(df, "recording_id", ["label"])
    return df.join(roles.filter("role = 'train'").select("recording_id", "label"), ["recording_id", "label"], "left_semi")


def scaled_series(spark, sf_dir) -> tuple[DataFrame, SeriesLayout]:
    df, layout = filtered_series(spark, sf_dir)
    df = materialise(df)  # read for the split, the bounds and the result
    bounds = units.train_bounds(train_side(df), "x", ["device"])
    return units.scale_by_bounds(df, "x", bounds, ["device"]), layout


SPLIT = sql_split("signal", "recording_id", "label", "split")
BOUNDS = """bounds as (
  select device, min(x) as lo, max(x) as hi from filtered join split using (recording_id, label)
  where role='train' group by device)"""
SCALED = f"""{FILTERED}, {SPLIT}, {BOUNDS},
scaled as (
  select unit_id, recording_id, device, label, person_id, t, rssi,
         least(greatest((x-lo)/(hi-lo),0.0::double),1.0::double) as x
  from filtered join bounds using (device))"""


@query("moving_average", f"with {SIGNAL} select unit_id, t, round(sum(x) over w/5, 6) as x_avg from signal "
       "window w as (partition by unit_id order by t rows between 2 preceding and 2 following)")
def moving_average(spark, sf_dir):
    layout = signal_layout(spark, sf_dir)
    df = filters.moving_average(signal(spark, sf_dir, layout), "x", layout, 5, "x_avg")
    return df.select("unit_id", "t", r6("x_avg"))


@query("median_filter", f"with {FILTERED} select unit_id, t, round(x, 6) as x_med from filtered")
def median_filter(spark, sf_dir):
    return filtered(spark, sf_dir).select("unit_id", "t", r6("x", "x_med"))


@query("unit_signal", f"""with {PACKETS_SQL},
m as (select recording_id, device, t, (select avg(sqrt(cast(iq[2*k+1]*iq[2*k+1]+iq[2*k+2]*iq[2*k+2] as double)))
        from unnest(generate_series(0, 31)) as g(k)) as x from packets)
select recording_id, device, t, round({sql_median('x', 2, 'w')}, 6) as x
from m window w as (partition by recording_id, device order by t)""")
def unit_signal_query(spark, sf_dir):
    out = unit_signal(packets(spark, sf_dir), packet_layout(spark, sf_dir), WIDTH)
    return out.select("recording_id", "device", "t", r6("x"))


@query("time_diff", f"with {SIGNAL}, d as (select unit_id, t, x - lag(x) over (partition by unit_id order by t) as dx from signal) "
       "select unit_id, t, round(dx, 6) as dx from d where dx is not null")
def time_diff(spark, sf_dir):
    layout = signal_layout(spark, sf_dir)
    df = filters.time_diff(signal(spark, sf_dir, layout), "x", layout, "dx")
    return df.select("unit_id", "t", r6("dx"))


@query("zero_crossing", f"""with {SCALED},
s as (select unit_id, t, x < avg(x) over (partition by unit_id) as neg from scaled),
d as (select unit_id, case when neg <> lag(neg) over (partition by unit_id order by t) then 1
             when lag(neg) over (partition by unit_id order by t) is null then null else 0 end as flip from s)
select unit_id, round(avg(flip), 6) as zcr from d group by unit_id""")
def zero_crossing(spark, sf_dir):
    df, layout = scaled_series(spark, sf_dir)
    return filters.zero_crossing_rate(df, "x", layout, "zcr").select("unit_id", r6("zcr"))


@query("train_bounds", f"with {FILTERED}, {SPLIT}, {BOUNDS} select device, round(lo, 6) as global_min, round(hi, 6) as global_max from bounds")
def train_bounds(spark, sf_dir):
    return rounded(units.train_bounds(train_side(filtered(spark, sf_dir)), "x", ["device"]))


@query("minmax_scale", f"with {SCALED} select unit_id, device, t, round(x, 6) as x from scaled")
def minmax_scale(spark, sf_dir):
    return scaled_series(spark, sf_dir)[0].select("unit_id", "device", "t", r6("x"))


STATS_SQL = """stats as (
  select unit_id, avg(x) as mean, stddev_pop(x) as std, quantile_cont(x, 0.5) as median, min(x) as min, max(x) as max,
         quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.75) as q75,
         quantile_cont(x, 0.75)-quantile_cont(x, 0.25) as iqr, max(x)-min(x) as range,
         sqrt(avg(x*x)) as rms, sum(x*x) as energy
  from scaled group by unit_id)"""
MOMENTS_SQL = """base as (select unit_id, x, avg(x) over (partition by unit_id) as mu, stddev_pop(x) over (partition by unit_id) as sd from scaled),
moments as (
  select unit_id, case when max(sd)=0 then 0.0 else avg(((x-mu)/nullif(sd,0))**3) end as skew,
         case when max(sd)=0 then 0.0 else avg(((x-mu)/nullif(sd,0))**4)-3 end as kurtosis
  from base group by unit_id)"""


@query("unit_stats", f"""with {SCALED}, {STATS_SQL}
select unit_id, round(mean,6) as mean, round(std,6) as std, round(median,6) as median, round(min,6) as min, round(max,6) as max,
  round(q25,6) as q25, round(q75,6) as q75, round(iqr,6) as iqr, round("range",6) as "range", round(rms,6) as rms, round(energy,6) as energy
from stats""")
def unit_stats(spark, sf_dir):
    df, layout = scaled_series(spark, sf_dir)
    return rounded(units.unit_statistics(df, "x", layout, moments=False))


@query("unit_moments", f"with {SCALED}, {MOMENTS_SQL} select unit_id, round(skew,6) as skew, round(kurtosis,6) as kurtosis from moments")
def unit_moments(spark, sf_dir):
    df, layout = scaled_series(spark, sf_dir)
    return units.unit_statistics(df, "x", layout).select("unit_id", r6("skew"), r6("kurtosis"))


@query("unit_rssi", f"with {SIGNAL} select unit_id, count(*) as n_packets, quantile_cont(cast(rssi as double),0.5) as rssi_median from signal group by unit_id")
def unit_rssi(spark, sf_dir):
    layout = signal_layout(spark, sf_dir)
    return units.packet_summary(signal(spark, sf_dir, layout), layout)


DFT = """n as (select unit_id, count(*) as n from scaled group by unit_id),
bins as (select unit_id, n, unnest(generate_series(0, n//2)) as k from n),
dft as (
  select b.unit_id, b.n, b.k, sum(x*cos(2*pi()*b.k*s.t/b.n))**2 + sum(x*sin(2*pi()*b.k*s.t/b.n))**2 as p
  from bins b join scaled s on s.unit_id=b.unit_id group by 1,2,3)"""
SPECTRAL_SQL = DFT + """,
tot as (select unit_id, sum(p) as total, sum(p*k/n)/sum(p) as c from dft group by unit_id),
cum as (select d.*, d.k/d.n::double as f, total, c, sum(p) over (partition by d.unit_id order by k rows unbounded preceding) as run
        from dft d join tot using (unit_id)),
spec as (
  select unit_id, max(c) as spectral_centroid, sqrt(sum((f-c)*(f-c)*p/total)) as spectral_spread,
         -sum(p/total*log2(p/total+1e-12)) as spectral_entropy,
         arg_max(f, p) as dominant_freq, min(f) filter (where run >= 0.85::double*total) as spectral_rolloff_85
  from cum group by unit_id)"""


@query("power_spectrum", f"with {SCALED}, {DFT} select unit_id, cast(k as bigint) as k, round(k/n::double,6) as freq, round(p,6) as power from dft")
def power_spectrum(spark, sf_dir):
    df, layout = scaled_series(spark, sf_dir)
    return rounded(spectral.power_spectrum(df, "x", layout))


@query("spectral_features", f"""with {SCALED}, {SPECTRAL_SQL}
select unit_id, round(spectral_centroid,6) as spectral_centroid, round(spectral_spread,6) as spectral_spread,
  round(spectral_entropy,6) as spectral_entropy, round(dominant_freq,6) as dominant_freq, round(spectral_rolloff_85,6) as spectral_rolloff_85
from spec""")
def spectral_features(spark, sf_dir):
    df, layout = scaled_series(spark, sf_dir)
    return rounded(spectral.spectral_features(df, "x", layout))
