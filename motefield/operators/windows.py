"""Features of row windows cut from aligned receivers.

Input rows are ``(keys…, seg_t, device, sc, x)`` where ``keys`` name one window, usually
``recording_id, segment``. A window holds a fixed number of packets, so every group below is
small; all steps share one hash partitioning by the window keys.
"""

from __future__ import annotations

import warnings
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.operators.filters import time_diff
from motefield.ranking import percentiles, quantiles, spread_percentiles
from motefield.runtime import materialise
from motefield.series import SeriesLayout

STATS = ["mean", "std", "min", "p10", "median", "p90", "max"]
T = "seg_t"
# Samples of whole windows that a task gets: they become several times as many values there.
TASK_SAMPLES = 100_000


SHARES = {"p10": 0.1, "median": 0.5, "p90": 0.9}


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Seven statistics of ``value`` per window."""
    found = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        percentiles(value, SHARES),
    )
    return spread_percentiles(found, SHARES).select(*keys, *STATS)


def motion_energy(df: DataFrame, value: str, layout: SeriesLayout, at: list[str], out: str) -> DataFrame:
    """Mean absolute change along time over all series of a recording, per time step."""
    steps = time_diff(df, value, layout, "_d")
    return steps.groupBy(*at, layout.order).agg(F.avg(F.abs(F.col("_d"))).alias(out))


def energy_limit(energy: DataFrame, value: str, keys: list[str], factor: float = 1.15) -> DataFrame:
    """Upper display limit: 99th percentile times ``factor``, at least 1e-6."""
    top = quantiles(energy, keys, value, {"_q": 0.99})
    return top.select(*keys, F.greatest(F.col("_q") * factor, F.lit(1e-6)).alias("upper"))


def wide(df: DataFrame, keys: list[str], devices: list[str], label: str = "device") -> DataFrame:
    """One row per window position and subcarrier: ``x_<device>`` and change ``d_<device>``.

    The tasks follow from the number of samples. Left to the bytes shuffled, a few tasks would get all: what is made of samples is much larger.
    """
    rows = df.repartition(df.count() // TASK_SAMPLES + 1, *keys).groupBy(*keys, T, "sc").agg(
        *[F.max(F.when(F.col(label) == d, F.col("x"))).alias(f"x_{d}") for d in devices]
    )
    along = Window.partitionBy(*keys, "sc").orderBy(T)
    return rows.withColumns(
        {f"d_{d}": F.col(f"x_{d}") - F.lag(f"x_{d}").over(along) for d in devices}
    )


def pair_change(devices: list[str], along) -> dict[str, Column]:
    out = {}
    for a, b in combinations(devices, 2):
        gap = F.abs(F.col(f"x_{a}") - F.col(f"x_{b}"))
        out[f"p_{a}_{b}"] = gap
        out[f"q_{a}_{b}"] = F.abs(gap - F.lag(gap).over(along))
    return out


def with_pairs(rows: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """Add |x_a - x_b| as ``p_<a>_<b>`` and its absolute change as ``q_<a>_<b>``."""
    return rows.withColumns(pair_change(devices, Window.partitionBy(*keys, "sc").orderBy(T)))


def receiver_spread(devices: list[str]) -> Column:
    """Population standard deviation over the receivers of one position."""
    values = [F.col(f"x_{d}") for d in devices]
    mean = sum(values[1:], values[0]) / len(values)
    return F.sqrt(sum(((v - mean) * (v - mean) for v in values[1:]), (values[0] - mean) ** 2) / len(values))


def _sample_vectors(devices: list[str]) -> list[Column]:
    """(vector name, value) entries one wide row contributes to."""

    def entry(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("vector"), value.alias("value"))

    out = [entry("absolute__receiver_spread", receiver_spread(devices))]
    for d in devices:
        x, dx = F.col(f"x_{d}"), F.col(f"d_{d}")
        for scope in ("global", d):
            out += [
                entry(f"absolute__{scope}_x", x),
                entry(f"absolute__{scope}_abs_x", F.abs(x)),
                entry(f"motion__{scope}_dt", dx),
                entry(f"motion__{scope}_abs_dt", F.abs(dx)),
            ]
    for a, b in combinations(devices, 2):
        out.append(entry(f"absolute__pair_{a}_{b}_absdiff", F.col(f"p_{a}_{b}")))
        out.append(entry(f"motion__pair_{a}_{b}_absdiff_dt", F.col(f"q_{a}_{b}")))
    return out


def _exploded(df: DataFrame, keys: list[str], entries: list[Column]) -> DataFrame:
    return df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*").filter("value is not null")


def packet_energy(rows: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """Mean |change| over subcarriers per position and receiver, and over all receivers."""
    sums = [F.avg(F.abs(F.col(f"d_{d}"))).alias(f"e_{d}") for d in devices]
    energy = rows.groupBy(*keys, T).agg(*sums)
    every = [F.col(f"e_{d}") for d in devices]
    return energy.withColumn("e_global", sum(every[1:], every[0]) / len(every))


def sample_vectors(rows: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """Long rows (keys, vector, value) of all vectors a window is summarised by."""
    samples = _exploded(with_pairs(rows, keys, devices), keys, _sample_vectors(devices))
    energy = packet_energy(rows, keys, devices)
    per_packet = [
        F.struct(F.lit(f"motion__{s}_motion_energy").alias("vector"), F.col(f"e_{s}").alias("value"))
        for s in ["global", *devices]
    ]
    return samples.unionByName(_exploded(energy, keys, per_packet))


def rssi_vectors(packets: DataFrame, keys: list[str]) -> DataFrame:
    """RSSI and its change per receiver as long vectors; one input row per packet."""
    along = Window.partitionBy(*keys, "device").orderBy(T)
    level = F.col("rssi").cast("double")
    step = packets.withColumn("_dr", level - F.lag(level).over(along))
    entries = [
        F.struct(F.concat(F.lit("absolute__"), F.col("device"), F.lit("_rssi")).alias("vector"), level.alias("value")),
        F.struct(
            F.concat(F.lit("motion__"), F.col("device"), F.lit("_rssi_dt")).alias("vector"), F.col("_dr").alias("value")
        ),
    ]
    return _exploded(step, keys, entries)


def sc_profile(rows: DataFrame, keys: list[str], devices: list[str], label: str = "device") -> DataFrame:
    """Mean, deviation and energy of every subcarrier, per receiver."""
    out = rows.groupBy(*keys, "sc").agg(
        *[
            agg
            for d in devices
            for agg in (
                F.avg(f"x_{d}").alias(f"sc_mean_{d}"),
                F.stddev_pop(f"x_{d}").alias(f"sc_std_{d}"),
                F.avg(F.abs(F.col(f"d_{d}"))).alias(f"sc_energy_{d}"),
            )
        ]
    )
    return _by_device(out, [*keys, "sc"], devices, ["sc_mean", "sc_std", "sc_energy"], label)


def t_profile(rows: DataFrame, keys: list[str], devices: list[str], label: str = "device") -> DataFrame:
    """Mean, deviation and energy of every packet, per receiver.

    Energy belongs to the step to the next packet; the last packet repeats the value before.
    """
    base = rows.groupBy(*keys, T).agg(
        *[
            agg
            for d in devices
            for agg in (
                F.avg(f"x_{d}").alias(f"t_mean_{d}"),
                F.stddev_pop(f"x_{d}").alias(f"t_std_{d}"),
                F.avg(F.abs(F.col(f"d_{d}"))).alias(f"_e_{d}"),
            )
        ]
    )
    along = Window.partitionBy(*keys).orderBy(T)
    base = base.withColumns(
        {f"t_energy_{d}": F.coalesce(F.lead(f"_e_{d}").over(along), F.col(f"_e_{d}"), F.lit(0.0)) for d in devices}
    )
    return _by_device(base, [*keys, T], devices, ["t_mean", "t_std", "t_energy"], label)


def _by_device(df: DataFrame, keys: list[str], devices: list[str], names: list[str], label: str) -> DataFrame:
    entry = [
        F.struct(F.lit(d).alias(label), *[F.col(f"{n}_{d}").alias(n) for n in names]) for d in devices
    ]
    return df.select(*keys, F.explode(F.array(*entry)).alias("_e")).select(*keys, "_e.*")


def sequences(rows: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """Long rows (keys, vector, position, value) of the per-subcarrier and per-packet sequences."""

    def stacked(profile: DataFrame, at: str, names: dict[str, str]) -> DataFrame:
        entries = [
            F.struct(
                F.concat(F.lit(f"{kind}__"), F.col("device"), F.lit(f"_{name}")).alias("vector"),
                F.col(at).cast("int").alias("position"),
                F.col(name).alias("value"),
            )
            for name, kind in names.items()
        ]
        return profile.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")

    by_sc = stacked(
        sc_profile(rows, keys, devices), "sc", {"sc_mean": "absolute", "sc_std": "absolute", "sc_energy": "motion"}
    )
    by_t = stacked(t_profile(rows, keys, devices), T, {"t_mean": "absolute", "t_energy": "motion"})
    return by_sc.unionByName(by_t)


def summarise_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    return summary(vectors, [*keys, "vector"], "value")


def window_blocks(samples: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """One row per window: receivers, positions, subcarriers and values of its samples as parallel arrays.

    A window has a fixed number of packets, so an array is small; a map-side combined aggregate brings them together.
    """
    number = F.array_position(F.array(*[F.lit(d) for d in devices]), F.col("device")).cast("int") - 1
    cells = samples.filter(F.col("device").isin(devices)).select(*keys, F.struct(number.alias("d"), F.col(T).cast("int").alias("t"), F.col("sc").cast("int").alias("s"), "x").alias("_c"))
    found = cells.groupBy(*keys).agg(F.collect_list("_c").alias("_c"))
    return found.select(*keys, *[F.col(f"_c.{c}").alias(f"_{c}") for c in ("d", "t", "s", "x")])


def _profile(values: np.ndarray, axes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation over some axes, missing values left out."""
    mean = np.nanmean(values, axis=axes)
    return mean, np.sqrt(np.nanmean((values - np.expand_dims(mean, axes)) ** 2, axis=axes))


def _quantiles(values: np.ndarray, shares: list[float]) -> np.ndarray:
    """Quantiles of each window's values, missing values left out; windows that lack none, which are most, are done at once."""
    gaps = np.isnan(values).any(axis=1)
    out = np.empty((len(shares), len(values)))
    out[:, ~gaps] = np.quantile(values[~gaps], shares, axis=1)
    if gaps.any():
        out[:, gaps] = np.nanquantile(values[gaps], shares, axis=1)
    return out


def _seven(values: np.ndarray) -> np.ndarray:
    """The seven statistics of each window's values (windows x values), missing values left out."""
    mean, std = _profile(values, (1,))
    low, median, high = _quantiles(values, [0.1, 0.5, 0.9])
    return np.stack([mean, std, np.nanmin(values, axis=1), low, median, high, np.nanmax(values, axis=1)], axis=1)


def block_vectors(x: np.ndarray, devices: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Vectors that are summarised, and sequences that are features themselves, of windows of one shape (windows x values).

    ``x`` is (windows, receivers, positions, subcarriers) with NaN for missing samples.
    """
    flat = lambda v: v.reshape(len(v), -1)
    dx = x[:, :, 1:] - x[:, :, :-1]
    vectors = {"absolute__receiver_spread": flat(np.sqrt(((x - x.mean(axis=1, keepdims=True)) ** 2).mean(axis=1)))}
    for name, own, step in [("global", x, dx), *[(d, x[:, [i]], dx[:, [i]]) for i, d in enumerate(devices)]]:
        vectors |= {
            f"absolute__{name}_x": flat(own), f"absolute__{name}_abs_x": flat(np.abs(own)),
            f"motion__{name}_dt": flat(step), f"motion__{name}_abs_dt": flat(np.abs(step)),
        }
    for (i, a), (j, b) in combinations(enumerate(devices), 2):
        gap = np.abs(x[:, i] - x[:, j])
        vectors[f"absolute__pair_{a}_{b}_absdiff"] = flat(gap)
        vectors[f"motion__pair_{a}_{b}_absdiff_dt"] = flat(np.abs(gap[:, 1:] - gap[:, :-1]))
    energy = np.nanmean(np.abs(dx), axis=3)
    vectors["motion__global_motion_energy"] = energy.mean(axis=1)
    sequences = {}
    for i, d in enumerate(devices):
        vectors[f"motion__{d}_motion_energy"] = energy[:, i]
        sc_mean, sc_std = _profile(x[:, i], (1,))
        # Energy belongs to the step to the next packet; the last packet repeats the value before, a single one has none.
        last = energy[:, i, -1:] if energy.shape[2] else np.zeros((len(x), 1))
        sequences |= {
            f"absolute__{d}_sc_mean": sc_mean, f"absolute__{d}_sc_std": sc_std, f"motion__{d}_sc_energy": np.nanmean(np.abs(dx[:, i]), axis=1),
            f"absolute__{d}_t_mean": _profile(x[:, i], (2,))[0], f"motion__{d}_t_energy": np.concatenate([energy[:, i], last], axis=1),
        }
    return {name: values for name, values in vectors.items() if values.shape[1]}, sequences


def _on_blocks(blocks: DataFrame, keys: list[str], devices: list[str], made, columns: str) -> DataFrame:
    """``made(vectors, sequences)`` gives a table (columns as names -> rows x windows) for the windows of one shape; here they meet their keys."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*keys).schema.fields)

    def look(frames):
        for frame in frames:
            shapes = [(max(t) + 1, max(s) + 1) for t, s in zip(frame["_t"], frame["_s"])]
            for shape in set(shapes):
                own = [i for i, s in enumerate(shapes) if s == shape]
                x = np.full((len(own), len(devices), *shape), np.nan)
                for k, i in enumerate(own):
                    row = frame.iloc[i]
                    x[k, row["_d"], row["_t"], row["_s"]] = np.asarray(row["_x"], dtype=float)
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)  # means of nothing stay missing
                    names, table = made(*block_vectors(x, devices))
                part = frame.iloc[np.repeat(own, len(names[1]))][keys].reset_index(drop=True)
                part[names[0]] = np.tile(names[1], len(own))
                for column, values in table.items():
                    part[column] = values.T.ravel()
                yield part.dropna(subset=list(table)[:1])

    return blocks.mapInPandas(look, f"{kinds}, {columns}")


def block_summary(blocks: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """Seven statistics of every vector of a window but those of RSSI: rows (keys, vector, statistics)."""

    def table(vectors, _):
        stats = np.stack([_seven(values) for values in vectors.values()])
        return ("vector", list(vectors)), {s: stats[:, :, k] for k, s in enumerate(STATS)}

    return _on_blocks(blocks, keys, devices, table, "vector string, " + ", ".join(f"{s} double" for s in STATS))


def block_features(blocks: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """All features of a window but those of RSSI as long rows (keys, feature, value)."""

    def table(vectors, sequences):
        out = {}
        for name, values in vectors.items():
            out |= dict(zip([f"{name}_{s}" for s in STATS], _seven(values).T))
        for name, values in sequences.items():
            out |= {f"{name}_{k:03d}": values[:, k] for k in range(values.shape[1])}
        return ("feature", list(out)), {"value": np.stack(list(out.values()))}

    return _on_blocks(blocks, keys, devices, table, "feature string, value double")


def window_features(samples: DataFrame, packets: DataFrame, keys: list[str], devices: list[str]) -> DataFrame:
    """All features of a window as long rows (keys, feature, value).

    Samples become one block per window; its vectors are summarised column by column on blocks of one shape.
    """
    stats = summarise_vectors(rssi_vectors(packets.repartition(*keys), keys), keys)
    entry = [F.struct(F.concat("vector", F.lit(f"_{s}")).alias("feature"), F.col(s).alias("value")) for s in STATS]
    rssi = stats.select(*keys, F.explode(F.array(*entry)).alias("_e")).select(*keys, "_e.*")
    return block_features(window_blocks(samples, keys, devices), keys, devices).unionByName(rssi)


def feature_table(long: DataFrame, keys: list[str], subset: str = "motion_only") -> DataFrame:
    """One row per window: parallel arrays ``names`` and ``features``.

    All rows have the same names, sorted: those that any window has. A feature that a window lacks is 0. The number of names
    follows from receivers, subcarriers and packets of a window, not from the number of windows.
    """
    chosen = materialise(select_features(long, subset))
    if chosen.isEmpty():
        raise ValueError(f"no feature of the set {subset!r}")
    names = F.array(*[F.lit(r["feature"]) for r in chosen.select("feature").distinct().orderBy("feature").collect()])
    packed = chosen.filter("value is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("_v"))
    rows = chosen.select(*keys).distinct().join(packed, keys, "left")
    # A window that has every feature has them in the order of the names; only another one is asked for each.
    known = F.map_from_entries("_v")
    filled = F.when(F.col("_v.feature") == names, F.col("_v.value")).otherwise(F.transform(names, lambda n: F.coalesce(known[n], F.lit(0.0))))
    return rows.select(*keys, names.alias("names"), filled.alias("features"))


def feature_scope(name: str) -> tuple[str, tuple[str, ...]]:
    """What a window feature describes, and the receivers it comes from.

    The kind is ``global`` (all receivers together), ``pair``, ``receiver`` or ``other``.
    """
    words = name.partition("__")[2].split("_")
    if words[0] == "pair":
        return "pair", tuple(words[1:3])
    if words[0] in ("global", "receiver"):
        return ("global", ()) if words[0] == "global" else ("other", ())
    return "receiver", (words[0],)


def select_features(long: DataFrame, subset: str) -> DataFrame:
    """Rows of the feature set ``motion_only``, ``absolute_only`` or ``all``."""
    if subset == "all":
        return long
    if subset not in ("motion_only", "absolute_only"):
        raise ValueError(f"unknown feature set {subset!r}")
    return long.filter(F.col("feature").startswith(subset.removesuffix("_only") + "__"))


def single_receiver_features(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Window features of one receiver (no ``device`` column needed) as long rows."""
    rows = wide(samples.withColumn("_r", F.lit("one")), keys, ["one"], "_r")
    x, dx = F.col("x_one"), F.col("d_one")
    names = {"x": x, "abs_x": F.abs(x), "dt": dx, "abs_dt": F.abs(dx)}
    entries = [F.struct(F.lit(n).alias("vector"), c.alias("value")) for n, c in names.items()]
    energy = packet_energy(rows, keys, ["one"]).select(
        *keys, F.lit("motion_energy").alias("vector"), F.col("e_one").alias("value")
    )
    stats = summarise_vectors(_exploded(rows, keys, entries).unionByName(energy.filter("value is not null")), keys)
    entry = [F.struct(F.concat("vector", F.lit(f"_{s}")).alias("feature"), F.col(s).alias("value")) for s in STATS]
    out = stats.select(*keys, F.explode(F.array(*entry)).alias("_e")).select(*keys, "_e.*")
    for profile, at, fields in (
        (sc_profile(rows, keys, ["one"], "_r"), "sc", ["sc_mean", "sc_std", "sc_energy"]),
        (t_profile(rows, keys, ["one"], "_r"), T, ["t_mean", "t_std", "t_energy"]),
    ):
        many = [
            F.struct(F.format_string(f"{f}_%03d", F.col(at).cast("int")).alias("feature"), F.col(f).alias("value"))
            for f in fields
        ]
        out = out.unionByName(profile.select(*keys, F.explode(F.array(*many)).alias("_e")).select(*keys, "_e.*"))
    return out
