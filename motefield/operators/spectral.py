"""Power spectrum of a unit and the five scalars derived from it.

Units up to ``FFT_ROWS`` packets are transformed in batches inside an Arrow UDF. Longer ones
are transformed by a chirp-z convolution whose transforms are cut into ``rows x columns``
pieces of about sqrt(n) values (the four-step method): every piece is one small group, so a
unit of any length is spread over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motefield.functions.iq import exploded
from motefield.ranking import BUCKET, running_totals
from motefield.series import BLOCK_ROWS, SeriesLayout

FFT_ROWS = 1_000_000
SCALARS = [
    "spectral_centroid", "spectral_spread", "spectral_entropy", "dominant_freq", "spectral_rolloff_85",
]


def _power(x: np.ndarray) -> np.ndarray:
    spectrum = np.fft.rfft(x)
    return spectrum.real**2 + spectrum.imag**2


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def power_array(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda x: _power(np.asarray(x, dtype=float)))


def _scalars(x: np.ndarray) -> tuple[float, ...]:
    power = _power(x)
    total = power.sum()
    if len(x) < 2 or total <= 0:
        return (0.0,) * len(SCALARS)
    freq = np.arange(len(power)) / len(x)
    share = power / total
    centroid = float(freq @ share)
    reached = np.cumsum(power) >= 0.85 * total
    return (
        centroid,
        math.sqrt(float((freq - centroid) ** 2 @ share)),
        float(-(share @ np.log2(share + 1e-12))),
        float(freq[power.argmax()]),
        float(freq[reached.argmax()]),
    )


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in SCALARS]))
def spectral_struct(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [_scalars(np.asarray(x, dtype=float)) for x in batch]
        yield pd.DataFrame(rows, columns=SCALARS, dtype=float)


def ordered_values(value: str, layout: SeriesLayout) -> Column:
    """The values of a unit in order, as one array; for units of bounded length."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(layout.order), F.col(value))))
    return F.transform(pairs, lambda p: p[value])


def unit_arrays(df: DataFrame, value: str, layout: SeriesLayout) -> DataFrame:
    return df.groupBy(*layout.keys).agg(ordered_values(value, layout).alias("_x"))


def power_spectrum(
    df: DataFrame, value: str, layout: SeriesLayout, fft_rows: int = FFT_ROWS
) -> DataFrame:
    """Rows (keys, k, freq, power) for the bins 0 .. n/2."""
    keys = list(layout.keys)
    if layout.longest <= fft_rows:
        arrays = unit_arrays(df, value, layout)
        power = arrays.select(*keys, F.size("_x").alias("_n"), power_array("_x").alias("_p"))
        bins = exploded(power, [*keys, "_n"], F.col("_p"), "k", "power")
        return bins.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") / F.col("_n")).alias("freq"), "power")
    return _spread_power(df, value, layout)


def spectral_features(
    df: DataFrame, value: str, layout: SeriesLayout, fft_rows: int = FFT_ROWS
) -> DataFrame:
    """Centroid, spread, entropy, dominant frequency and 85 % roll-off, one row per unit."""
    keys = list(layout.keys)
    if layout.longest <= fft_rows:
        return unit_arrays(df, value, layout).select(*keys, spectral_struct("_x").alias("_s")).select(*keys, "_s.*")
    bins = _spread_power(df, value, layout).withColumn(BUCKET, F.floor(F.col("k") / BLOCK_ROWS))
    run = running_totals(
        bins, keys, [F.col("k")], {"_cum": F.col("power"), "_fp": F.col("freq") * F.col("power")}, BUCKET
    )
    total, freq, power = F.col("_cum_total"), F.col("freq"), F.col("power")
    share, centre = power / total, F.col("_fp_total") / F.col("_cum_total")
    some = total > 0
    out = run.groupBy(*keys).agg(
        F.max(F.when(some, centre)).alias(SCALARS[0]),
        F.sqrt(F.sum(F.when(some, (freq - centre) ** 2 * share))).alias(SCALARS[1]),
        (-F.sum(F.when(some, share * F.log2(share + 1e-12)))).alias(SCALARS[2]),
        F.max_by(F.when(some, freq), F.struct(power, -F.col("k"))).alias(SCALARS[3]),
        F.min(F.when(some & (F.col("_cum") >= 0.85 * total), freq)).alias(SCALARS[4]),
    )
    return out.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in SCALARS])


def _dense(pdf: pd.DataFrame, place: str, size: int) -> np.ndarray:
    """Group rows as a complex vector; positions without a row are zero."""
    vector = np.zeros(size, dtype=complex)
    vector[pdf[place].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
    return vector


def _columns_step(df: DataFrame, by: list[str], key_types: str) -> DataFrame:
    """Transform along the rows of each column ``c`` and apply the twiddle factors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2, column = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0]), int(pdf["c"].iloc[0])
        k = np.arange(n1)
        out = np.fft.fft(_dense(pdf, "r", n1)) * np.exp(-2j * np.pi * k * (column / (n1 * n2)))
        head = pdf.iloc[[0]][[*by, "n", "n1", "n2"]]
        rows = head.loc[head.index.repeat(n1)].reset_index(drop=True)
        return rows.assign(c=column, k1=k, re=out.real, im=out.imag)

    schema = f"{key_types}, n long, n1 long, n2 long, c long, k1 long, re double, im double"
    return df.groupBy(*by, "c").applyInPandas(run, schema)


def _split_index(df: DataFrame, index: str) -> DataFrame:
    return df.withColumns(
        {"r": F.floor(F.col(index) / F.col("n2")).cast("long"), "c": F.col(index) % F.col("n2")}
    )


def _spread_power(df: DataFrame, value: str, layout: SeriesLayout) -> DataFrame:
    keys = list(layout.keys)
    key_types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    t = layout.order
    rows = _with_lengths(df.select(*keys, F.col(t), F.col(value).cast("double").alias("_x")), layout)
    bits = F.ceil(F.log2(F.greatest(2 * F.col("n") - 1, F.lit(4))))
    wide = rows.withColumn("_m", F.pow(F.lit(2.0), bits).cast("long")).withColumn(
        "n2", F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    ).withColumn("n1", F.floor(F.col("_m") / F.col("n2")).cast("long"))
    # Chirp exp(i pi j^2 / n) with the square reduced in exact integers.
    j = F.col(t).cast("decimal(19,0)")
    angle = (j * j % (2 * F.col("n")).cast("decimal(19,0)")).cast("double") * math.pi / F.col("n")
    wide = wide.withColumns({"_re": F.cos(angle), "_im": F.sin(angle)})
    at = F.col(t).cast("long")

    def point(part, place, re, im):
        return F.struct(F.lit(part).alias("part"), place.alias("j"), re.alias("re"), im.alias("im"))

    points = F.array_compact(
        F.array(
            point(0, at, F.col("_x") * F.col("_re"), -F.col("_x") * F.col("_im")),
            point(1, at, F.col("_re"), F.col("_im")),
            F.when(at > 0, point(1, F.col("_m") - at, F.col("_re"), F.col("_im"))),
        )
    )
    spread = wide.select(*keys, "n", "n1", "n2", F.explode_outer(points).alias("_p")).select(
        *keys, "n", "n1", "n2", "_p.*"
    )
    halfway = _columns_step(_split_index(spread, "j"), [*keys, "part"], f"{key_types}, part int")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2, k1 = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0]), int(pdf["k1"].iloc[0])
        signal, chirp = (np.fft.fft(_dense(pdf[pdf["part"] == p], "c", n2)) for p in (0, 1))
        product = np.conj(signal * chirp)
        head = pdf.iloc[[0]][[*keys, "n", "n1", "n2"]]
        out = head.loc[head.index.repeat(n2)].reset_index(drop=True)
        return out.assign(j=k1 + n1 * np.arange(n2), re=product.real, im=product.imag)

    product = halfway.groupBy(*keys, "k1").applyInPandas(
        multiply, f"{key_types}, n long, n1 long, n2 long, j long, re double, im double"
    )
    back = _columns_step(_split_index(product, "j"), keys, key_types)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, n1, n2, k1 = (int(pdf[c].iloc[0]) for c in ("n", "n1", "n2", "k1"))
        out = np.fft.fft(_dense(pdf, "c", n2)) / (n1 * n2)
        k = k1 + n1 * np.arange(n2)
        kept = k <= n // 2
        head = pdf.iloc[[0]][[*keys, "n"]]
        rows = head.loc[head.index.repeat(int(kept.sum()))].reset_index(drop=True)
        return rows.assign(k=k[kept], power=(np.abs(out) ** 2)[kept])

    bins = back.groupBy(*keys, "k1").applyInPandas(finish, f"{key_types}, n long, k long, power double")
    return bins.select(*keys, "k", (F.col("k") / F.col("n")).alias("freq"), "power")


def _with_lengths(df: DataFrame, layout: SeriesLayout) -> DataFrame:
    """Attach the series length; long series are joined block by block."""
    block = F.floor(F.col(layout.order) / layout.block_rows).cast("long")
    sizes = df.groupBy(*layout.keys).agg(F.count("*").alias("n"))
    per_block = sizes.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / layout.block_rows).cast("long")))
    )
    return df.withColumn("_b", block).join(per_block, [*layout.keys, "_b"]).drop("_b")
