"""Bounds, scaling and principal components of every key from one mergeable aggregate.

A task keeps count, sums, bounds and the packed upper triangle of products for each key of its batches; these partial rows are
added up by Spark entry by entry. What follows from them (standardisation, components, their cut) is worked out per key, in parallel.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reaching(shares: list[float], target: float = 0.95) -> int:
    """How many leading shares add up to ``target``."""
    total = np.cumsum(shares)
    reached = np.flatnonzero(total >= target - 1e-12)
    return int(reached[0]) + 1 if len(reached) else len(shares)


def packed_products(rows: np.ndarray) -> np.ndarray:
    return (rows.T @ rows)[np.triu_indices(rows.shape[1])]


def gram_table(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per key: ``n``, ``low``, ``high``, ``mean`` (arrays over the columns) and ``covariance`` (population, packed upper triangle).

    Products are taken about the values of one row of the table, so that large means cost no digits. Rows with a missing
    value are left out.
    """
    width, text = len(columns), F.col(key).cast("string").alias(key)
    rows = df.select(text, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(subset=columns)
    about = rows.select(*columns).first()
    about = np.zeros(width) if about is None else np.array(list(about), dtype=float)

    def partial(frames):
        for frame in frames:
            out = []
            for name, part in frame.groupby(key, dropna=False, sort=False):
                x = part[columns].to_numpy(dtype=float)
                moved = x - about
                sums = np.concatenate([[len(x)], moved.sum(axis=0), packed_products(moved)])
                out.append((name, sums.tolist(), x.min(axis=0).tolist(), x.max(axis=0).tolist()))
            yield pd.DataFrame(out, columns=[key, "sums", "low", "high"])

    parts = rows.mapInPandas(partial, f"{key} string, sums array<double>, low array<double>, high array<double>")

    def merged(name: str, how) -> DataFrame:
        entries = parts.select(key, F.posexplode(name).alias("i", "v")).groupBy(key, "i").agg(how("v").alias("v"))
        return entries.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias(name))

    def finish(frames):
        a, b = np.triu_indices(width)
        for frame in frames:
            out = []
            for name, sums, low, high in zip(frame[key], frame["sums"], frame["low"], frame["high"]):
                sums = np.asarray(sums, dtype=float)
                n, mean = sums[0], sums[1 : width + 1] / sums[0]
                covariance = sums[width + 1 :] / n - mean[a] * mean[b]
                out.append((name, int(n), list(low), list(high), (mean + about).tolist(), covariance.tolist()))
            yield pd.DataFrame(out, columns=[key, "n", "low", "high", "mean", "covariance"])

    whole = merged("sums", F.sum).join(merged("low", F.min), key).join(merged("high", F.max), key)
    arrays = ", ".join(f"{c} array<double>" for c in ("low", "high", "mean", "covariance"))
    return whole.mapInPandas(finish, f"{key} string, n long, {arrays}")


def component_table(grams: DataFrame, key: str, width: int, target: float = 0.95) -> DataFrame:
    """Standardisation and principal components of every key.

    Adds ``scale`` (population deviation, 1 for a constant column), ``evr`` (share of variance of each component), ``k_95`` (leading components
    up to the target share) and ``loadings`` (components x columns; the entry of largest size is positive).
    """
    a, b = np.triu_indices(width)

    def components(frames):
        for frame in frames:
            out = []
            for packed in frame["covariance"]:
                full = np.zeros((width, width))
                full[a, b] = full[b, a] = np.asarray(packed, dtype=float)
                spread = np.sqrt(np.maximum(np.diag(full), 0.0))
                constant = spread <= 1e-12 * np.maximum(1.0, np.abs(full).max())
                scale = np.where(constant, 1.0, spread)
                values, vectors = np.linalg.eigh(np.where(constant[:, None] | constant[None, :], 0.0, full / np.outer(scale, scale)))
                values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
                signs = np.sign(vectors[np.arange(width), np.abs(vectors).argmax(axis=1)])
                shares = values / values.sum() if values.sum() else np.full(width, 1.0 / width)
                out.append((scale.tolist(), shares.tolist(), first_reaching(list(shares), target), (vectors * signs[:, None]).tolist()))
            made = pd.DataFrame(out, columns=["scale", "evr", "k_95", "loadings"])
            yield pd.concat([frame.reset_index(drop=True), made], axis=1)

    known = ", ".join(f"{c} array<double>" for c in ("low", "high", "mean", "covariance"))
    return grams.mapInPandas(components, f"{key} string, n long, {known}, scale array<double>, evr array<double>, k_95 int, loadings array<array<double>>")


def clipped_values(columns: list[str], low: Column, high: Column) -> Column:
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return F.transform(F.arrays_zip(values.alias("v"), low.alias("a"), high.alias("b")), lambda e: F.least(F.greatest(e["v"], e["a"]), e["b"]))


def projected(values: Column, mean: Column, scale: Column, loadings: Column, k: Column) -> Column:
    """The leading components of a row of values."""
    z = F.transform(F.arrays_zip(values.alias("v"), mean.alias("m"), scale.alias("s")), lambda e: (e["v"] - e["m"]) / e["s"])
    dot = lambda row: F.aggregate(F.zip_with(row, z, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return F.transform(F.slice(loadings, 1, k), dot)


class Projection(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Standardisation and leading components of one key as a pipeline stage, in column expressions."""

    state = Param(Params._dummy(), "state", "columns, mean, scale and loadings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, outputCol="features", state=None):
        super().__init__()
        self._setDefault(outputCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        made = json.loads(self.getOrDefault(self.state))
        values = F.array(*[F.col(c).cast("double") for c in made["columns"]])
        numbers = lambda row: F.array(*[F.lit(float(v)) for v in row])
        loadings = F.array(*[numbers(row) for row in made["loadings"]])
        found = projected(values, numbers(made["mean"]), numbers(made["scale"]), loadings, F.lit(len(made["loadings"])))
        return df.withColumn(self.getOutputCol(), array_to_vector(found))


def projection(columns: list[str], row) -> Projection:
    """The stage of one row of :func:`component_table`."""
    k = row["k_95"]
    state = {"columns": columns, "mean": list(row["mean"]), "scale": list(row["scale"]), "loadings": [list(r) for r in row["loadings"][:k]]}
    return Projection(state=json.dumps(state))
