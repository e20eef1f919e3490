"""Exact k-nearest-neighbour classification without emitting train x test pairs.

The training rows sit in blocks. Each block of training points meets the test points it may
matter for in one Arrow batch, keeps the ``k`` best per test point, and only those candidates
travel on and are merged. A training set of checked size is one block that is shipped to every task, whose result is final. A larger
one is cut into cells around landmark points: a test point is sent to a cell only if the
triangle inequality leaves room for a neighbour there, and crowded cells are cut further, so
no block grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.runtime import materialise

SHIPPED_VALUES = 2_000_000
BLOCK_POINTS = 20_000
LANDMARKS = 256
# Numbers in the largest array that a task works on at once, and in the features of a batch that it sends on.
SLICE_VALUES = 4_000_000


def _distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    if p == 1:
        return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def _best(test: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Test row, place, distance and rank (from 1) of the k nearest points of every test row, ties to the smaller id.

    A matrix product tells which points can be among the nearest, up to rounding; only those are measured exactly and ordered.
    """
    slice_rows = max(1, SLICE_VALUES // max(1, points.size if p == 1 else len(points)))
    pairs = max(1, SLICE_VALUES // max(1, points.shape[1]))
    norms, found = (points**2).sum(axis=1), []
    for start in range(0, len(test), slice_rows):
        rows = test[start : start + slice_rows]
        if p == 1:
            near, slack = _distances(rows, points, 1), 0.0
        else:
            own = (rows**2).sum(axis=1)
            near = own[:, None] + norms[None, :] - 2 * rows @ points.T
            slack = 1e-10 * (own + norms.max(initial=0.0))[:, None]
        bound = np.partition(near, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1, None]
        row, place = np.nonzero(near <= bound + slack)
        if p == 1:
            exact = near[row, place]
        else:  # ties may be many
            parts = [slice(i, i + pairs) for i in range(0, len(row), pairs)]
            exact = np.concatenate([np.sqrt(((rows[row[i]] - points[place[i]]) ** 2).sum(axis=1)) for i in parts] or [np.zeros(0)])
        order = np.lexsort((ids[place], exact, row))
        row, place, exact = row[order], place[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        kept = rank <= k
        found.append((row[kept] + start, place[kept], exact[kept], rank[kept]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _slices(batches: Iterator[pd.DataFrame], centres: np.ndarray, p: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Few rows at a time, with their distances from all centres."""
    size = max(1, SLICE_VALUES // max(1, centres.size))
    for pdf in batches:
        for start in range(0, len(pdf), size):
            part = pdf.iloc[start : start + size]
            yield part, _distances(np.stack(part["features"].to_numpy()).astype(float), centres, p)


def _candidate_frame(pdf, x, k, p, points, ids, labels) -> pd.DataFrame:
    row, place, dist, rank = _best(x, points, ids, k, p)
    return pd.DataFrame(
        {"test_id": pdf["test_id"].to_numpy()[row], "train_id": ids[place], "label": labels[place], "distance": dist, "rank": rank}
    )


SCHEMA = "test_id long, train_id long, label int, distance double, rank int"


def nearest(train: DataFrame, test: DataFrame, k: int, p: int = 2, shipped_values: int = SHIPPED_VALUES) -> DataFrame:
    """The ``k`` nearest training rows of each test row: (test_id, train_id, label, distance, rank).

    ``train(train_id, features, label)``, ``test(test_id, features)``; features are arrays.
    """
    width = len((train.select("features").first() or [[]])[0])
    room = max(1, shipped_values // max(1, width))
    if train.limit(room + 1).count() <= room:
        return _shipped(train, test, k, p)  # one block: its ranks are final
    candidates = _by_cells(train, test, k, p)
    best = Window.partitionBy("test_id").orderBy("distance", "train_id")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _shipped(train: DataFrame, test: DataFrame, k: int, p: int) -> DataFrame:
    local = train.select("train_id", "features", "label").toPandas()
    if local.empty:
        raise ValueError("no training rows")
    points = np.stack(local["features"].to_numpy()).astype(float)
    data = test.sparkSession.sparkContext.broadcast(
        (points, local["train_id"].to_numpy(), local["label"].to_numpy())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pts, ids, labels = data.value
        for pdf in batches:
            if len(pdf):
                yield _candidate_frame(pdf, np.stack(pdf["features"].to_numpy()).astype(float), k, p, pts, ids, labels)

    return test.select("test_id", "features").mapInPandas(run, SCHEMA)


def _by_cells(train: DataFrame, test: DataFrame, k: int, p: int) -> DataFrame:
    spark = train.sparkSession
    digest = F.md5(F.col("train_id").cast("string"))
    marks = train.orderBy(digest).limit(max(LANDMARKS, k)).select("features").toPandas()
    centres = spark.sparkContext.broadcast(np.stack(marks["features"].to_numpy()).astype(float))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, dist in _slices(batches, centres.value, p):
            yield pdf.assign(cell=dist.argmin(axis=1), reach=dist.min(axis=1))

    placed = train.select("train_id", "features", "label").mapInPandas(
        assign, "train_id long, features array<double>, label int, cell int, reach double"
    )
    cells = placed.groupBy("cell").agg(F.max("reach").alias("radius"), F.count("*").alias("n")).toPandas()
    radius = dict(zip(cells["cell"], cells["radius"]))
    parts = {c: -(-int(n) // BLOCK_POINTS) for c, n in zip(cells["cell"], cells["n"])}
    plan = spark.sparkContext.broadcast((radius, parts))
    part_map = F.create_map(*[F.lit(int(v)) for c, n in parts.items() for v in (c, n)])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits, blocks = plan.value
        used = np.array(sorted(limits))
        room = max(1, SLICE_VALUES // max(1, centres.value.shape[1]))
        for pdf, dist in _slices(batches, centres.value, p):
            # The landmarks are training points, so the k-th nearest one bounds the answer.
            bound = np.partition(dist, k - 1, axis=1)[:, k - 1]
            lower = dist[:, used] - np.array([limits[c] for c in used])
            row, col = np.nonzero(lower <= bound[:, None] * (1 + 1e-12) + 1e-12)
            cell = used[col]
            many = np.array([blocks[c] for c in cell])
            part = np.concatenate([np.arange(m) for m in many]) if len(many) else np.array([], dtype=int)
            row, cell = np.repeat(row, many), np.repeat(cell, many)
            ids, features = pdf["test_id"].to_numpy(), pdf["features"].to_numpy()
            for i in range(0, len(row), room):
                own = row[i : i + room]
                yield pd.DataFrame({"test_id": ids[own], "features": features[own], "cell": cell[i : i + room], "part": part[i : i + room]})

    sent = test.select("test_id", "features").mapInPandas(
        send, "test_id long, features array<double>, cell int, part int"
    )
    # Test points meeting one cell are dealt into slices of bounded size, as the cell is into parts.
    sent = materialise(sent)
    meeting = sent.filter("part = 0").groupBy("cell").count().collect()
    slices = {r["cell"]: -(-r["count"] // BLOCK_POINTS) for r in meeting}
    if not slices:
        return sent.sparkSession.createDataFrame([], SCHEMA)
    slice_map = F.create_map(*[F.lit(int(v)) for c, n in slices.items() for v in (c, n)])
    sent = sent.withColumn("slice", F.pmod(F.xxhash64("test_id"), slice_map[F.col("cell")]).cast("int"))
    blocks = placed.filter(F.col("cell").isin(list(slices)))
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("train_id"), part_map[F.col("cell")]).cast("int"))
    blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), slice_map[F.col("cell")] - 1)))

    def meet(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if points.empty or queries.empty:
            return pd.DataFrame({"test_id": [], "train_id": [], "label": [], "distance": [], "rank": []})
        pts = np.stack(points["features"].to_numpy()).astype(float)
        x = np.stack(queries["features"].to_numpy()).astype(float)
        return _candidate_frame(queries, x, k, p, pts, points["train_id"].to_numpy(), points["label"].to_numpy())

    by = ["cell", "part", "slice"]
    return blocks.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(meet, SCHEMA)


def classify(neighbours: DataFrame, weights: str = "uniform") -> DataFrame:
    """Class with the largest (weighted) vote per test row, ties to the smallest class.

    With ``weights='distance'`` neighbours at distance 0 outvote all others.
    """
    if weights == "uniform":
        vote = F.lit(1.0)
    elif weights == "distance":
        zero = F.min("distance").over(Window.partitionBy("test_id")) == 0
        vote = F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    else:
        raise ValueError("weights must be 'uniform' or 'distance'")
    voted = neighbours.withColumn("_v", vote).groupBy("test_id", "label").agg(F.sum("_v").alias("_v"))
    return voted.groupBy("test_id").agg(F.max_by("label", F.struct(F.col("_v"), -F.col("label"))).alias("pred"))
