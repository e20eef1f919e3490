"""Connected components of a graph of ids: union-find within partitions, large-star and small-star rounds between them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.runtime import materialise

# Edges of a partition that one task contracts in memory.
PART_EDGES = 200_000


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges ``a > b``: neighbours of a vertex are tied to its least one.

    Large: neighbours above the vertex; small: the vertex and its neighbours below. No neighbour list is gathered: the least
    one is an aggregate and comes back by a join, which adaptive execution splits for a vertex with very many edges.
    """
    if large:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        least = both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("m"))
        tied = both.where("w > v").join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where("a > b").distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges of each partition replaced by one from every vertex to the least that it reaches within the partition."""

    def contract(batches):
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while (up := root.setdefault(v, v)) != v:
                root[v] = v = root[up]
            return v

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        tied = [(v, find(v)) for v in list(root)]
        pairs = [(v, r) for v, r in tied if v != r]
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.mapInArrow(contract, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``v, c`` for every vertex of ``edges`` (columns a, b): the least id that it reaches, itself included.

    Loops, repeated and turned edges are allowed; an empty graph gives an empty table. Every round contracts partitions of
    about ``PART_EDGES`` edges, then ties what lies in several of them; it ends when a round changes no edge, or at once
    if all edges are in one partition. Rounds are checkpointed.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    edges, state = materialise(edges), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state:
            break
        state, parts = now, now[0] // PART_EDGES + 1
        forest = contracted(edges.coalesce(parts))
        if parts == 1:
            edges = materialise(forest)
            break
        edges = materialise(star(star(forest, True), False))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("c")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("c")).distinct())
