"""Session-level helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes a side may have before it is no longer broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting (tests, notebooks) gets a scratch folder; on a
    cluster a missing setting is an error, because a machine-local folder would lose data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, so that later uses do not repeat it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder, of which later uses read the columns they need."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row: fixed widths from the types; only texts and lists are looked at."""
    fixed, sizes = 0, []
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(c))
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            sizes.append(F.size(c) * 8)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
        else:
            fixed += 8
    out = F.lit(fixed).cast("long")
    for size in sizes:
        out = out + F.greatest(F.coalesce(size, F.lit(0)), F.lit(0))
    return out


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a computed table has at most so many rows and bytes; no more than ``rows`` + 1 rows are looked at."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df.schema)), F.lit(0)).alias("bytes")).first()
    return found["n"] <= rows and found["bytes"] <= size


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a fitted or lookup table that is expected, but not known, to be small.

    The table is computed once and measured. Up to ``BROADCAST_ROWS`` rows and
    ``BROADCAST_BYTES`` it is broadcast, so the large side is not shuffled; a larger table is
    joined by a shuffle, where adaptive execution splits skewed keys.
    """
    table = materialise(table)
    return df.join(F.broadcast(table) if is_small(table) else table, on, how)


def packed(df: DataFrame, rows: int, rows_per_partition: int = 20_000) -> DataFrame:
    """Fewer partitions for a table of known size that is read again and again by a fit.

    Iterative fits run one small job per step, whose cost is the number of tasks. Tables with
    enough rows for their partitions keep them.
    """
    return df.coalesce(rows // rows_per_partition + 1)
