"""SimHash fingerprints of texts, their likeness, and search within a Hamming radius by permuted block tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, mixed, shingle_hashes, spread, text_bytes, text_slices, word_hashes
from motefield.runtime import new_table_path

BITS = 128
# Words of a term; a term's weight is the number of its occurrences.
TERM_WORDS = 3
# Text bytes of a range of documents in id order.
RANGE_BYTES = 32 << 20
# Bits in which near copies may differ: texts with a Jaccard likeness of 0.8 or more lie 11 bits apart in the middle.
RADIUS = 16


def fingerprints(column: pa.Array) -> np.ndarray:
    """128-bit fingerprints as two unsigned numbers each.

    Every occurrence of a term votes on each bit with the signed bit of the term's hash; a bit is set if more votes are
    for it than against it. A text without words has no bit set.
    """
    terms, bounds = shingle_hashes(*word_hashes(*text_bytes(column)), TERM_WORDS)
    out = np.zeros((len(column), 2), dtype=np.uint64)
    held = np.flatnonzero(np.diff(bounds))
    if not len(held):
        return out
    counts = np.diff(bounds)[held]
    for half in range(2):
        votes = mixed(terms + np.uint64(half * 0xA0761D6478BD642F + half))
        bits = np.unpackbits(votes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        yes = np.add.reduceat(bits, bounds[:-1][held], axis=0, dtype=np.int32)
        out[held, half] = np.packbits(2 * yes > counts[:, None], axis=1).view(">u8").ravel()
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the two texts' term weights as the fingerprints tell it, 0 where they lean apart."""
    return np.maximum(0.0, np.round(np.cos(np.pi * distance(a, b) / BITS), 9))


def hex_of(prints: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in prints.tolist()]


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def compared(doc_ids: list, texts: list[str]) -> list[pa.Array]:
    """Result columns of all rows but the last, each next to the row that follows it."""
    edited, sizes = [], []
    for text, after in zip(texts, texts[1:]):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
        sizes.append(len(text))
    own, changed = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(edited, pa.large_string()))
    return [
        pa.array(doc_ids[: len(edited)], pa.int64()),
        pa.array(sizes, pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array(hex_of(own[:-1]), pa.string()),
        pa.array(hex_of(changed), pa.string()),
        pa.array(likeness(own[:-1], changed)),
        pa.array(likeness(own[:-1], own[1:])),
    ]


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in descending order of the id (after the last: the first).

    The documents are laid out once in ranges of (id, hash of the text) and read in order; the last row of a range is compared
    with the first of the next in a second, small step. A null text counts as empty and has the fingerprint without a bit;
    null ids come last; rows of one id are ordered by hash and text; a lone document follows itself; an empty table gives an empty
    one; other columns are not read.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def scan(batches):
        part = TaskContext.get().partitionId()
        head, doc_ids, texts = None, [], []
        for rows in text_slices(batches):
            doc_ids += rows.column("doc_id").to_pylist()
            texts += rows.column("text").to_pylist()
            if head is None:
                head = texts[0]
            n = len(texts) - 1
            yield pa.RecordBatch.from_arrays([*compared(doc_ids, texts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], columns)
            doc_ids, texts = doc_ids[-1:], texts[-1:]
        if texts:
            blank = [pa.nulls(1, pa.int64()), *[pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]]
            edge = [pa.array([part], pa.int32()), pa.array([head], pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *blank, *edge], columns)

    columns = [*NAMES, "part", "head", "tail"]
    ordered = (
        docs.withColumn("h", F.xxhash64("text")).repartitionByRange(spread(size, RANGE_BYTES), F.desc("doc_id"), "h")
        .sortWithinPartitions(F.desc("doc_id"), "h", "text").select("doc_id", "text")
    )
    schema = f"{ROWS}, part int, head string, tail string"
    path = new_table_path(spark, "fingerprints")
    ordered.mapInArrow(scan, schema).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    edges = table.where("part is not null")
    parts = sorted(r.part for r in edges.select("part").collect())
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follows int")
    pairs = edges.select("doc_id", "part", "tail").join(following, "part").join(edges.select(F.col("part").alias("follows"), "head"), "follows")

    def close(batches):
        for rows in text_slices(batches, "tail"):
            done = [compared([i], [a, b]) for i, a, b in zip(*(rows.column(c).to_pylist() for c in ("doc_id", "tail", "head")))]
            yield from (pa.RecordBatch.from_arrays(d, NAMES) for d in done)

    return table.where("part is null").select(*NAMES).unionByName(pairs.select("doc_id", "tail", "head").mapInArrow(close, ROWS))


def halves(column: str) -> list:
    """The two signed halves of a hexadecimal fingerprint; a lower half above the signed range wraps around."""
    out = []
    for i in range(2):
        high = F.conv(F.substring(column, 1 + 16 * i, 8), 16, 10).cast("long")
        low = F.conv(F.substring(column, 9 + 16 * i, 8), 16, 10).cast("long")
        out.append(F.shiftleft(high, 32).bitwiseOR(low))
    return out


def block_layout(radius: int) -> tuple[list[tuple[int, int, int]], int]:
    """Blocks as (half, shift, width), and the most bits in which one block at least agrees within the radius.

    There are so many blocks that the flips to try are two at most: 22 bits and 254 keys a block for a radius of 16.
    """
    per_half = max(2, -(-(radius // 3 + 1) // 2))
    edges = [k * 64 // per_half for k in range(per_half + 1)]
    return [(half, low, high - low) for half in range(2) for low, high in zip(edges, edges[1:])], radius // (2 * per_half)


def block_of(half: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(half, shift).bitwiseAND(F.lit((1 << width) - 1))


def flipped(key: Column) -> Callable[[Column], Column]:
    return lambda flip: key.bitwiseXOR(flip)


def table_keys(radius: int, probes: bool) -> Column:
    """Keys of a fingerprint in all block tables: table number and block as one number; with all flips of few bits if asked for."""
    blocks, most = block_layout(radius)
    keys = []
    for table, (half, shift, width) in enumerate(blocks):
        key = block_of(F.col(f"half_{half}"), shift, width).bitwiseOR(F.lit(table << 32))
        flips = [sum(1 << bit for bit in bits) for n in range(most + 1 if probes else 1) for bits in combinations(range(width), n)]
        every = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")
        keys.append(F.transform(every, flipped(key)))
    return F.explode(F.concat(*keys))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs ``query, fingerprint, distance`` of distinct fingerprints that differ in at most ``radius`` bits.

    ``queries`` and ``prints`` hold a hexadecimal column ``fingerprint``; nulls are left out, equal ones are taken once. Two fingerprints
    within the radius differ in at most radius / blocks bits of one block, so a query that asks each block table for its own block and for
    all blocks that few flips make of it meets every such fingerprint. A pair counts in the first table in which it meets. Every fingerprint
    is stored once a table; only queries are multiplied. A hot block is split by the adaptive join.
    """
    blocks, most = block_layout(radius)
    sides = []
    for side, name, probes in ((queries, "q", True), (prints, "f", False)):
        rows = side.select("fingerprint").where("fingerprint is not null").distinct()
        rows = rows.select(*[h.alias(f"half_{i}") for i, h in enumerate(halves("fingerprint"))])
        sides.append(rows.select(table_keys(radius, probes).alias("key"), *[F.col(f"half_{i}").alias(f"{name}{i}") for i in range(2)]))
    other = [F.col(f"q{i}").bitwiseXOR(F.col(f"f{i}")) for i in range(2)]
    apart = F.bit_count(other[0]) + F.bit_count(other[1])
    first = F.coalesce(*[F.when(F.bit_count(block_of(other[half], shift, width)) <= most, table) for table, (half, shift, width) in enumerate(blocks)])
    # Sizes are estimated before keys are multiplied, so neither side may be broadcast by estimate.
    met = sides[0].hint("merge").join(sides[1].hint("merge"), "key").where((apart <= radius) & (first == F.shiftright("key", 32)))
    hexed = [F.concat(*[F.lpad(F.lower(F.hex(f"{n}{i}")), 16, "0") for i in range(2)]) for n in "qf"]
    return met.select(hexed[0].alias("query"), hexed[1].alias("fingerprint"), apart.alias("distance"))
