"""Near-duplicate documents by b-bit MinHash, every link confirmed on full shingle sets.

1. Each document gets its set of word shingles, a key of the set, 120 minima in 24 bands, and a signature of the low four bits
   of each minimum. Equal sets are one vertex from here on, so exact copies cost one row each.
2. Vertices that share a band meet in buckets; bit counts of their signatures estimate the similarity, corrected for
   chance agreement of low bits. What is likely similar is tied together: the candidate groups.
3. Only members of candidate groups fetch their full sets. A group is cut into blocks of bounded size; likely pairs of a
   block are confirmed exactly, best estimates first, pairs already connected skipped. In groups of several blocks, members
   outside the largest component so found are then held against every block of the group.

A group of any size is so worked in bounded blocks; no list of pairs is written, only a forest of confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, shingle_hashes, text_bytes, text_slices, word_hashes
from motefield.llm.components import components
from motefield.runtime import materialise, new_table_path

WORDS = 5
# A pair of documents is linked if 100 * common >= link * union, unless the caller says otherwise by this link.
LINK = 85
BANDS, ROWS = 24, 5
HASHES, LOW_BITS = BANDS * ROWS, 4
# Members of a bucket compared pair by pair; members and shingles of a block of full sets.
BUCKET_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 512, 512, 500_000

_random = np.random.default_rng(20240229)
FACTOR = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
SHIFT = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
NIBBLES = np.uint64(0x1111111111111111)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (FACTOR[:, None] * x[None, k : k + 4096] + SHIFT[:, None]).min(axis=1), out=out)
    return out


def packed(low: np.ndarray) -> bytes:
    """Low bits of the minima, two to a byte, filled up to whole 64-bit words."""
    bits = (low & ((1 << LOW_BITS) - 1)).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).tobytes().ljust(-(-HASHES // 16) * 8, b"\0")


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a signature to others: agreeing low bits, less what agrees by chance."""
    apart = one ^ many
    apart |= apart >> np.uint64(2)
    apart |= apart >> np.uint64(1)
    agreed = 1 - np.bitwise_count(apart & NIBBLES).sum(axis=1) / HASHES
    chance = 0.5**LOW_BITS
    return (agreed - chance) / (1 - chance)


def least_estimate(link: int) -> float:
    """Pairs estimated below this are not confirmed: five standard errors under the threshold, rounded down to hundredths."""
    chance = 0.5**LOW_BITS
    agreed = chance + (1 - chance) * link / 100
    error = (agreed * (1 - agreed) / HASHES) ** 0.5 / (1 - chance)
    return int(link - 500 * error) / 100


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    shingles, bounds = shingle_hashes(*word_hashes(*text_bytes(column)), WORDS)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield np.unique(shingles[a:b])


def key_of(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


SIGNED = "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>"


def signed(docs: DataFrame) -> DataFrame:
    """Set size, set key, signature and band values of every document; a document without words has only its size."""

    def sign(batches):
        for rows in text_slices(batches):
            sizes, keys, signatures, bands = [], [], [], []
            for shingles in sets_of(rows.column("text")):
                sizes.append(len(shingles))
                keys.append(key_of(shingles))
                if not len(shingles):
                    signatures.append(None)
                    bands.append(None)
                    continue
                low = minima(shingles)
                signatures.append(packed(low))
                bands.append([xxhash.xxh3_64_intdigest(band.tobytes(), seed=k) - (1 << 63) for k, band in enumerate(low.reshape(BANDS, ROWS))])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                ],
                [c.split()[0] for c in SIGNED.split(", ")],
            )

    return docs.mapInArrow(sign, SIGNED)


class Forest:
    """Union-find over places of an array."""

    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.root = first[of].copy()

    def join(self, a: int, b: int) -> bool:
        x, y = self.root[a], self.root[b]
        if x != y:
            self.root[self.root == y] = x
        return x != y


def signatures_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Consecutive rows with equal keys, and whether they begin a key; a run longer than ``most`` comes in parts."""
    held: list[pa.RecordBatch] = []
    key, begins = None, True
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(values) + 1):
            if i < len(values) and values[i] == values[start] and (most is None or i - start < most):
                continue
            if held and (values[start] != key or (most is not None and sum(map(len, held)) >= most)):
                yield pa.Table.from_batches(held), begins
                begins = values[start] != key
                held = []
            held.append(batch.slice(start, i - start))
            key, start = values[start], i
    if held:
        yield pa.Table.from_batches(held), begins


def table_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*edges) if edges else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def likely_ties(vertices: DataFrame, link: int = LINK) -> DataFrame:
    """Edges ``a, b`` that tie together what may be similar within a bucket.

    Up to ``BUCKET_ROWS`` members, likely pairs are tied; the members of a larger bucket are tied part by part to its first
    one without a look, which can only make a candidate group too large.
    """
    rows = vertices.select("v", F.explode("bands").alias("bucket")).withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1")
    rows = rows.join(vertices.select("v", "signature"), "v")

    least = least_estimate(link)

    def tie(batches):
        first = None
        for part, begins in runs(batches, ["bucket"], BUCKET_ROWS):
            ids = part.column("v").to_pylist()
            if part.column("n")[0].as_py() > BUCKET_ROWS:
                first = ids[0] if begins else first
                yield table_of([(first, v) for v in ids if v != first])
                continue
            signatures = signatures_of(part.column("signature"))
            forest, edges = Forest(np.arange(len(ids))), []
            for i in range(len(ids) - 1):
                for j in (np.flatnonzero(estimates(signatures[i], signatures[i + 1 :]) >= least) + i + 1).tolist():
                    if forest.join(i, j):
                        edges.append((ids[i], ids[j]))
            yield table_of(edges)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "v").mapInArrow(tie, "a long, b long").distinct()


def confirmed(table: pa.Table, asking: np.ndarray, link: int = LINK) -> list[tuple[int, int]]:
    """A forest of exact links between the rows ``asking`` and all rows of a block, on top of the labels they have."""
    ids = table.column("v").to_pylist()
    signatures = signatures_of(table.column("signature"))
    sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets])
    forest, edges, least = Forest(table.column("c").to_numpy()), [], least_estimate(link)
    for i in np.flatnonzero(asking).tolist():
        close = estimates(signatures[i], signatures)
        fits = (close >= least) & (100 * np.minimum(sizes, sizes[i]) >= link * np.maximum(sizes, sizes[i]))
        fits &= ~asking | (np.arange(len(ids)) > i)
        order = np.flatnonzero(fits)
        order = order[np.argsort(-close[order], kind="stable")]
        while True:
            order = order[forest.root[order] != forest.root[i]]
            if not len(order):
                break
            some, order = order[:32], order[32:]
            flat = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            common = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            for j in some[100 * common >= link * (sizes[some] + sizes[i] - common)].tolist():
                if forest.join(i, j):
                    edges.append((ids[i], ids[j]))
    return edges


def in_blocks(rows: DataFrame, keys: list[str], link: int = LINK) -> DataFrame:
    """Confirmed links within each block; rows marked ``asking`` are held against all rows of the block."""

    def confirm(batches):
        for part, _ in runs(batches, keys):
            yield table_of(confirmed(part, part.column("asking").to_numpy(), link))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "v").mapInArrow(confirm, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``v, set_key, signature, shingles`` of the wanted vertices, made again from the text of the vertex's document."""

    def build(batches):
        for rows in text_slices(batches):
            keep, found = [], []
            for i, (shingles, key) in enumerate(zip(sets_of(rows.column("text")), rows.column("set_key").to_pylist())):
                if key_of(shingles) == key:
                    keep.append(i)
                    found.append(shingles.tobytes())
            rows = rows.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("set_key"), rows.column("signature"), pa.array(found, pa.binary())], ["v", "set_key", "signature", "shingles"])

    rows = docs.join(wanted.select(F.col("v").alias("doc_id"), "set_key", "signature"), "doc_id")
    made = rows.select("doc_id", "text", "set_key", "signature").mapInArrow(build, "v long, set_key binary, signature binary, shingles binary")
    return made.dropDuplicates(["set_key"])


def links(docs: DataFrame, vertices: DataFrame, link: int = LINK) -> DataFrame:
    """A forest of confirmed links between vertices."""
    spark = docs.sparkSession
    groups = materialise(components(likely_ties(vertices, link)).withColumnRenamed("c", "w"))
    path = new_table_path(spark, "full-sets")
    full_sets(docs, groups.join(vertices, "v")).write.parquet(path)
    sets = spark.read.schema("v long, set_key binary, signature binary, shingles binary").parquet(path)
    sized = groups.join(sets.select("v", (F.octet_length("shingles") / 8).alias("n")), "v").groupBy("w").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    placed = groups.join(sized, "w").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    placed = materialise(placed)
    first = in_blocks(placed.join(sets, "v").withColumns({"c": F.col("v"), "asking": F.lit(True)}), ["w", "block"], link)
    first = materialise(first)
    several = placed.where("blocks > 1")
    if several.isEmpty():
        return first
    labels = several.join(components(first), "v", "left").withColumn("c", F.coalesce("c", "v"))
    labels = materialise(labels)
    largest = labels.groupBy("w", "c").count().groupBy("w").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    rest = labels.join(largest, "w").where("c <> main")
    parts = rest.groupBy("w").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    rest = rest.join(parts, "w").withColumn("part", F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts")).cast("int"))
    asking = rest.select("w", "v", "c", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asking"))
    asked = labels.join(parts, "w").select("w", "v", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.lit(False).alias("asking"))
    return first.unionByName(in_blocks(asking.unionByName(asked).join(sets, "v"), ["w", "part", "block"], link))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per row of ``docs``; pairs of ``link`` hundredths of similarity or more are linked.

    A text without words (null and empty ones too) is linked with nothing. Ids are taken to be unique: rows of a repeated id get
    the component of their own text. A null id takes part without being a component's name; its component is null if it
    reaches no other. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    path = new_table_path(spark, "signatures")
    signed(docs).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(SIGNED).parquet(path)
    words = rows.where("n_shingles > 0")
    vertices = words.groupBy("set_key").agg(F.min("doc_id").alias("v"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).where("v is not null")
    vertices = materialise(vertices)
    found = components(links(docs, vertices, link))
    named = vertices.select("set_key", "v").join(found, "v", "left").select("set_key", F.coalesce("c", "v").alias("component_id"))
    out = words.join(named, "set_key", "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: int = LINK) -> DataFrame:
    """The rows of ``docs`` less those whose id is a near duplicate of a smaller one."""
    gone = near_duplicates(docs, id_col, text_col, link).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
