"""Token ids as length-delimited binary records in shard files, with a separate offset index.

A record is framed as

    length of the payload    unsigned 64-bit
    masked checksum of those 8 bytes    unsigned 32-bit
    payload    doc id (signed 64-bit, a null id as the least value), bytes per token (one byte: 2 or 4), token ids
    masked checksum of the payload    unsigned 32-bit

all little-endian. The checksum is crc32, masked as in other record files (rotated right by 15 bits, plus a constant), so
that checksums of data that hold checksums stay sound. The index is a Parquet table with one row per record: shard,
file, offset, length, doc id and number of tokens. A reader takes any rows of the index in any order and fetches those records alone.

A shard is written by one task under a name of that attempt; the index names only files of tasks that ended well, so a
lost executor leaves at worst a file that nothing refers to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, spread, text_slices
from motefield.llm.vocabulary import byte_vocabulary, tokenizer_path
from motefield.runtime import new_table_path

# Text bytes behind one shard file.
SHARD_BYTES = 32 << 20
# Bytes fetched at once from a shard while neighbouring records are read.
READ_BYTES = 4 << 20
# Added to a rotated checksum (fixed value).
MASK_DELTA = 0xA282EAD8
NO_ID = -(1 << 63)
HEADER, CHECK = struct.Struct("<QI"), struct.Struct("<I")
INDEX = "shard int, file string, offset long, length long, doc_id long, n_tokens long"


class RecordError(ValueError):
    """A record whose frame or checksum is not as written."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + CHECK.pack(masked(length)) + payload + CHECK.pack(masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one whole record."""
    length, check = HEADER.unpack_from(record)
    if masked(record[:8]) != check or len(record) != length + HEADER.size + CHECK.size:
        raise RecordError("the frame of a record is damaged")
    payload = record[HEADER.size : -CHECK.size]
    if CHECK.unpack(record[-CHECK.size :])[0] != masked(payload):
        raise RecordError("the payload of a record is damaged")
    return payload


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack("<qB", NO_ID if doc_id is None else doc_id, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack_from("<qB", payload)
    return None if doc_id == NO_ID else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=9).astype("<u4")


def file_system(path: str):
    """The file system of a shared path and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode every text, append ``end_id`` and write the records in ascending order of the id; returns the index.

    A null text counts as empty (its record holds the end id alone), a null id comes first, rows of one id are ordered by
    their text, an empty table gives an empty index, other columns are not read. Shards are ranges of (id, hash of the
    text), so that even one id on many rows is spread.
    """
    path = path or tokenizer_path("byte_bpe_50k.json")
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = ["shard", "file", "offset", "length", "doc_id", "n_tokens"]

    def write(batches: Iterator[pa.RecordBatch]):
        vocabulary = byte_vocabulary(path)
        task = TaskContext.get()
        file = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        out, at, index = None, 0, []
        for rows in text_slices(batches):
            if out is None:
                store, place = file_system(file)
                store.create_dir(place.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(place)
            parts = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                ids = np.append(vocabulary.encode_array(text), np.uint32(end_id))
                record = frame(pack(doc_id, ids))
                index.append((task.partitionId(), file, at, len(record), doc_id, len(ids)))
                at += len(record)
                parts.append(record)
            out.write(b"".join(parts))
        if out is not None:
            out.close()
        columns = list(zip(*index)) if index else [()] * len(names)
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    ordered = (
        docs.withColumn("h", F.xxhash64("text")).repartitionByRange(spread(size, SHARD_BYTES), F.asc_nulls_first("doc_id"), "h")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "text").select("doc_id", "text")
    )
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Records of the index rows in their order; neighbours in a file are read in one go, a damaged record is an error."""
    name, source = None, None
    for batch in batches:
        files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        first = 0
        while first < len(files):
            last, end = first, offsets[first]
            while last < len(files) and files[last] == files[first] and offsets[last] == end and (last == first or end + lengths[last] - offsets[first] <= READ_BYTES):
                end += lengths[last]
                last += 1
            if files[first] != name:
                store, place = file_system(files[first])
                name, source = files[first], store.open_input_file(place)
            source.seek(offsets[first])
            raw = source.read(end - offsets[first])
            base = offsets[first]
            yield batch.slice(first, last - first), [raw[o - base : o - base + n] for o, n in zip(offsets[first:last], lengths[first:last])]
            first = last


def read_records(index: DataFrame) -> DataFrame:
    """``shard, offset, doc_id, token_ids`` of the records that the index rows name, read from the files.

    Any subset or order of the index will do: shuffle or filter it for random access.
    """

    def read(batches):
        for rows, records in fetch(batches):
            parts = [unpack(unframe(r)) for r in records]
            bounds = np.concatenate([[0], np.cumsum([len(ids) for _, ids in parts])]).astype(np.int32)
            flat = np.concatenate([ids for _, ids in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("shard"), rows.column("offset"), pa.array([d for d, _ in parts], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))],
                ["shard", "offset", "doc_id", "token_ids"],
            )

    return index.mapInArrow(read, "shard int, offset long, doc_id long, token_ids array<int>")


def record_digests(index: DataFrame) -> DataFrame:
    """``shard, offset, doc_id, n_tokens, ids_crc32`` from the files: crc32 of the ids as little-endian 32-bit numbers."""

    def read(batches):
        for rows, records in fetch(batches):
            parts = [unpack(unframe(r)) for r in records]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("shard"), rows.column("offset"), pa.array([d for d, _ in parts], pa.int64()),
                    pa.array([len(ids) for _, ids in parts], pa.int64()), pa.array([zlib.crc32(ids.tobytes()) for _, ids in parts], pa.int64()),
                ],
                ["shard", "offset", "doc_id", "n_tokens", "ids_crc32"],
            )

    return index.mapInArrow(read, "shard int, offset long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(records: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids before each record in shard order.

    Totals per shard are added up first (one row for every 32 MB of text), so no window holds more than a shard.
    """
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    placed = records.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("inside"))


def record_folder(spark) -> str:
    return new_table_path(spark, "records")
