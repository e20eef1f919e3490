"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes of a text sets chunk borders, so equal passages give equal chunks wherever they stand. Chunks
that occur more than once in the corpus are encoded once, in Spark; what lies between them is encoded in place. The ids
of neighbouring pieces are then joined by re-encoding a window around each border, which grows until its ids agree with
both sides at a cut that no token can cross.

Only shared chunks and the documents that hold one are shuffled. Which chunks are shared is known exactly after one
aggregation of their keys; the scan learns it through a Bloom filter of bounded size, whose false positives only send some
further chunks the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, text_bytes, text_slices
from motefield.llm.vocabulary import ByteVocabulary, byte_vocabulary, tokenizer_path
from motefield.runtime import new_table_path

LEAST_BYTES, MOST_BYTES = 256, 8192
# A border falls where the leading bits of the rolling hash are zero: every 1024 bytes on average.
BORDER_BITS = 10
WINDOW = 32
# Bits for each shared chunk, and the bound of the whole filter: 2**27 bits, 16 MB.
FILTER_BITS_EACH, FILTER_BITS_MOST, PROBES = 16, 1 << 27, 4

GEAR = np.array([xxhash.xxh32_intdigest(bytes([b])) for b in range(256)], dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """Gear hash of the last 32 bytes at every byte, by doubling the window."""
    h = GEAR[data]
    span = 1
    while span < WINDOW:
        more = h[:-span] << np.uint32(span)
        h[span:] += more
        span *= 2
    return h


def chunk_borders(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Chunk borders of each text of a slice, its start and end included; an empty text has none.

    Depends on the text alone: the window of the hash is shorter than the least chunk. Borders are moved to the next
    code point.
    """
    spots = np.flatnonzero(rolling_hash(data) >> np.uint32(32 - BORDER_BITS) == 0) + 1
    inside = (data & 0xC0) == 0x80
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        borders = [start] if end > start else []
        at = start
        while end > start:
            k = np.searchsorted(spots, at + LEAST_BYTES)
            cut = min(int(spots[k]) if k < len(spots) else end, at + MOST_BYTES)
            while cut < end and inside[cut]:
                cut += 1
            if cut >= end:
                borders.append(end)
                break
            borders.append(cut)
            at = cut
        out.append(borders)
    return out


def chunks(column: pa.Array) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each text of a column its chunks as (key, bytes)."""
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    for borders in chunk_borders(data, offsets):
        parts = [raw[a:b] for a, b in zip(borders, borders[1:])]
        yield [(xxhash.xxh3_128_digest(part), part) for part in parts]


def shared_chunk_keys(docs: DataFrame) -> DataFrame:
    """Keys of the chunks that occur more than once; counted per slice before the shuffle."""

    def count(batches):
        for rows in text_slices(batches):
            found: dict[bytes, int] = {}
            for parts in chunks(rows.column("text")):
                for key, _ in parts:
                    found[key] = found.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "n"])

    counts = docs.select("text").mapInArrow(count, "key binary, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def probe_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 16-byte keys, one row of ``PROBES`` for each."""
    halves = keys.view(np.uint64).reshape(-1, 2)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter over the keys as 64-bit words, put together in Spark word by word."""
    n = keys.count()
    bits = 1 << 10
    while bits < min(FILTER_BITS_EACH * n, FILTER_BITS_MOST):
        bits *= 2

    def words(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=np.uint8)
            at = np.unique(probe_bits(raw, bits)) if len(raw) else np.zeros(0, np.uint64)
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(first) else at
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

    found = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def may_be_shared(parts: list[tuple[bytes, bytes]], words: np.ndarray) -> list[bool]:
    if not parts:
        return []
    at = probe_bits(np.frombuffer(b"".join(key for key, _ in parts), dtype=np.uint8), len(words) * 64)
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1).tolist()


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian bytes, two each: the vocabulary has fewer than 65,536."""
    return np.array(ids, dtype="<u2").tobytes()


def encoded_chunks(docs: DataFrame, words, path: str) -> DataFrame:
    """``key, ids`` of every chunk that passes the filter, each encoded once."""

    def texts(batches):
        for rows in text_slices(batches):
            found: dict[bytes, bytes] = {}
            for parts in chunks(rows.column("text")):
                found.update(part for part, hit in zip(parts, may_be_shared(parts, words.value)) if hit)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["key", "chunk"])

    def encode(batches):
        vocabulary = byte_vocabulary(path)
        for batch in batches:
            ids = [packed(vocabulary.encode(part.decode())) for part in batch.column("chunk").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.binary())], ["key", "ids"])

    once = docs.select("text").mapInArrow(texts, "key binary, chunk binary").dropDuplicates(["key"])
    return once.mapInArrow(encode, "key binary, ids binary")


def is_cut(vocabulary: ByteVocabulary, before: int, after: int) -> bool:
    """Whether a text may be cut between two ids without any effect on the ids of its parts.

    The later one begins with a space and the earlier one ends with a printing ASCII character: no pattern of the
    vocabulary spans the two, and none looks behind.
    """
    return vocabulary.tokens[after][0] == 0x20 and 0x21 <= vocabulary.tokens[before][-1] <= 0x7E


def last_cut(vocabulary: ByteVocabulary, ids: list[int], end: int) -> int:
    """The last cut before index ``end``; 0, the start of the text, if there is none."""
    return next((i for i in range(end - 1, 0, -1) if is_cut(vocabulary, ids[i - 1], ids[i])), 0)


def next_cut(vocabulary: ByteVocabulary, ids: list[int], start: int) -> int:
    """The first cut after index ``start``; the end of the text if there is none."""
    return next((i for i in range(start + 1, len(ids)) if is_cut(vocabulary, ids[i - 1], ids[i])), len(ids))


def join_ids(vocabulary: ByteVocabulary, left: list[int], right: list[int]) -> None:
    """Append the text of ``right`` to that of ``left``, in ids and in place.

    The window re-encoded reaches from a cut of the left side to a cut of the right one, with one more pretoken on
    either side, whose ids must come out as they were; else the window is widened by a cut. At worst it is both texts.
    """
    a, b = len(left), 0
    while True:
        a, b = last_cut(vocabulary, left, a), next_cut(vocabulary, right, b)
        start, end = last_cut(vocabulary, left, a), next_cut(vocabulary, right, b)
        window = vocabulary.encode(vocabulary.decode(left[start:] + right[:end]))
        before, after = left[start:a], right[b:end]
        agreed = window[: len(before)] == before and window[len(window) - len(after) :] == after
        if agreed or (start == 0 and end == len(right)):
            del left[start:]
            left += window
            left += right[end:]
            return


def digest(vocabulary: ByteVocabulary, ids: list[int]) -> tuple[int, str, str]:
    """Count, sha256 of the decimal ids, sha256 of the decoded text."""
    decimals = vocabulary.decimals
    return (
        len(ids),
        hashlib.sha256(b",".join([decimals[i] for i in ids])).hexdigest(),
        hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest(),
    )


DONE = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, token_ids array<int>"


def finished(vocabulary: ByteVocabulary, doc_ids: list, encoded: list[list[int]], keep_ids: bool) -> list[pa.Array]:
    rows = [digest(vocabulary, ids) for ids in encoded]
    n, sha, text = zip(*rows) if rows else ((), (), ())
    if keep_ids:
        flat = np.concatenate([np.asarray(ids, dtype=np.int32) for ids in encoded]) if encoded else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum([len(ids) for ids in encoded])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
    else:
        ids = pa.nulls(len(rows), pa.list_(pa.int32()))
    return [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(text, pa.string()), ids]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text; one row per row of ``docs``.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``token_ids``. A null text counts as an
    empty one, which has no tokens; repeated rows and ids stay repeated, a null id stays null; an empty table gives an
    empty one; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    docs = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    keys = spark.read.schema("key binary").parquet(saved(shared_chunk_keys(docs), "chunk-keys"))
    words = spark.sparkContext.broadcast(key_filter(keys))
    names = ["piece", "uid", "seq", "key", "ids", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]

    def scan(batches):
        vocabulary = byte_vocabulary(path)
        uid = TaskContext.get().partitionId() << 33
        for rows in text_slices(batches):
            whole: tuple[list, list] = ([], [])
            pieces: list[tuple] = []
            for doc_id, parts in zip(rows.column("doc_id").to_pylist(), chunks(rows.column("text"))):
                hits = may_be_shared(parts, words.value)
                if not any(hits):
                    whole[0].append(doc_id)
                    whole[1].append(vocabulary.encode(b"".join(part for _, part in parts).decode()))
                    continue
                uid += 1
                run: list[bytes] = []
                for seq, ((key, part), hit) in enumerate(zip(parts, hits)):
                    if not hit:
                        run.append(part)
                    if run and (hit or seq == len(parts) - 1):
                        pieces.append((uid, 2 * seq, None, packed(vocabulary.encode(b"".join(run).decode())), doc_id))
                        run = []
                    if hit:
                        pieces.append((uid, 2 * seq + 1, key, None, doc_id))
            n = len(whole[0])
            nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), *nothing, *finished(vocabulary, *whole, keep_ids)], names)
            m = len(pieces)
            columns = list(zip(*pieces)) if pieces else [()] * 5
            given = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))]
            empty = [pa.nulls(m, t) for t in (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), *given, *empty], names)

    def assemble(batches):
        vocabulary = byte_vocabulary(path)
        uid, doc_id, ids = None, None, []
        for batch in batches:
            ready: tuple[list, list] = ([], [])
            for u, d, more in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "ids"))):
                more = np.frombuffer(more, dtype="<u2").tolist()
                if u == uid:
                    join_ids(vocabulary, ids, more)
                else:
                    if uid is not None:
                        ready[0].append(doc_id)
                        ready[1].append(ids)
                    uid, doc_id, ids = u, d, more
            yield pa.RecordBatch.from_arrays(finished(vocabulary, *ready, keep_ids), names[5:])
        if uid is not None:
            yield pa.RecordBatch.from_arrays(finished(vocabulary, [doc_id], [ids], keep_ids), names[5:])

    scanned = docs.mapInArrow(scan, f"piece int, uid long, seq int, key binary, ids binary, {DONE}")
    schema = f"uid long, seq int, key binary, ids binary, {DONE}, piece int"
    table = spark.read.schema(schema).parquet(saved(scanned, "encoded", "piece"))
    pieces = table.where("piece = 1").select("uid", "seq", "key", "ids", "doc_id")
    filled = (
        pieces.where("key is not null").drop("ids").join(encoded_chunks(docs, words, path), "key")
        .select("uid", "seq", "ids", "doc_id").unionByName(pieces.where("key is null").drop("key"))
    )
    repaired = filled.repartition("uid").sortWithinPartitions("uid", "seq").mapInArrow(assemble, DONE)
    out = table.where("piece = 0").select(*names[5:]).unionByName(repaired)
    return out if keep_ids else out.drop("token_ids")


def saved(df: DataFrame, name: str, by: str | None = None) -> str:
    """Write a table to the shared folder; partitioned by ``by``."""
    path = new_table_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return path
