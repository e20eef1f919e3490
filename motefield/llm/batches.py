"""Helpers for Arrow batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Text bytes worked on at once inside a task; keeps the numpy working arrays near 100 MB.
SLICE_BYTES = 2 << 20


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty) of a table, under fixed names, whatever else it holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def free_names(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, led by as many underscores as it takes for none to be a column of the table already."""
    taken, lead = {c.lower() for c in columns}, "__"
    while any((lead + w).lower() in taken for w in wanted):
        lead += "_"
    return [lead + w for w in wanted]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``; one row is never cut."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the n+1 offsets of its rows (nulls are empty)."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if filled.buffers()[2] is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    data = np.frombuffer(filled.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def spread(rows: int, per_partition: int, least: int = 1) -> int:
    """Number of partitions for a counted size."""
    return max(least, -(-rows // per_partition))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_map(change: dict[int, int] | None = None, marked: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """A byte-to-byte table that lower-cases A-Z, and a mask of the bytes in ``marked``."""
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    mask = np.zeros(256, dtype=bool)
    mask[list(marked)] = True
    return lower, mask


# White space between words (fixed value: 0x20, 0x09-0x0D).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER, IS_SPACE = byte_map(marked=SPACES)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, and the n+1 offsets of each text's words.

    Words are runs of bytes that are not gaps, A-Z lower-cased; equal words have equal hashes in every text and task.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    filled = ~is_gap[data]
    first = filled.copy()
    first[1:] &= ~filled[:-1]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[at] = filled[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.ones(int(place.max()) + 1, dtype=np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    values = (LOWER[data[starts[0] :]].astype(np.uint64) + np.uint64(1)) * powers[place] * filled[starts[0] :]
    return mixed(np.add.reduceat(values, starts - starts[0])), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, in order; a shorter text counts as one run, if it has a word."""
    counts = np.diff(offsets)
    runs = np.where(counts >= width, counts - width + 1, counts > 0).astype(np.int64)
    ends = np.cumsum(runs)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - runs), runs)
    have = np.repeat(np.minimum(counts, width), runs)
    total = np.zeros(len(index), dtype=np.uint64)
    factor = 0xD6E8FEB86659FD93
    for k in range(width):
        held = have > k
        total[held] = (total[held] + words[index[held] + k]) * np.uint64(factor)
    return mixed(total), np.concatenate([[0], ends])
