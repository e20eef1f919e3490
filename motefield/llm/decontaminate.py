"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned by the token windows of documents.

The benchmark goes out in blocks of a checked size; each block is scanned by every document window, hits are verified word by
word, and what earlier blocks found is carried along. One block is the usual case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import free_names, spread, text_bytes, text_slices, word_hashes
from motefield.runtime import materialise

WINDOW = 10
# Benchmark text bytes of one broadcast block.
BLOCK_BYTES = 16 << 20
# Words after lower-casing A-Z: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which in UTF-8 are runs of these bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_GAP = np.ones(256, dtype=bool)
IS_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
# A first look takes about one in so many foreign windows for known.
PREFILTER = 16


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def rolled(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` word hashes from each place on, as far as there are so many."""
    total = np.zeros(max(0, len(words) - length + 1), dtype=np.uint64)
    for k in range(length):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(total)]
    return total


class WindowSet:
    """The windows of one block of items: hashes in order, places in the block's words, and the words themselves.

    Windows of equal words form a group; the first of a group stands for it, the items of a group are a stretch of ``items``. A
    word of the block takes some 50 bytes, whatever windows hold it.
    """

    def __init__(self, rows: Iterable[tuple[str | None, str | None]]):
        rows = [(item, b" ".join(words_of(text))) for item, text in rows]
        rows = [(item, text) for item, text in rows if text]
        self.names = [item for item, _ in rows]
        self.text = b" ".join(text for _, text in rows)
        data = np.frombuffer(self.text, dtype=np.uint8)
        offsets = np.cumsum([0, *(len(text) + 1 for _, text in rows)])
        offsets[-1:] = len(data)
        words, bounds = word_hashes(data, offsets, IS_GAP)
        spaces = np.flatnonzero(data == 0x20).astype(np.int32)
        starts, ends = np.append(np.int32(0), spaces + np.int32(1)), np.append(spaces, np.int32(len(data)))
        sizes = np.diff(bounds)
        owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        left = np.repeat(bounds[1:], sizes) - np.arange(len(words))
        length_of = np.minimum(sizes, WINDOW)[owner] if len(rows) else np.zeros(0, dtype=np.int64)
        self.groups: dict[int, tuple[np.ndarray, ...]] = {}
        for length in np.unique(length_of).tolist():
            at = np.flatnonzero((length_of == length) & (left >= length))
            hashes = rolled(words, length)[at]
            order = np.lexsort((at, hashes))
            at, hashes = at[order], hashes[order]
            first, last = starts[at], ends[at + length - 1]
            new = np.append(True, hashes[1:] != hashes[:-1])
            for k in np.flatnonzero(~new).tolist():  # only windows that repeat: equal hash, and equal words?
                new[k] = self.text[first[k] : last[k]] != self.text[first[k - 1] : last[k - 1]]
            heads = np.flatnonzero(new)
            seen = np.zeros(1 << max(16, int(PREFILTER * len(heads)).bit_length()), dtype=bool)
            seen[hashes[heads] >> np.uint64(65 - len(seen).bit_length())] = True
            self.groups[length] = hashes[heads], first[heads], last[heads], np.append(heads, len(at)), owner[at], seen

    def items_of(self, window: bytes, length: int, key: np.uint64) -> np.ndarray:
        """Numbers of the items that hold a window, given its words and their hash."""
        keys, first, last, bounds, owner, _ = self.groups[length]
        found = [np.zeros(0, dtype=np.int32)]
        for g in range(int(np.searchsorted(keys, key)), int(np.searchsorted(keys, key, side="right"))):
            if self.text[first[g] : last[g]] == window:
                found.append(owner[bounds[g] : bounds[g + 1]])
        return np.unique(np.concatenate(found))

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, np.uint64]]]:
        """For each text that may hold a window, the (place, length, hash) to verify."""
        out: dict[int, list[tuple[int, int, np.uint64]]] = {}
        for length, (keys, *_, seen) in self.groups.items():
            at = rolled(words, length)
            places = np.flatnonzero(seen[at >> np.uint64(65 - len(seen).bit_length())])
            near = np.minimum(np.searchsorted(keys, at[places]), len(keys) - 1)
            places = places[keys[near] == at[places]]
            texts = np.searchsorted(offsets, places, side="right") - 1
            inside = places + length <= offsets[texts + 1]
            for place, text in zip(places[inside].tolist(), texts[inside].tolist()):
                out.setdefault(text, []).append((place - int(offsets[text]), length, at[place]))
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The items in blocks of bounded size, one at a time on the driver."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = spread(size, BLOCK_BYTES)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r.item, r.text) for r in part.collect()], k == blocks - 1


ADDED = {"n_words": "long", "hit_ranges": "array<int>", "hit_items": "array<string>"}


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", names: list[str] | None = None) -> DataFrame:
    """Add ``n_words``, ``hit_ranges`` (word places, start and end in turn) and ``hit_items``, or three other ``names``, to every row.

    A word is hit if it lies in any occurrence of a window: ten consecutive words of an item, or all of an item of fewer. A
    null or empty text has no words; an empty item or benchmark hits nothing; repeated rows and items stay as they are; an item without an
    id counts as one item more, whose entry is null; a text of any length is scanned whole, by one task; columns called like
    the three added are replaced, all others stay.
    """
    spark = docs.sparkSession
    added = list(names or ADDED)
    n_words, hit_ranges, hit_items = added
    kept = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    empty = [F.lit(0).cast("long").alias(n_words), F.array().cast("array<int>").alias(hit_ranges), F.array().cast("array<string>").alias(hit_items)]
    state = docs.select(*[f"`{c}`" for c in kept], *empty)
    for items, is_last in item_blocks(benchmark, item_col, item_text):
        windows = spark.sparkContext.broadcast(WindowSet(items))

        def look(batches, windows=windows):
            known = windows.value
            for rows in text_slices(batches, text_col):
                column = rows.column(text_col)
                hashes, offsets = word_hashes(*text_bytes(column), IS_GAP)
                ranges, items = rows.column(hit_ranges).to_pylist(), rows.column(hit_items).to_pylist()
                for text, places in known.candidates(hashes, offsets).items():
                    words = words_of(column[text].as_py())
                    hit, holders = list(zip(ranges[text][::2], ranges[text][1::2])), set()
                    for place, length, key in places:
                        found = known.items_of(b" ".join(words[place : place + length]), length, key)
                        if len(found):
                            hit.append((place, place + length))
                            holders.update(found.tolist())
                    ranges[text] = [x for r in merged(hit) for x in r]
                    items[text] = sorted({*items[text], *(known.names[i] for i in holders)}, key=lambda name: (name is None, name or ""))
                columns = [rows.column(c) for c in kept]
                columns += [pa.array(np.diff(offsets), pa.int64()), pa.array(ranges, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *added])

        state = state.mapInArrow(look, state.schema)
        if not is_last:
            state = materialise(state)
    return state


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row.

    Nulls, empty and long texts, repeated rows and empty tables as in ``mark``; ids may repeat or be null; an item without an id counts
    but adds nothing to the digest; other columns are not read.
    """
    marked = mark(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark)
    hit = F.aggregate("hit_ranges", F.struct(F.lit(-1).alias("sign"), F.lit(0).alias("n")), lambda acc, x: F.struct((-acc["sign"]).alias("sign"), (acc["n"] + acc["sign"] * x).alias("n")), lambda acc: acc["n"])
    return marked.select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without a hit, as they were, whatever their further columns are called.

    Null and empty texts hold no window and stay, as do repeated clean rows; an empty benchmark removes nothing; long texts as in ``mark``.
    """
    names = free_names(docs.columns, list(ADDED))
    return mark(docs, benchmark, text_col, names=names).where(F.size(names[2]) == 0).select(*[f"`{c}`" for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row, without the text from the first to the last word of each hit range; clean texts and all other columns stay as they are.

    Null and empty texts stay; repeated rows are cut alike; an empty benchmark cuts nothing; a text is rebuilt once from what lies between its ranges.
    """
    reserved = free_names(docs.columns, list(ADDED))
    marked = mark(docs, benchmark, text_col, names=reserved)
    names = docs.columns

    def cut(batches):
        for rows in text_slices(batches, text_col):
            texts = rows.column(text_col).to_pylist()
            for k, ranges in enumerate(rows.column(reserved[1]).to_pylist()):
                if ranges:
                    raw = texts[k].encode()
                    at = [m.span() for m in WORD.finditer(raw.lower())]
                    edges = [0, *(e for start, end in zip(ranges[::2], ranges[1::2]) for e in (at[start][0], at[end - 1][1])), len(raw)]
                    texts[k] = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
            columns = [pa.array(texts, rows.schema.field(c).type) if c == text_col else rows.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(cut, docs.schema)
