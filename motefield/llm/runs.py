"""Runs of words that repeat with a period, found by pattern matching inside each text.

Every text is cut into overlapping dyadic blocks: at level k blocks of 2**k words, one from every place that half that length
divides. A block asks for its next occurrence within the neighbouring window, as far as its own length. Its occurrences
are an interval of the suffix array, and the least one after a place is a range successor over that interval, answered by a
wavelet tree. A distance within (2**(k-1), 2**k] is a candidate period; blocks of one level and period that follow each
other within a block's length are one progression, whose ends are extended word by word. A run of at least four periods holds
such a block at the level of its period, and the extension is shorter than half a block, so work is n log n at most.

Texts are independent: a task works through slices of whole texts with array operations, nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, text_slices

LEAST_LENGTH, LEAST_EXPONENT = 6, 4


class WaveletTree:
    """Order queries over intervals of an array of numbers below its length; one rank vector of bits per level."""

    def __init__(self, values: np.ndarray):
        self.height = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for level in reversed(range(self.height)):
            ones = (values >> level) & 1 == 1
            packed = np.zeros(len(values) // 64 + 1, dtype=np.uint64)
            raw = np.packbits(ones, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]])
            self.levels.append((level, packed, before, len(values) - int(ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    @staticmethod
    def ones_before(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def count_below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each interval [low, high) are less than its bound."""
        out = np.zeros(len(low), dtype=np.int64)
        for level, packed, before, zeros in self.levels:
            a, b = self.ones_before(packed, before, low), self.ones_before(packed, before, high)
            up = (bound >> level) & 1 == 1
            out += np.where(up, (high - b) - (low - a), 0)
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return np.where(bound >> self.height > 0, out + high - low, out)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th least value (from 0) of each interval, which must have so many."""
        out = np.zeros(len(low), dtype=np.int64)
        for level, packed, before, zeros in self.levels:
            a, b = self.ones_before(packed, before, low), self.ones_before(packed, before, high)
            fewer = (high - b) - (low - a)
            up = n >= fewer
            n = np.where(up, n - fewer, n)
            out |= up.astype(np.int64) << level
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least value of each interval that is not below the bound; -1 if there is none."""
        skipped = np.where(bound >> self.height > 0, high - low, self.count_below(low, high, bound))
        some = skipped < high - low
        out = np.full(len(low), -1, dtype=np.int64)
        out[some] = self.nth(low[some], high[some], skipped[some])
        return out


def next_equal(keys: np.ndarray) -> np.ndarray:
    """The next place with the same key; far beyond the end if there is none."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), 1 << 60, dtype=np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[:-1][same]] = order[1:][same]
    return out


def suffix_array(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """Suffixes of all texts sorted, text by text, and the blocks to ask for at each level.

    ``keys`` are word numbers that differ between texts, so that a suffix ends with its text; ``ends`` is the end of the text of each
    place. Prefixes are doubled, and only suffixes that are not yet told apart are sorted again. A level gives (length of the
    block, places, first and last + 1 of its interval); of blocks that occur again only those whose first word does so within
    the window.
    """
    n = len(keys)
    again = next_equal(keys) - np.arange(n)
    table = np.argsort(keys, kind="stable")
    values = keys[table]
    rank = np.zeros(n, dtype=np.int64)
    active, slots, span, blocks = table, np.arange(n), 1, []
    while len(active):
        first = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
        sizes = np.diff(np.append(first, len(active)))
        group = np.repeat(slots[first], sizes)
        rank[active] = group
        many = np.repeat(sizes, sizes) > 1
        step = max(1, span // 2)
        asked = many & (active % step == 0) & (again[active] <= span)
        if asked.any():
            low = group[asked]
            blocks.append((span, active[asked], low, low + np.repeat(sizes, sizes)[asked]))
        active, slots = active[many], slots[many]
        after = active + span
        inside = after < ends[active]
        second = np.where(inside, rank[np.where(inside, after, 0)], -1)
        values = rank[active] * (n + 1) + second + 1
        order = np.argsort(values, kind="stable")
        active, values = active[order], values[order]
        table[slots] = active
        span *= 2
    return table, blocks


def equal_ahead(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on (``way`` 1: forward, -1: backward) are equal, at most ``most``."""
    out, open_, width = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0), 16
    while len(open_):
        reach = np.minimum(width, most[open_] - out[open_])
        row = np.repeat(np.arange(len(open_)), reach)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach) + out[open_][row]
        differ = words[a[open_][row] + way * shift] != words[b[open_][row] + way * shift]
        stop = np.full(len(open_), 1 << 60, dtype=np.int64)
        np.minimum.at(stop, row[differ], shift[differ])
        out[open_] = np.minimum(stop, out[open_] + reach)
        open_ = open_[(stop == 1 << 60) & (out[open_] < most[open_])]
        width *= 2
    return out


def repeats(words: np.ndarray, bounds: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """All runs as rows of (place, length, period), by place, then period.

    ``words`` are the numbers of the words of all texts end to end, ``bounds`` the n+1 borders of the texts. A run is a maximal
    stretch with its least period, of at least ``least_length`` words and ``least_exponent`` periods; the blocks need four
    periods or more.
    """
    if least_exponent < 4:
        raise ValueError("blocks of half a length apart need runs of at least four periods")
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    starts, ends = bounds[:-1][text], bounds[1:][text]
    table, blocks = suffix_array(text * (int(words.max(initial=0)) + 1) + words, ends)
    none = np.zeros((0, 3), dtype=np.int64)
    if not blocks:
        return none
    tree = WaveletTree(table)
    found = [none]
    for span, places, low, high in blocks:
        period = tree.successor(low, high, places + 1) - places
        hit = (period > span // 2) & (period <= span)
        at, period = places[hit], period[hit]
        if not len(at):
            continue
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (period[1:] != period[:-1]) | (at[1:] - at[:-1] > span)
        first = np.flatnonzero(new)
        q, left, right = period[first], at[first], at[np.append(first[1:], len(at)) - 1] + period[first] + span
        left = left - equal_ahead(words, left - 1, left - 1 + q, left - starts[left], -1)
        right = right + equal_ahead(words, right, right - q, ends[left] - right, 1)
        long = right - left >= np.maximum(least_length, least_exponent * q)
        found.append(np.stack([left[long], (right - left)[long], q[long]], axis=1))
    return np.unique(np.concatenate(found)[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where and with which period a text of ``n`` words is made to repeat itself, as the report asks for; None for most texts."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (g % n, 1 + (n - g % n) // (3 + g % 8)) if h % 10 == 0 else None


ROWS = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start: long, length: long, period: long>>"
)
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def report(doc_ids: list, texts: list[str], plant: Callable[[int | None, int], tuple[int, int] | None] | None, keep_runs: bool) -> list[pa.Array]:
    words: list[list[bytes]] = []
    for doc_id, text in zip(doc_ids, texts):
        own = text.encode().split()  # white space of bytes is that of ASCII: 0x20, 0x09-0x0D
        spot = plant(doc_id, len(own)) if plant else None
        if spot:
            a, p = spot
            cycle = own[a : a + p]
            own = own[:a] + (cycle * ((len(own) - a) // p + 1))[: len(own) - a]
        words.append(own)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = pa.array([w for own in words for w in own], pa.large_binary())
    found = repeats(flat.dictionary_encode().indices.to_numpy().astype(np.int64), bounds)
    text_of = np.searchsorted(bounds, found[:, 0], side="right") - 1
    found[:, 0] -= bounds[text_of]
    edges = np.searchsorted(text_of, np.arange(len(words) + 1))
    out: list[tuple] = []
    for i, own in enumerate(words):
        runs = found[edges[i] : edges[i + 1]]
        listed = runs.tolist()
        digest = hashlib.sha256("".join([f"{s},{n},{q}\n" for s, n, q in listed]).encode()).hexdigest()
        best: list[int | None] = [None] * 4
        if listed:
            start, length, period = min(listed, key=lambda r: (-r[1], r[0], r[2]))
            best = [start, length, period, 1000 * length // period]
            depth = np.zeros(len(own) + 1, dtype=np.int64)
            np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
            np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
            own = [own[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]
        out.append((len(listed), *best, digest, hashlib.sha256(b" ".join(own)).hexdigest()))
    columns = list(zip(*out)) if out else [()] * 7
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    if keep_runs:
        rows = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(RUN))
        lists: pa.Array = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows)
    else:
        lists = pa.nulls(len(out), pa.list_(RUN))
    return [pa.array(doc_ids, pa.int64()), *[pa.array(c, kind) for c, kind in zip(columns, kinds)], lists]


def periodic_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    plant: Callable[[int | None, int], tuple[int, int] | None] | None = None, keep_runs: bool = False,
) -> DataFrame:
    """Periodic runs of words in every text: number, the longest one, digests of all runs and of the text without its repeats.

    Words are what ASCII white space parts. A run is a maximal stretch of words with its least period, of at least six words and four
    periods; places are word numbers. ``collapsed_sha256`` is the digest of the words that remain when every run keeps its first
    period only, joined by a space. ``keep_runs`` adds all runs as ``runs``. ``plant(doc_id, n_words)`` may name a place and a
    period: from there on the text is made to repeat before it is searched.

    A null or empty text has no words and no runs: nulls, and the digests of nothing. Repeated rows and ids stay, a null id stays
    null and is never planted; an empty table gives an empty one; other columns, whatever their names, are not read. A text is worked
    as a whole in one task, whatever its length, with some 300 bytes of memory for each of its words.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
        for rows in text_slices(batches):
            columns = report(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), plant, keep_runs)
            yield pa.RecordBatch.from_arrays(columns, names)

    out = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(scan, ROWS)
    return out if keep_runs else out.drop("runs")
