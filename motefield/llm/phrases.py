"""Phrases whose words stand together more often than their parts would, by sorting pointers to word suffixes.

Words are counted first. A phrase is no more frequent than any pair of words in it, so pairs are counted next, by both words, which
are the phrases of two words. Only places where two frequent pairs follow each other send a pointer: the up to five words from there
on, as far as pairs stay frequent, with equal ones of a task merged into one with a weight. Pointers are routed by their two leading words. A task then sorts its pointers by
three-way quicksort, word after word: the pointers that equal the pivot are a phrase, their weight is its count, and partitions lighter than the
least count are abandoned. Pairs with more pointers than one task should get are routed by all their words; their partitions are not
abandoned and the counts of their phrases are added up after the sort.

Words are 64-bit hashes of (language, word). Which hashes are frequent is told by bit filters of bounded size built in Spark; their
errors only send more than needed. Two words with one hash are found while counting, and all is hashed anew with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.llm.batches import byte_map, id_and_text, mixed, spread, text_bytes, text_slices, word_hashes
from motefield.runtime import new_table_path

WORDS = 5
# Fixed: what parts words, what parts pieces.
GAPS, BREAKS = b"\x20\x09", b".,;:!?\n\x0b\x0c\r"
IS_GAP, IS_BREAK = (byte_map(marked=m)[1] for m in (GAPS + BREAKS, BREAKS))
# Pointers of one task of the sort, and the share of them from which on a pair is routed by all its words.
TASK_POINTERS, HOT_SHARE = 500_000, 500
# Rows that a task holds before it merges them; it sends them once more than half of them are distinct. Words of a task's table.
MERGED_ROWS, HELD_WORDS = 1 << 21, 1 << 19
FILTER_BITS_EACH, FILTER_BITS_MOST = 16, 1 << 27
SALTS = 64


def text_words(texts: pa.Array, langs: list[str], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice: hash with the language, whether it goes on the piece of the word before, text, first and last + 1 byte; and the bytes."""
    data, offsets = text_bytes(texts)
    hashes, bounds = word_hashes(data, offsets, IS_GAP)
    text = np.repeat(np.arange(len(langs)), np.diff(bounds))
    lang = np.array([xxhash.xxh64_intdigest(name.encode(), seed) for name in langs], dtype=np.uint64)
    hashes = np.maximum(mixed(hashes ^ lang[text]), np.uint64(1))
    filled = ~IS_GAP[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    first = np.flatnonzero(filled & (border[:-1] | ~np.concatenate([[False], filled[:-1]])))
    last = np.flatnonzero(filled & (border[1:] | ~np.concatenate([filled[1:], [False]]))) + 1
    breaks = np.cumsum(IS_BREAK[data])
    goes_on = np.zeros(len(hashes), dtype=bool)
    goes_on[1:] = (text[1:] == text[:-1]) & (breaks[first[1:]] == breaks[first[:-1]]) if len(data) else False
    return hashes, goes_on, text, first, last, data


def language_and_text(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    texts = id_and_text(docs, lang_col, text_col)
    return texts.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """``h, n, first, last``: occurrences of every word, and of every language as a row without a word; first <> last: two words share a hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}

        def sent():
            rows = [(h, *row) for h, row in found.items()]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["h", "lang", "word", "c"])

        for rows in text_slices(batches):
            langs = rows.column("lang").to_pylist()
            hashes, _, text, first, last, data = text_words(rows.column("text"), langs, seed)
            raw = data.tobytes().lower() if len(data) else b""
            keys, at, counts = np.unique(hashes, return_index=True, return_counts=True)
            at_lists = (keys.view(np.int64), counts, text[at], first[at], last[at])
            for h, c, t, a, b in zip(*(x.tolist() for x in at_lists)):
                if h in found:
                    found[h][2] += c
                else:
                    found[h] = [langs[t], raw[a:b].decode(), c]
            per_text = np.bincount(text, minlength=len(langs))
            for name in set(langs):
                h = xxhash.xxh64_intdigest(name.encode(), seed + 1) - (1 << 63)
                c = int(per_text[[x == name for x in langs]].sum())
                found.setdefault(h, [name, None, 0])[2] += c
            if len(found) > HELD_WORDS:
                yield sent()
        yield sent()

    named = F.struct("lang", "word")
    return texts.mapInArrow(count, "h long, lang string, word string, c long").groupBy("h").agg(
        F.sum("c").alias("n"), F.min(named).alias("first"), F.max(named).alias("last")
    )


def counted_words(texts: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Words that occur often enough and the totals of the languages, and the seed with which no two words share a hash."""
    spark, seed = texts.sparkSession, 0
    while True:
        place = new_table_path(spark, "words")
        shared = ~F.col("first").eqNullSafe(F.col("last"))
        counts = word_counts(texts, seed).withColumn("shared", shared)
        counts.where(shared | (F.col("n") >= least) | F.col("first.word").isNull()).select(
            "h", "n", F.col("first.lang").alias("lang"), F.col("first.word").alias("word"), "shared"
        ).write.parquet(place)
        table = spark.read.schema("h long, n long, lang string, word string, shared boolean").parquet(place)
        if table.where("shared").isEmpty():
            return table.drop("shared"), seed
        seed += 2


def bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Bits of two places for each 64-bit key, as words; put together in Spark and of bounded size."""
    n, bits = keys.count(), 1 << 12
    while bits < min(FILTER_BITS_EACH * n, FILTER_BITS_MOST):
        bits *= 2
    h, mask = F.col(column), F.lit(bits - 1)
    spot = keys.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("spot"))
    found = spot.groupBy(F.shiftright("spot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    mask, out = np.uint64(len(words) * 64 - 1), np.ones(len(keys), dtype=bool)
    for spot in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= (words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return out


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(left * np.uint64(0xD6E8FEB86659FD93) + right)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What the filters and routes know a pair by: the words' hashes, the second turned by a bit."""
    return left ^ ((right << np.uint64(1)) | (right >> np.uint64(63)))


def pair_key(left: str, right: str) -> Column:
    """``pair_keys`` of two columns."""
    return F.col(left).bitwiseXOR(F.shiftleft(right, 1).bitwiseOR(F.shiftrightunsigned(right, 63)))


def pair_counts(texts: DataFrame, seed: int, frequent) -> DataFrame:
    """``w0, w1, n``: occurrences of every pair of neighbouring words that both may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def sent():
            pairs = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.uint64)
            held.clear()
            pairs = pairs[:, np.argsort(pair_keys(*pairs))]  # two pairs of one key may alternate; their rows are added up later
            first = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])[: pairs.shape[1]])
            counts = np.diff(np.append(first, pairs.shape[1]))
            columns = [pa.array(np.ascontiguousarray(w[first]).view(np.int64)) for w in pairs]
            return pa.RecordBatch.from_arrays([*columns, pa.array(counts.astype(np.int64))], ["w0", "w1", "c"])

        for rows in text_slices(batches):
            hashes, goes_on, *_ = text_words(rows.column("text"), rows.column("lang").to_pylist(), seed)
            good = passes(frequent.value, hashes)
            both = good[:-1] & good[1:] & goes_on[1:]
            held.append(np.stack([hashes[:-1][both], hashes[1:][both]]))
            if sum(h.shape[1] for h in held) > MERGED_ROWS:
                yield sent()
        yield sent()

    return texts.mapInArrow(count, "w0 long, w1 long, c long").groupBy("w0", "w1").agg(F.sum("c").alias("n"))


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of several tables and the sum of their weights."""
    rows, weight = (np.concatenate(c) for c in zip(*held)) if held else (np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64))
    if not len(rows):
        return rows, weight
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(weight[order], first)


POINTER = "w0 long, w1 long, w2 long, w3 long, w4 long, weight long, route long, split boolean"


def suffix_pointers(texts: DataFrame, seed: int, frequent, pairs, hot) -> DataFrame:
    """The words from every place on where two frequent pairs follow each other, as far as pairs stay frequent; equal ones of a task are merged."""

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent(rows, weight):
            lead = pair_keys(rows[:, 0], rows[:, 1])
            split, whole = passes(hot.value, lead), lead
            for k in range(2, WORDS):
                whole = pair_hashes(whole, rows[:, k])
            columns = [pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(WORDS)]
            route = np.where(split, whole, lead).view(np.int64)
            return pa.RecordBatch.from_arrays([*columns, pa.array(weight), pa.array(route), pa.array(split)], [c.split()[0] for c in POINTER.split(", ")])

        for rows in text_slices(batches):
            hashes, goes_on, *_ = text_words(rows.column("text"), rows.column("lang").to_pylist(), seed)
            good = passes(frequent.value, hashes)
            pair = np.zeros(len(hashes) + WORDS, dtype=bool)
            both = np.flatnonzero(good[:-1] & good[1:] & goes_on[1:])
            pair[both] = passes(pairs.value, pair_keys(hashes[both], hashes[both + 1]))
            at = np.flatnonzero(pair[:-1] & pair[1:])
            out = np.zeros((len(at), WORDS), dtype=np.uint64)
            padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
            goes = np.ones(len(at), dtype=bool)
            out[:, 0] = padded[at]
            for k in range(1, WORDS):
                goes &= pair[at + k - 1]
                out[:, k] = np.where(goes, padded[at + k], 0)
            held.append((out, np.ones(len(out), dtype=np.int64)))
            if sum(len(r) for r, _ in held) > MERGED_ROWS:
                held[:] = [merged(held)]
                if len(held[0][0]) > MERGED_ROWS // 2:
                    yield sent(*held.pop())
        yield sent(*merged(held))

    return texts.mapInArrow(point, POINTER)


def quicksorted(words: np.ndarray, weight: np.ndarray, least: int, abandon: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of two words and more by three-way quicksort: a pointer to each, its number of words, its count.

    All partitions of the sort take a step at once. Each has a depth, the words that its pointers share; by the next word they part
    into less than, equal to and greater than the pivot's. Equal ones go a word deeper and are a phrase. With ``abandon``,
    partitions and phrases lighter than ``least`` are left.
    """
    order, part = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    depth, found = np.zeros(1, dtype=np.int64), []
    floor = least if abandon else 1
    while len(order):
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sizes = np.diff(np.append(first, len(part)))
        pivot = words[order[first + sizes // 2], depth]
        inside = np.repeat(np.arange(len(first)), sizes)
        key, middle = words[order, depth[inside]], pivot[inside]
        side = 3 * inside + 1 + (key > middle) - (key < middle)
        move = np.argsort(side, kind="stable")
        order, side = order[move], side[move]
        first = np.flatnonzero(np.diff(side, prepend=-1))
        sizes = np.diff(np.append(first, len(side)))
        total = np.add.reduceat(weight[order], first)
        parent, equal = side[first] // 3, side[first] % 3 == 1
        level = depth[parent] + equal
        phrase = equal & (pivot[parent] != 0)
        told = phrase & (level >= 2) & (total >= floor)
        found.append((order[first[told]], level[told], total[told]))
        keep = (total >= floor) & np.where(equal, phrase & (level < WORDS), True)
        order = order[np.repeat(keep, sizes)]
        part = np.repeat(np.arange(keep.sum()), sizes[keep])
        depth = level[keep]
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (order, order, order)


def phrase_counts(pointers: DataFrame, tasks: int, least: int) -> DataFrame:
    """``p, a``: every phrase of three to five words with at least ``least`` occurrences."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(k).to_numpy() for k in range(WORDS + 1)] + [b.column(WORDS + 2).to_numpy(zero_copy_only=False)], axis=1) for b in batches]
        rows = np.concatenate(held) if held else np.zeros((0, WORDS + 2), dtype=np.int64)
        for split in (False, True):
            own = rows[rows[:, WORDS + 1] == split]
            words = np.ascontiguousarray(own[:, :WORDS]).view(np.uint64)
            at, length, total = quicksorted(words, own[:, WORDS], least, not split)
            at, length, total = (c[length > 2] for c in (at, length, total))  # pointers leave out pairs that do not go on
            flat = own[at, :WORDS][np.arange(WORDS) < length[:, None]]
            bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            phrases = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))
            yield pa.RecordBatch.from_arrays([phrases, pa.array(total)], ["p", "c"])

    sorted_ = pointers.repartition(tasks, "route").mapInArrow(sort, "p array<long>, c long")
    return sorted_.groupBy("p").agg(F.sum("c").alias("a")).where(F.col("a") >= least)


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole decimals."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    top, bottom = whole(whole(a, 17) * 1000 * whole(n, 17), 38), whole(whole(left, 19) * whole(right, 19), 38)
    return F.call_function("div", top, bottom)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, top: int = 2000, task_pointers: int = TASK_POINTERS
) -> DataFrame:
    """The ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends and into words at spaces and tabs. A candidate is a phrase
    of two to five words within a piece with ``a >= least`` occurrences, overlapping ones counted. Its score is the least over
    its cuts of floor(1000 * a * n / (l * r)), ``n`` being all words of the language, ``l`` and ``r`` the occurrences of the two parts; of
    equal scores the first cut counts. A candidate goes if a longer one holds it and occurs as often. Order: score
    and ``a`` descending, then the phrase by its bytes.

    Null languages are ``und``, null and empty texts have no words; a language without candidates has no row, an empty table gives
    an empty one. Repeated rows count each time. Texts of any length are worked whole. Other columns, whatever their names, are not
    read.
    """
    spark = docs.sparkSession
    texts = language_and_text(docs, text_col, lang_col)
    words, seed = counted_words(texts, least)
    frequent = words.where("word is not null")
    totals = words.where("word is null").select("lang", F.col("n").alias("n_words"))
    word_filter = spark.sparkContext.broadcast(bit_filter(frequent, "h"))

    place = new_table_path(spark, "pairs")
    pair_counts(texts, seed, word_filter).where(F.col("n") >= least).write.parquet(place)
    pairs = spark.read.schema("w0 long, w1 long, n long").parquet(place).withColumn("p", pair_key("w0", "w1"))
    pointers = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = pairs.where(F.col("n") > min(task_pointers // 2, pointers // HOT_SHARE))
    pair_filter, hot_filter = (spark.sparkContext.broadcast(bit_filter(x, "p")) for x in (pairs, hot))

    place = new_table_path(spark, "phrases")
    routed = suffix_pointers(texts, seed, word_filter, pair_filter, hot_filter)
    longer = phrase_counts(routed, spread(pointers, task_pointers), least)
    longer.unionByName(pairs.select(F.array("w0", "w1").alias("p"), F.col("n").alias("a"))).write.parquet(place)
    phrases = spark.read.schema("p array<long>, a long").parquet(place)
    return ranked(phrases, frequent, totals, top)


def ranked(phrases: DataFrame, frequent: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Scores, cuts and ranks of counted phrases (``p`` hashes, ``a``) with the words (``h, n, lang, word``) that they are made of."""
    counts = phrases.select("p", F.col("a").alias("f")).unionByName(frequent.select(F.array("h").alias("p"), F.col("n").alias("f")))
    part = lambda first, size: F.slice("p", first, size)
    size = F.size("p")
    cuts = phrases.select("p", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("p").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    names = frequent.select("h", "lang").join(totals, "lang")
    cuts = cuts.withColumn("h", F.get("p", F.lit(0))).join(names, "h")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("n_words"), F.col("l"), F.col("r")).cast("long"))
    best = cuts.groupBy("p", "a", "lang", F.col("n_words").alias("n")).agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    held = phrases.where(size >= 3).select("a", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("p"))
    held = held.groupBy("p").agg(F.max("a").alias("longer"))
    kept = best.join(held, "p", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    spelled = kept.select("p", F.posexplode("p").alias("at", "h")).join(frequent.select("h", "word"), "h")
    spelled = spelled.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("at", "word")))["word"].alias("words"))
    rows = kept.join(spelled, "p").select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n",
        F.col("best.score").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
