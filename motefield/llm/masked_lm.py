"""Masked pseudo-likelihood of documents by a bidirectional window network trained in numpy.

Every word is predicted from the two words on either side of it. A word is one of ``UNITS`` hashed units; the network gives the
probability of the unit's class, and counts over the whole corpus give that of the unit within its class. The most
frequent units are classes of their own, the others share classes of about equal weight.

Training goes over all documents in every round, and every word is masked and learned in exactly one of the rounds. Each task starts
from the shared parameters, learns from the round's words of its documents, and hands in its change weighted by the words it saw; changes are averaged in Spark in two levels. A
document's score is the sum of the conditional log-probabilities of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.llm.batches import id_and_text, mixed, text_bytes, text_slices, word_hashes

# Sizes of the network; all are fixed, so the parameters (2 MB) are safe to broadcast.
UNITS, WIDTH, HIDDEN, SINGLE, SHARED = 1 << 15, 16, 32, 64, 64
CLASSES = SINGLE + SHARED
PLACES = (-2, -1, 1, 2)
# Training: rounds over the corpus, words of a step, step size.
ROUNDS, STEP_WORDS, RATE, SEED = 2, 4096, 0.1, 11
SCORED_WORDS = 16384
# Parameters travel in so many pieces; changes of so many tasks meet first.
PIECES, FAN_IN = 64, 64
SHAPES = {"embedding": (UNITS + 1, WIDTH), "mix": (len(PLACES) * WIDTH, HIDDEN), "bend": (HIDDEN,), "out": (HIDDEN, CLASSES), "lean": (CLASSES,)}


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the parameters in one flat array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def fresh() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    flat = np.zeros(sum(int(np.prod(s)) for s in SHAPES.values()), dtype=np.float32)
    for name, part in split(flat).items():
        if part.ndim == 2:
            part[:] = rng.normal(0, 0.1 if name == "embedding" else part.shape[0] ** -0.5, part.shape)
    return flat


def units_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Units of all words of a column, and the n+1 offsets of its texts."""
    words, offsets = word_hashes(*text_bytes(column))
    return (words >> np.uint64(64 - 15)).astype(np.uint16), offsets


def surroundings(units: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Units around every word, ``UNITS`` beyond the ends of its text."""
    starts = np.repeat(offsets[:-1], np.diff(offsets))
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out = np.full((len(units), len(PLACES)), UNITS, dtype=np.uint16)
    own = np.arange(len(units))
    for k, place in enumerate(PLACES):
        inside = (own + place >= starts) if place < 0 else (own + place < ends)
        out[:, k] = np.where(inside, np.roll(units, -place), np.uint16(UNITS))
    return out


def targets(offsets: np.ndarray, turn: int) -> np.ndarray:
    """Words to learn in a round, by a hash of the place in the text: each in one round, however rows fall into tasks and slices."""
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.flatnonzero(mixed(place.astype(np.uint64) + np.uint64(SEED)) % np.uint64(ROUNDS) == turn)


def unit_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of every unit in the whole corpus: ``UNITS`` numbers."""

    def count(batches):
        total = np.zeros(UNITS, dtype=np.int64)
        for rows in text_slices(batches):
            total += np.bincount(units_of(rows.column("text"))[0], minlength=UNITS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["unit", "n"])

    found = docs.select("text").mapInArrow(count, "unit int, n long").groupBy("unit").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(UNITS, dtype=np.int64)
    out[found.column("unit").to_numpy()] = found.column("n").to_numpy()
    return out


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every unit, and the log-probability of the unit within its class."""
    order = np.lexsort((np.arange(UNITS), -counts))
    weight = counts[order[SINGLE:]] + 1.0
    shared = np.minimum(((np.cumsum(weight) - weight) * SHARED / weight.sum()).astype(np.int64), SHARED - 1)
    kind = np.empty(UNITS, dtype=np.int32)
    kind[order[:SINGLE]] = np.arange(SINGLE)
    kind[order[SINGLE:]] = SINGLE + shared
    smooth = counts + 1.0
    return kind, np.log(smooth / np.bincount(kind, smooth, minlength=CLASSES)[kind])


def tables(p: dict[str, np.ndarray]) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """What every unit adds to the hidden layer at each place, so that scoring needs no product for it."""
    return [p["embedding"] @ p["mix"][k * WIDTH : (k + 1) * WIDTH] for k in range(len(PLACES))], p


def scored(model: tuple[list[np.ndarray], dict[str, np.ndarray]], around: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Log-probability of the class of every word."""
    added_, p = model
    out = np.empty(len(around), dtype=np.float32)
    for k in range(0, len(around), SCORED_WORDS):
        near, own = around[k : k + SCORED_WORDS], wanted[k : k + SCORED_WORDS]
        hidden = p["bend"] + added_[0][near[:, 0]]
        for place in range(1, len(PLACES)):
            hidden += added_[place][near[:, place]]
        logits = np.tanh(hidden, out=hidden) @ p["out"]
        logits += p["lean"]
        top = logits.max(axis=1)
        logits -= top[:, None]
        said = logits[np.arange(len(own)), own]
        out[k : k + SCORED_WORDS] = said - np.log(np.exp(logits, out=logits).sum(axis=1))
    return out


def forward(p: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings around every word, hidden layer, and the classes' probabilities over the number of words."""
    given = p["embedding"][around].reshape(len(around), -1)
    hidden = np.tanh(given @ p["mix"] + p["bend"])
    logits = hidden @ p["out"] + p["lean"]
    logits -= logits.max(axis=1, keepdims=True)
    shares = np.exp(logits, out=logits)
    shares *= (1 / (len(around) * shares.sum(axis=1)))[:, None].astype(np.float32)
    return given, hidden, shares


def learn(flat: np.ndarray, squares: np.ndarray, around: np.ndarray, wanted: np.ndarray) -> None:
    """One adaptive gradient step on the log-loss of the classes, in place."""
    p, s = split(flat), split(squares)
    given, hidden, slope = forward(p, around)
    slope[np.arange(len(wanted)), wanted] -= np.float32(1 / len(wanted))
    back = (slope @ p["out"].T) * (1 - hidden * hidden)
    gradients = {"mix": given.T @ back, "bend": back.sum(axis=0), "out": hidden.T @ slope, "lean": slope.sum(axis=0)}
    each = (back @ p["mix"].T).reshape(-1, WIDTH)
    order = np.argsort(around.ravel(), kind="stable")  # 16-bit units: by radix
    ordered = around.ravel()[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    rows, total = ordered[first], np.add.reduceat(each[order], first, axis=0)
    for name, g in gradients.items():
        s[name][...] += g * g
        p[name][...] -= RATE * g / np.sqrt(s[name] + 1e-8)
    s["embedding"][rows] += total * total
    p["embedding"][rows] -= RATE * total / np.sqrt(s["embedding"][rows] + 1e-8)


CHANGE = "piece int, part long, weight double, change binary"


def pieces(part: int, weight: float, change: np.ndarray) -> pa.RecordBatch:
    cut = [c.astype(np.float32).tobytes() for c in np.array_split(change, PIECES)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int64()), pa.array([weight] * PIECES, pa.float64()), pa.array(cut, pa.binary())],
        ["piece", "part", "weight", "change"],
    )


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of consecutive changes of one piece; a stream is never held whole."""
    key, total, weight = None, None, 0.0

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([weight], pa.float64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())],
            ["piece", "part", "weight", "change"],
        )

    for batch in batches:
        for piece, part, w, change in zip(*(batch.column(c).to_pylist() for c in ("piece", "group", "weight", "change"))):
            if (piece, part) != key:
                if key is not None:
                    yield done()
                key, total, weight = (piece, part), 0.0, 0.0
            total = total + w * np.frombuffer(change, dtype=np.float32).astype(np.float64)
            weight += w
    if key is not None:
        yield done()


def averaged(changes: DataFrame) -> np.ndarray | None:
    """The mean change of all parameters, weighted by words; met in groups of ``FAN_IN`` tasks, then altogether."""
    for group in (F.floor(F.col("part") / FAN_IN), F.lit(0).cast("long")):
        rows = changes.withColumn("group", group)
        changes = rows.repartition("piece", "group").sortWithinPartitions("piece", "group", "part").mapInArrow(added, CHANGE)
    found = {r.piece: np.frombuffer(r.change, dtype=np.float32) for r in changes.select("piece", "change").collect()}
    return np.concatenate([found[k] for k in range(PIECES)]) if found else None


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, class of every unit and log-probability of a unit within its class, from the column ``text`` of all rows."""
    kind, within = classes_of(unit_counts(docs))
    flat = fresh()
    for turn in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((flat, kind))

        def change(batches, shared=shared, turn=turn):
            part = TaskContext.get().partitionId()
            start, kinds = shared.value
            own, squares, seen = start.copy(), np.full_like(start, 1e-4), 0
            rng = np.random.default_rng([SEED, turn, part])
            for rows in text_slices(batches):
                units, offsets = units_of(rows.column("text"))
                around = surroundings(units, offsets)
                masked = rng.permutation(targets(offsets, turn))
                for k in range(0, len(masked), STEP_WORDS):
                    some = masked[k : k + STEP_WORDS]
                    learn(own, squares, around[some], kinds[units[some]])
                seen += len(masked)
            if seen:
                yield pieces(part, float(seen), own - start)

        mean = averaged(docs.select("text").mapInArrow(change, CHANGE))
        if mean is not None:
            flat = flat + mean
    return flat, kind, within


def pseudo_likelihood(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of every row, by a model trained on these rows unless one is given.

    A null or empty text has no tokens, a ``log_prob`` of 0 and no mean; ids may be null or repeat, equal texts score equally but for the last digits; an
    empty table gives an empty one; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def score(batches):
        flat, kind, within = shared.value
        ready = tables(split(flat))
        for rows in text_slices(batches):
            units, offsets = units_of(rows.column("text"))
            logs = within[units] + scored(ready, surroundings(units, offsets), kind[units])
            n = np.diff(offsets)
            sums = np.zeros(len(n))
            if len(logs):
                sums[n > 0] = np.round(np.add.reduceat(logs, offsets[:-1][n > 0]), 4)
            means = pa.array(np.round(sums / np.maximum(n, 1), 6), mask=n == 0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums), means], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(score, f"doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double")
