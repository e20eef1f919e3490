"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents and unlabelled text train a linear classifier in numpy. The risk of an unlabelled document holds
toxic ones at the rate of the class prior; their part is taken off, and whenever the rest falls below zero (the model begins
to learn the unlabelled rows by heart) that part no longer pulls. Features are the words of a document and their beginnings
and endings, each counted once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motefield.llm.batches import free_names, id_and_text, text_slices
from motefield.runtime import new_table_path

# The classifier is fitted on at most so many confirmed toxic and unlabelled documents, taken in order of a hash of the id, and
# has at most so many features. Scores, counts of labels and the class prior cover all rows.
TOXIC_ROWS, UNLABELLED_ROWS, FEATURES = 4000, 8000, 4096
# Characters of word beginnings and endings.
AFFIXES = range(3, 7)
# Features are so many standard errors more frequent in the toxic sample than in unlabelled text, and the toxic documents that
# the class prior puts into unlabelled text account for this part of their occurrences there. They occur in four toxic documents
# of the sample, or one in a hundred.
LEAST_ERRORS, LEAST_PURITY, LEAST_ROWS, LEAST_PART = 3.0, 0.5, 4, 0.01
EPOCHS, BATCHES, STEP, DECAY, SEED = 60, 4, 0.05, 1e-4, 7
WORD = re.compile(r"\w+")
CACHED_WORDS = 400_000


def word_features(word: str) -> list[str]:
    """The word, its beginnings (^...) and its endings (...$)."""
    out = [word]
    for n in AFFIXES:
        if len(word) > n:
            out += ["^" + word[:n], word[-n:] + "$"]
    return out


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


class Chosen:
    """Numbers of the features in use for every word, remembered for the words met."""

    def __init__(self, names: list[str]):
        self.numbers = {name: i for i, name in enumerate(names)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[word] = found
        return found

    def of_text(self, text: str) -> list[int]:
        out: set[int] = set()
        known = self.known
        for word in words_of(text):
            found = known.get(word)
            out.update(self.of_word(word) if found is None else found)
        return sorted(out)


def is_held_out(doc_id) -> object:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def sample_of(docs: DataFrame, labels: DataFrame, use) -> tuple[DataFrame, float]:
    """``toxic, text`` of the training sample, and the class prior: the toxic part of all labelled training rows."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").where(use(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    order = F.xxhash64("doc_id", F.lit(SEED))
    ids = docs.select("doc_id").where("doc_id is not null").where(use(F.col("doc_id"))).distinct()
    toxic = ids.join(known.where("toxic = 1").select("doc_id"), "doc_id").orderBy(order, "doc_id").limit(TOXIC_ROWS)
    # Unlabelled text is drawn from all documents, toxic ones at the class prior among them, whatever their labels say.
    rest = ids.orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(UNLABELLED_ROWS)
    chosen = toxic.withColumn("toxic", F.lit(True)).unionByName(rest.withColumn("toxic", F.lit(False)))
    path = new_table_path(spark, "toxicity-sample")
    # At most TOXIC_ROWS + UNLABELLED_ROWS ids, so broadcasting them is bounded. Of exact copies one is enough.
    sample = docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text").dropDuplicates()
    sample.write.option("compression", "zstd").parquet(path)
    return spark.read.schema("toxic boolean, text string").parquet(path), prior


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, p, u``: in how many toxic and unlabelled documents of the sample each feature occurs."""

    def count(batches):
        found: dict[str, list[int]] = {}
        for rows in text_slices(batches):
            for toxic, text in zip(rows.column("toxic").to_pylist(), rows.column("text").to_pylist()):
                for feature in {f for word in words_of(text) for f in word_features(word)}:
                    found.setdefault(feature, [0, 0])[0 if toxic else 1] += 1
            if len(found) > 500_000:
                yield batch_of(found)
                found = {}
        yield batch_of(found)

    def batch_of(found):
        p, u = zip(*found.values()) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(p, pa.int64()), pa.array(u, pa.int64())], ["feature", "p", "u"])

    return sample.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def design(sample: DataFrame, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Toxic flags and feature numbers of the sample, which has at most TOXIC_ROWS + UNLABELLED_ROWS rows."""

    def read(batches):
        chosen = Chosen(names)
        for rows in text_slices(batches):
            found = [np.array(chosen.of_text(text), dtype="<i4").tobytes() for text in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), pa.array(found, pa.binary())], ["toxic", "found"])

    rows = sample.mapInArrow(read, "toxic boolean, found binary").collect()
    rows = sorted((not r.toxic, bytes(r.found)) for r in rows)
    return np.array([not u for u, _ in rows], dtype=bool), [np.frombuffer(f, dtype="<i4") for _, f in rows]


def logistic(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of a margin and its slope."""
    return np.logaddexp(0, -margin), -1 / (1 + np.exp(np.clip(margin, -50, 50)))


def fit(toxic: np.ndarray, rows: list[np.ndarray], n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk

        prior * E_p[l(f)]  +  max(0, E_u[l(-f)] - prior * E_p[l(-f)]).

    Each batch holds its part of both samples.
    """
    rng = np.random.default_rng(SEED)
    weights = np.zeros(n_features + 1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    p, u = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    step = 0
    for _ in range(EPOCHS):
        for some_p, some_u in zip(np.array_split(rng.permutation(p), BATCHES), np.array_split(rng.permutation(u), BATCHES)):
            if not len(some_p) or not len(some_u):
                continue
            at = np.concatenate([some_p, some_u])
            columns = np.concatenate([rows[i] for i in at])
            places = np.repeat(np.arange(len(at)), [len(rows[i]) for i in at])
            f = np.bincount(places, weights[columns], minlength=len(at)) + weights[-1]
            k = len(some_p)
            _, up_slope = logistic(f[:k])
            loss_p, down_p = logistic(-f[:k])
            loss_u, down_u = logistic(-f[k:])
            slope = np.zeros(len(at))
            if loss_u.mean() - prior * loss_p.mean() >= 0:
                slope[:k] = prior * up_slope / k + prior * down_p / k
                slope[k:] = -down_u / (len(at) - k)
            else:
                slope[:k] = prior * up_slope / k
            gradient = np.append(np.bincount(columns, slope[places], minlength=n_features), slope.sum())
            gradient[:-1] += DECAY * weights[:-1]
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient**2
            weights -= STEP * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1])


# Bias of a model that has learned nothing.
CLEAN = -10.0


def train(docs: DataFrame, labels: DataFrame, use=lambda doc_id: ~is_held_out(doc_id)) -> tuple[list[str], np.ndarray, float]:
    """Feature names, weights and bias learned from the rows that ``use`` admits.

    ``docs`` holds ``doc_id, text``, ``labels`` holds ``doc_id, toxic``. Without a toxic row, or without a feature that tells toxic rows, there is nothing to
    learn: no features, and a bias that calls everything clean.
    """
    sample, prior = sample_of(docs, labels, use)
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u or prior <= 0:
        return [], np.zeros(0), CLEAN
    p, u = F.col("p") / n_p, F.col("u") / n_u
    spread = F.sqrt((p * (1 - p) + 1 / n_p) / n_p + (u * (1 - u) + 1 / n_u) / n_u)
    z = F.round((p - u) / spread, 6)
    telling = feature_counts(sample).where((F.col("p") >= max(LEAST_ROWS, LEAST_PART * n_p)) & (prior * p >= LEAST_PURITY * u) & (z >= LEAST_ERRORS))
    best = telling.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(FEATURES)
    names = [r.feature for r in best.collect()]
    if not names:
        return [], np.zeros(0), CLEAN
    weights, bias = fit(*design(sample, names), len(names), prior)
    return names, weights, bias


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float], text_col: str = "text", name: str = "score") -> DataFrame:
    """Add a column ``name`` (0 to 1) to every row, from the text alone; a column already called so is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c.lower() != name.lower()]
    docs = docs.select(*[f"`{c}`" for c in columns])

    def look(batches):
        names, weights, bias = shared.value
        chosen = Chosen(names)
        for rows in text_slices(batches, text_col):
            margins = np.array([weights[chosen.of_text(text or "")].sum() + bias for text in rows.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(1 / (1 + np.exp(-np.clip(margins, -50, 50))), pa.float64())], [*columns, name])

    return docs.mapInArrow(look, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels of held-out ids are not used. A null text counts as empty and gets the score of a text without a feature; a null id is not
    held out and not learned from; repeated ids are scored row by row, their labels count once (toxic if any is); an
    empty table gives an empty one; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    scored = score(docs, train(docs, labels.select("doc_id", "toxic")))
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that score below one half, as they were, whatever their further columns are called.

    Null and empty texts score as a text without a feature and stay; rows with a null id are judged by their text; repeated rows are
    judged alike; without labels, or without rows, nothing is rejected; a text of any length is read whole, by one task.
    """
    (name,) = free_names(docs.columns, ["score"])
    model = train(id_and_text(docs), labels.select("doc_id", "toxic"))
    return score(docs, model, name=name).where(F.col(name) < 0.5).select(*[f"`{c}`" for c in docs.columns])
