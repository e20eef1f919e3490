"""Learned scores on data that can be told apart, and the pipeline."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from motefield.llm import bpe, decontaminate, masked_lm, minhash, secrets, toxicity


def corpus(n=1500):
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]
    bad = ["grumbol", "vexilo", "tranko"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "sa", "ti", "mo"])
        docs.append((i, " ".join(words), toxic))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def toxic_tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(spark, toxic_tables):
    docs, labels = toxic_tables
    truth = {i: t for i, _, t in corpus()[0]}
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r.predicted == 1 for r in held if truth[r.doc_id]]
    clean = [r.predicted == 0 for r in held if not truth[r.doc_id]]
    assert np.mean(caught) >= 0.9 and np.mean(clean) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_held_out_labels_are_not_used(spark, toxic_tables):
    docs, labels = toxic_tables
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.is_held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert one == two


def test_odd_toxicity(spark, odd, none, odd_texts, toxic_tables):
    _, labels = toxic_tables
    got = toxicity.toxicity(odd, labels).collect()
    assert len(got) == len(odd_texts) and all(r.predicted == 0 for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.where("1 = 0")).where("predicted = 1").count() == 0
    repeated = spark.createDataFrame([(3, 1), (3, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(odd, repeated).count() == len(odd_texts)
    kept = toxicity.reject_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(odd_texts)


def test_the_risk_is_never_pulled_below_zero():
    """The fit does not learn unlabelled rows by heart: rare features of unlabelled rows stay weak."""
    rng = np.random.default_rng(1)
    toxic = np.arange(400) < 100
    rows = [np.unique(np.append(rng.integers(1, 2000, 10), 0) if t or i % 10 == 0 else rng.integers(1, 2000, 10)).astype("<i4") for i, t in enumerate(toxic)]
    weights, bias = toxicity.fit(toxic, rows, 2000, 0.1)
    assert weights[0] + bias > 0 > bias and weights[0] > 5 * np.abs(weights[1:]).mean()


def test_model_prefers_text_in_order(spark, monkeypatch):
    """Short steps, as the table is small: the model learns which words stand next to each other."""
    monkeypatch.setattr(masked_lm, "STEP_WORDS", 128)
    rng = random.Random(4)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(2)] for i in range(60)}

    def walk(n):
        out = ["w1"]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return out

    texts = [(i, " ".join(walk(80))) for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    model = masked_lm.train(masked_lm.id_and_text(docs))
    mixed = [(i, " ".join(rng.sample(t.split(), 80))) for i, t in texts[:100]]
    real = masked_lm.pseudo_likelihood(docs.where("doc_id < 100"), model).toPandas()
    shuffled = masked_lm.pseudo_likelihood(spark.createDataFrame(mixed, "doc_id long, text string"), model).toPandas()
    assert real.mean_log_prob.mean() > shuffled.mean_log_prob.mean() + 0.5
    assert (real.n_tokens == 80).all() and np.allclose(real.log_prob / 80, real.mean_log_prob, atol=1e-4)


def test_every_word_is_learned_once(spark, monkeypatch):
    """The rounds' targets are disjoint and cover all words; the weights of the changes count the words that were learned."""
    learned, averaged = [], masked_lm.averaged
    monkeypatch.setattr(masked_lm, "averaged", lambda changes: (learned.append(changes.where("piece = 0").agg(masked_lm.F.sum("weight")).first()[0]), averaged(changes))[1])
    texts = [(i, " ".join(f"w{(i * k) % 50}" for k in range(i % 40))) for i in range(300)]
    masked_lm.train(masked_lm.id_and_text(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)))
    assert len(learned) == masked_lm.ROUNDS and sum(learned) == sum(len(t.split()) for _, t in texts)
    offsets = np.array([0, 0, 1, 900, 900, 2000])
    found = np.concatenate([masked_lm.targets(offsets, turn) for turn in range(masked_lm.ROUNDS)])
    assert sorted(found.tolist()) == list(range(2000))


def test_scores_are_sums_of_conditional_log_probabilities(spark):
    docs = spark.createDataFrame([(1, "a b c a b"), (2, "b"), (3, "a b c a b")], "doc_id long, text string")
    flat, kind, within = masked_lm.train(masked_lm.id_and_text(docs))
    got = {r.doc_id: r for r in masked_lm.pseudo_likelihood(docs, (flat, kind, within)).collect()}
    p = masked_lm.split(flat)
    for i, text in ((1, "a b c a b"), (2, "b")):
        units, _ = masked_lm.units_of(masked_lm.pa.array([text]))
        total = 0.0
        for k in range(len(units)):
            around = [units[k + o] if 0 <= k + o < len(units) else masked_lm.UNITS for o in masked_lm.PLACES]
            hidden = np.tanh(p["embedding"][around].ravel() @ p["mix"] + p["bend"])
            logits = (hidden @ p["out"] + p["lean"]).astype(np.float64)
            total += logits[kind[units[k]]] - np.log(np.exp(logits).sum()) + within[units[k]]
        assert abs(got[i].log_prob - total) < 1e-2
    assert abs(got[1].log_prob - got[3].log_prob) < 1e-3
    sizes = np.bincount(kind, np.exp(within), minlength=masked_lm.CLASSES)
    assert np.allclose(sizes[np.unique(kind)], 1)


def test_odd_model_rows(odd, none, odd_texts):
    got = masked_lm.pseudo_likelihood(odd).collect()
    assert len(got) == len(odd_texts)
    assert {(r.n_tokens, r.log_prob, r.mean_log_prob) for r in got if r.doc_id in (0, 1, 2)} == {(0, 0.0, None)}
    assert masked_lm.pseudo_likelihood(none).count() == 0


def test_toxicity_without_a_telling_feature_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.reject_toxic(docs, labels).count() == 2
    assert all(r.score < 0.5 and r.predicted == 0 for r in toxicity.toxicity(docs, labels).collect())


def test_pipeline_stages_by_their_decisions(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark", "secrets", "encode"]
    want = docs
    for (_, stage), decide in zip(
        corpus_pipeline.STAGES,
        [
            lambda d: {r.doc_id for r in toxicity.toxicity(d, labels).where("predicted = 0").collect()},
            lambda d: {r.doc_id for r in minhash.near_duplicates(d, link=corpus_pipeline.NEAR).where("kept").collect()},
            lambda d: {r.doc_id for r in decontaminate.contamination(d, items).where("not contaminated").collect()},
            lambda d: {r.doc_id for r in d.collect()},
        ],
    ):
        out = stage(spark, want, sf_dir).cache()
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == decide(want)
        want = out
    assert secrets.secret_report(want).where("n_assign + n_access + n_hex > 0").count() == 0
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    again = {r.doc_id: r for r in bpe.encode_documents(want, keep_ids=True).collect()}
    assert final == again and 0 < len(final) < docs.count()


def test_pipeline_with_near_copies_from_four_fifths_on(spark):
    """The near-duplicate stage links from 0.8 on; the stages after it work on what that leaves."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir).cache()
    kept = stages["near_duplicates"](spark, clean, sf_dir).cache()
    at = {link: {r.doc_id for r in minhash.near_duplicates(clean, link=link).where("kept").collect()} for link in (80, 85)}
    assert {r.doc_id for r in kept.collect()} == at[80] < at[85]
    rest = decontaminate.contamination(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated")
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id for r in rest.collect()}


def test_pipeline_on_odd_documents(spark, odd, none):
    docs = odd.selectExpr("doc_id", "text", "n as lang", "v as source", "cast(null as long) as n_chars")
    for some in (docs, docs.where("1 = 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, "/root/testdata/sf0.001").cache()
            out.count()
            if name != "encode":
                assert out.columns == docs.columns
                some = out
