"""Trees grown from aggregates against plain numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motefield.operators import trees


def made(n=240, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 4] = 2.0
    return x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(int) + (x[:, 3] > 1).astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made()
    table = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(table, "row_id long, features array<double>, label int").repartition(3).cache()


def plain_tree(x, y, tree, inspect, leaf, depth, seed, weight):
    """The same draws, one node after the other, rows cut apart."""
    made = trees.Tree(counts=[np.bincount(y, minlength=3).astype(float)])
    level = {0: np.arange(len(x))}
    for _ in range(depth):
        below = {}
        for node in sorted(level):
            own = level[node]
            counts = made.counts[node]
            if counts.sum() < max(2, 2 * leaf) or (counts > 0).sum() < 2:
                continue
            best = None
            for j, t in trees.draws(seed, tree, node, x[own].min(axis=0), x[own].max(axis=0), inspect):
                left = np.bincount(y[own[x[own, j] <= t]], minlength=3).astype(float)
                if left.sum() >= leaf and (counts - left).sum() >= leaf:
                    gini = lambda c: (c * weight).sum() * (1 - (((c * weight) / (c * weight).sum()) ** 2).sum())
                    gain = gini(counts) - gini(left) - gini(counts - left)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, j, t, left)
            if best:
                _, j, t, left = best
                a, b = made.split(node, j, t, left)
                below[a], below[b] = own[x[own, j] <= t], own[x[own, j] > t]
        level = below
    return made


@pytest.mark.parametrize("balanced", [False, True])
def test_extra_trees_equal_plain_growth(rows, monkeypatch, balanced):
    """Node for node, in one job a level and in many; every tree counts all rows and thresholds are not taken from the sample."""
    x, y = made()
    forest = trees.fit_extra_trees(rows, 3, trees=6, depth=5, leaf=2, balanced=balanced, seed=7)
    monkeypatch.setattr(trees, "VECTOR_LENGTH", 40)
    small = trees.fit_extra_trees(rows, 3, trees=6, depth=5, leaf=2, balanced=balanced, seed=7)
    counts = np.bincount(y)
    weight = len(y) / (3 * counts) if balanced else np.ones(3)
    for t, tree in enumerate(forest.trees):
        want = plain_tree(x, y, t, 2, 2, 5, 7, weight)
        assert tree.feature == want.feature and np.allclose(tree.threshold, want.threshold) and np.allclose(tree.counts, want.counts)
        assert sorted(zip(small.trees[t].feature, small.trees[t].threshold)) == sorted(zip(tree.feature, tree.threshold))
        ends = [c for c, f in zip(tree.counts, tree.feature) if f < 0]
        assert sum(c.sum() for c in ends) == 240 and min(c.sum() for c in ends) >= 2 and 4 not in tree.feature
        assert not set(tree.threshold) & set(x.ravel()) - {0.0}


def test_extra_trees_learn_and_predict(rows):
    forest = trees.fit_extra_trees(rows, 3, trees=40)
    x, y = made(400, 6)
    assert (forest.scores(x).argmax(axis=1) == y).mean() > 0.7
    own = trees.with_predictions(rows, forest.scores)
    assert own.where(F.col("y_pred") != F.col("label")).count() == 0 and set(own.columns) >= {"scores", "y_pred", "score"}


def plain_boosting(x, y, classes, depth, rate, rounds, penalty, borders):
    margins, hot, out, losses = np.zeros((len(x), classes)), np.eye(classes)[y], [], []
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        losses.append(-np.log(p[np.arange(len(y)), y]).sum())
        g, h, leaf, splits = p - hot, p * (1 - p), np.zeros(len(x), dtype=int), []
        for _ in range(depth):
            best = None
            for j in range(x.shape[1]):
                for b in borders[j]:
                    value = 0.0
                    for cell in np.unique(leaf):
                        for side in (x[:, j] <= b, x[:, j] > b):
                            own = (leaf == cell) & side
                            value += (g[own].sum(axis=0) ** 2 / (h[own].sum(axis=0) + penalty)).sum()
                    if best is None or value > best[0] + 1e-9:
                        best = (value, j, b)
            splits.append((best[1], float(best[2])))
            leaf = 2 * leaf + (x[:, best[1]] > best[2])
        values = np.zeros((2**depth, classes))
        for cell in range(2**depth):
            values[cell] = -g[leaf == cell].sum(axis=0) / (h[leaf == cell].sum(axis=0) + penalty)
        margins = margins + rate * values[leaf]
        out.append((splits, values))
    return out, losses


def test_boosting_equals_plain_growth(rows):
    """The same symmetric trees and leaf values, margins written on the way or not; the loss falls in every round."""
    x, y = made()
    borders = trees.borders_of(rows, 5, 7)
    assert [len(b) for b in borders[:4]] == [7] * 4 and len(borders[4]) == 0
    model = trees.fit_boosting(rows, 3, depth=3, rate=0.3, rounds=6, penalty=2.0, bins=8, kept_rounds=2)
    want, losses = plain_boosting(x, y, 3, 3, 0.3, 6, 2.0, borders)
    assert [s for s, _ in model.rounds] == [s for s, _ in want]
    assert all(np.allclose(a, b) for (_, a), (_, b) in zip(model.rounds, want)) and np.allclose(model.losses, losses)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and model.losses[0] == pytest.approx(240 * np.log(3))
    assert (model.scores(x).argmax(axis=1) == y).mean() > 0.7


def test_forest_in_parts_keeps_a_few_trees_on_the_driver(spark, rows, monkeypatch):
    """A forest beyond the bound is fitted in parts whose votes are added: every tree votes once, and no fit has more trees than the bound allows."""
    from pyspark.ml.classification import RandomForestClassifier

    from motefield.operators import models

    table = models.as_features(rows).withColumn("label", F.col("label").cast("double"))
    fitted, plain = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, params=None: fitted.append((self.getNumTrees(), self.getSeed())) or plain(self, df))
    whole = models.forest_predict(models.forest(40, 8, 2), table, table).orderBy("row_id").toPandas()
    parts = models.forest_predict(models.forest(40, 8, 2), table, table, forest_rows=240 * 15).orderBy("row_id").toPandas()
    assert fitted == [(40, 42), (15, 42), (15, 57), (10, 72)]
    assert list(whole["row_id"]) == list(parts["row_id"]) and set(parts.columns) >= {"scores", "y_pred", "score"}
    a, b = (np.array(t["scores"].tolist()) for t in (whole, parts))
    assert np.allclose(b.sum(axis=1), 1) and np.abs(a - b).mean() < 0.05 and (b.argmax(axis=1) == parts["y_pred"]).all()
    assert (parts["score"] == b.max(axis=1)).all()


@pytest.mark.parametrize("depth", [None, 4])
def test_subtrees_in_tasks_score_as_the_whole_forest(rows, monkeypatch, depth):
    """Grown in tasks from the root, scores are those of the forest from aggregates, and no level is grown by jobs; from lower nodes on they are near."""
    x, _ = made(150, 9)
    test = rows.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    whole = trees.fit_extra_trees(rows, 3, trees=30, depth=depth, leaf=2, seed=7).scores(x)
    jobs, plain = [], trees._grow
    monkeypatch.setattr(trees, "_grow", lambda *a: jobs.append(1) or plain(*a))
    scores = lambda n: np.array(trees.extra_tree_scores(rows, test, "row_id", 3, 30, depth, 2, seed=7, subtree_rows=n).orderBy("row_id").toPandas()["scores"].tolist())
    assert np.allclose(scores(240), whole) and not jobs
    assert np.allclose(scores(0), whole) and jobs
    cut = scores(60)
    assert cut.shape == whole.shape and np.allclose(cut.sum(axis=1), 1) and np.abs(cut - whole).mean() < 0.06
