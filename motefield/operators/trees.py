"""Trees grown level by level from aggregates: extremely randomised trees, and boosting of symmetric trees.

No row is moved or marked. A task finds the node of each of its rows by walking the trees grown so far, and adds up what the next level
needs in one vector; vectors are merged in two levels and the driver, which holds the trees, picks the splits. All trees of a
forest grow side by side, so a forest takes two jobs a level however many trees it has. The trees of a forest that only has to score some rows
are grown so as far as a node has many rows; the rest of each is grown by a task of its own, which scores the rows that fall there, and no
such subtree reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motefield.operators.batched import added
from motefield.runtime import materialise, packed

# Rows up to which a table is one partition, whose jobs need no shuffle.
ONE_PARTITION = 20_000
# Numbers in the vector of one job; a level with more nodes is worked in several jobs.
VECTOR_LENGTH = 4 << 20
# Train rows of a node from which on its subtree is grown in one task.
SUBTREE_ROWS = 20_000


def inputs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return np.array(frame["features"].tolist(), dtype=float).reshape(len(frame), -1), frame["label"].to_numpy().astype(int)


def with_predictions(rows: DataFrame, scores_of) -> DataFrame:
    """Add ``scores`` (one for each class), ``y_pred`` and ``score`` (positive class of two, else the predicted one)."""
    keep = [c for c in rows.columns if c not in ("scores", "y_pred", "score")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def score(frames):
        for frame in frames:
            x = np.array(frame["features"].tolist(), dtype=float).reshape(len(frame), -1)
            yield frame[keep].assign(scores=list(scores_of(x)))

    return with_choice(rows.select(*keep).mapInPandas(score, f"{kinds}, scores array<double>"))


def with_choice(out: DataFrame) -> DataFrame:
    """``y_pred`` and ``score`` of ``scores``."""
    best = F.array_max(F.transform("scores", lambda s, i: F.struct(s.alias("s"), (-i).alias("c"))))
    out = out.withColumn("y_pred", (-best["c"]).cast("int"))
    return out.withColumn("score", F.when(F.size("scores") == 2, F.get("scores", F.lit(1))).otherwise(F.get("scores", F.col("y_pred"))))


# --- extremely randomised trees -----------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order of their making; a leaf has feature -1. ``counts`` are the train rows of each class."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    counts: list[np.ndarray] = field(default_factory=list)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row; the right child follows the left one."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.flatnonzero(feature[at] >= 0)
        while len(moving):
            now = at[moving]
            at[moving] = left[now] + (x[moving, feature[now]] > threshold[now])
            moving = moving[feature[at[moving]] >= 0]
        return at

    def split(self, node: int, feature: int, threshold: float, below: np.ndarray) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.left[node] = feature, threshold, len(self.feature)
        for counts in (below, self.counts[node] - below):
            self.feature.append(-1)
            self.threshold.append(0.0)
            self.left.append(-1)
            self.counts.append(counts)
        return len(self.feature) - 2, len(self.feature) - 1


@dataclass
class ExtraTrees:
    trees: list[Tree]
    class_weight: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean of the class shares of the leaves of all trees."""
        out = np.zeros((len(x), len(self.class_weight)))
        for tree in self.trees:
            shares = np.array(tree.counts) * self.class_weight
            out += (shares / shares.sum(axis=1, keepdims=True))[tree.nodes(x)]
        return out / len(self.trees)


def draws(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, inspect: int, *above: int) -> list[tuple[int, float]]:
    """Features to look at in a node, constant ones passed over, each with a threshold drawn evenly between its bounds there."""
    rng = np.random.default_rng([seed, tree, node, *above])
    order, shares = rng.permutation(len(low)), rng.random(len(low))
    varied = [int(j) for j in order if high[j] > low[j]][:inspect]
    return [(j, float(low[j] + shares[j] * (high[j] - low[j]))) for j in varied if low[j] + shares[j] * (high[j] - low[j]) < high[j]]


def impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times weight."""
    total = counts.sum(axis=-1)
    return total - (counts**2).sum(axis=-1) / np.where(total > 0, total, 1.0)


def fit_extra_trees(
    rows: DataFrame, classes: int, trees: int = 300, depth: int | None = None, leaf: int = 1, split: int = 2, subset: str | None = "sqrt",
    balanced: bool = False, seed: int = 42, stop: int = 0,
) -> ExtraTrees:
    """Trees on all rows (``features`` array, ``label`` 0..classes-1), split at thresholds drawn between the bounds of the node.

    Each level is two jobs: bounds of every feature in every open node, then class counts below the drawn thresholds. ``leaf`` and
    ``split`` are the least rows of a leaf and of a node that is split; no ``depth`` grows until leaves are pure. Nodes of at most ``stop``
    rows are left as they are.
    """
    data = rows.select("features", F.col("label").cast("int").alias("label"))

    def count(frames):
        for frame in frames:
            _, y = inputs(frame)
            yield pd.DataFrame({"v": [np.bincount(y, minlength=classes).astype(float).tobytes()]})

    whole = added(data.mapInPandas(count, "v binary"))
    if whole is None:
        raise ValueError("no rows to grow trees on")
    n = int(whole.sum())
    data = packed(materialise(data), n, ONE_PARTITION)
    width = len(data.select("features").first()[0])
    inspect = inspected(width, subset)
    weight = whole.sum() / ((whole > 0).sum() * np.maximum(whole, 1)) if balanced else np.ones(classes)
    forest = [Tree(counts=[whole.copy()]) for _ in range(trees)]
    open_ = [(t, 0) for t in range(trees)]
    level = 0
    while open_ and (depth is None or level < depth):
        open_ = [(t, n) for t, n in open_ if (c := forest[t].counts[n]).sum() >= max(split, 2 * leaf, stop + 1) and (c > 0).sum() > 1]
        grown: list[tuple[int, int]] = []
        step = max(1, VECTOR_LENGTH // max(2 * width, inspect * classes))
        for start in range(0, len(open_), step):
            part = open_[start : start + step]
            grown += _grow(data, forest, part, width, classes, inspect, leaf, weight, seed, n < ONE_PARTITION)
        open_, level = grown, level + 1
    return ExtraTrees(forest, weight)


def _by_tree(part: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Of each tree its nodes with their places in the list."""
    out: dict[int, list[tuple[int, int]]] = {}
    for place, (tree, node) in enumerate(part):
        out.setdefault(tree, []).append((place, node))
    return out


def _node_rows(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by their leaf, and the border of every node in that order."""
    at = tree.nodes(x)
    order = np.argsort(at, kind="stable")
    return order, np.searchsorted(at[order], np.arange(len(tree.feature) + 1))


def _grow(data, forest, part, width, classes, inspect, leaf, weight, seed, single) -> list[tuple[int, int]]:
    wanted = _by_tree(part)
    shared = data.sparkSession.sparkContext.broadcast({t: forest[t] for t in wanted})

    def bounds(frames):
        for frame in frames:
            x, _ = inputs(frame)
            out = np.full((len(part), 2, width), np.inf)
            for t, nodes in wanted.items():
                order, edges = _node_rows(shared.value[t], x)
                for place, node in nodes:
                    own = x[order[edges[node] : edges[node + 1]]]
                    if len(own):
                        out[place] = own.min(axis=0), -own.max(axis=0)
            yield pd.DataFrame({"v": [out.tobytes()]})

    found = added(data.mapInPandas(bounds, "v binary"), "minimum", single).reshape(len(part), 2, width)
    drawn = [draws(seed, t, n, found[p, 0], -found[p, 1], inspect) for p, (t, n) in enumerate(part)]

    def below(frames):
        for frame in frames:
            x, y = inputs(frame)
            hot = np.eye(classes)[y]
            out = np.zeros((len(part), inspect, classes))
            for t, nodes in wanted.items():
                order, edges = _node_rows(shared.value[t], x)
                for place, node in nodes:
                    own = order[edges[node] : edges[node + 1]]
                    for k, (j, threshold) in enumerate(drawn[place]):
                        out[place, k] = hot[own[x[own, j] <= threshold]].sum(axis=0)
            yield pd.DataFrame({"v": [out.tobytes()]})

    counts = added(data.mapInPandas(below, "v binary"), single=single).reshape(len(part), inspect, classes)
    grown = []
    for place, (t, node) in enumerate(part):
        k = best_draw(forest[t].counts[node], counts[place, : len(drawn[place])], leaf, weight)
        if k is not None:
            grown += [(t, child) for child in forest[t].split(node, *drawn[place][k], counts[place, k])]
    return grown


def inspected(width: int, subset: str | None) -> int:
    return {"sqrt": max(1, int(np.sqrt(width))), "log2": max(1, int(np.log2(width)))}.get(subset or "all", width)


def best_draw(parent: np.ndarray, left: np.ndarray, leaf: int, weight: np.ndarray) -> int | None:
    """The first of the splits that lower the impurity most, of those whose sides have enough rows."""
    right = parent - left
    fits = (left.sum(axis=1) >= leaf) & (right.sum(axis=1) >= leaf)
    if not fits.any():
        return None
    gain = np.round((impurity(parent * weight) - impurity(left * weight) - impurity(right * weight)) / (parent * weight).sum(), 12)
    return int(np.where(fits, gain, -np.inf).argmax())


def grow_subtree(x, y, classes, number, above, inspect, depth, leaf, split, weight, seed) -> Tree:
    """What :func:`fit_extra_trees` grows, on rows that are at hand; ``above`` names the node of a larger tree in place of which it stands."""
    hot = np.eye(classes)[y]
    tree = Tree(counts=[hot.sum(axis=0)])
    level, grown = [(0, np.arange(len(x)))], 0
    while level and (depth is None or grown < depth):
        below = []
        for node, own in level:
            counts = tree.counts[node]
            if len(own) < max(split, 2 * leaf) or (counts > 0).sum() < 2:
                continue
            part = x[own]
            drawn = draws(seed, number, node, part.min(axis=0), part.max(axis=0), inspect, *above)
            if not drawn:
                continue
            sides = [part[:, j] <= threshold for j, threshold in drawn]
            left = np.array([hot[own[side]].sum(axis=0) for side in sides])
            k = best_draw(counts, left, leaf, weight)
            if k is not None:
                a, b = tree.split(node, *drawn[k], left[k])
                below += [(a, own[sides[k]]), (b, own[~sides[k]])]
        level, grown = below, grown + 1
    return tree


def _depths(tree: Tree) -> np.ndarray:
    out = np.zeros(len(tree.feature), dtype=int)
    for node, left in enumerate(tree.left):
        if left >= 0:
            out[left : left + 2] = out[node] + 1
    return out


def extra_tree_scores(
    train: DataFrame, test: DataFrame, row_id: str, classes: int, trees: int = 300, depth: int | None = None, leaf: int = 1, split: int = 2,
    subset: str | None = "sqrt", balanced: bool = False, seed: int = 42, subtree_rows: int = SUBTREE_ROWS,
) -> DataFrame:
    """``row_id, scores`` of the test rows (``features`` array) by a forest as :func:`fit_extra_trees` grows it.

    Levels of nodes with more than ``subtree_rows`` train rows are grown from aggregates and kept by the driver. Below them train and test
    rows go to a group for each tree and node, that grows the subtree and gives the shares of its test rows.
    """
    top = fit_extra_trees(train, classes, trees, depth, leaf, split, subset, balanced, seed, subtree_rows)
    weight = top.class_weight
    width = len(train.select("features").first()[0])
    inspect = inspected(width, subset)
    kind = dict(test.dtypes)[row_id]

    def unfinished(tree: Tree) -> np.ndarray:
        """Leaves that a task has to go on from."""
        counts, ends = np.array(tree.counts), np.array(tree.feature) < 0
        large = counts.sum(axis=1)
        out = ends & (large <= subtree_rows) & (large >= max(split, 2 * leaf)) & ((counts > 0).sum(axis=1) > 1)
        return out if depth is None else out & (_depths(tree) < depth)

    shared = train.sparkSession.sparkContext.broadcast((top.trees, [unfinished(t) for t in top.trees]))

    def route(frames):
        for frame in frames:
            x = np.array(frame["features"].tolist(), dtype=float).reshape(len(frame), -1)
            for number, (tree, open_) in enumerate(zip(*shared.value)):
                node = tree.nodes(x)
                own = open_[node]
                if own.any():
                    yield frame[own].assign(tree=number, node=node[own])

    def finished(frames):
        for frame in frames:
            x = np.array(frame["features"].tolist(), dtype=float).reshape(len(frame), -1)
            out = np.zeros((len(frame), classes))
            for tree, open_ in zip(*shared.value):
                shares, node = np.array(tree.counts) * weight, tree.nodes(x)
                shares = np.where(open_[:, None], 0.0, shares / shares.sum(axis=1, keepdims=True))
                out += shares[node]
            yield pd.DataFrame({"row": frame["row"], "votes": list(out)})

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.array(frame["features"].tolist(), dtype=float).reshape(len(frame), -1)
        asked = frame["label"].to_numpy() < 0
        number, node = int(frame["tree"].iloc[0]), int(frame["node"].iloc[0])
        if not asked.any():
            return pd.DataFrame({"row": [], "votes": []}, dtype=object)
        left = None if depth is None else depth - _depths(shared.value[0][number])[node]
        y = frame["label"].to_numpy()[~asked].astype(int)
        tree = grow_subtree(x[~asked], y, classes, number, (node,) if node else (), inspect, left, leaf, split, weight, seed)
        shares = np.array(tree.counts) * weight
        return pd.DataFrame({"row": frame["row"][asked], "votes": list((shares / shares.sum(axis=1, keepdims=True))[tree.nodes(x[asked])])})

    known = train.select(F.lit("").alias("row"), "features", F.col("label").cast("int").alias("label"))
    wanted = test.select(F.col(row_id).cast("string").alias("row"), "features", F.lit(-1).alias("label"))
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    routed = known.unionByName(wanted).repartition(tasks)
    routed = routed.mapInPandas(route, "row string, features array<double>, label int, tree int, node long")
    groups = min(2000, max(tasks, sum(int(o.sum()) for o in shared.value[1])))
    votes = routed.repartition(groups, "tree", "node").groupBy("tree", "node").applyInPandas(score, "row string, votes array<double>")
    votes = votes.unionByName(wanted.mapInPandas(finished, "row string, votes array<double>"))
    sums = votes.groupBy("row").agg(*[F.sum(F.get("votes", F.lit(c))).alias(f"v{c}") for c in range(classes)])
    return sums.select(F.col("row").cast(kind).alias(row_id), F.array(*[F.col(f"v{c}") / trees for c in range(classes)]).alias("scores"))


# --- boosting of symmetric trees ----------------------------------------------------------


@dataclass
class Boosted:
    """Rounds of symmetric trees: one (feature, border) for each level and a value for each leaf and class."""

    start: np.ndarray
    rate: float
    rounds: list[tuple[list[tuple[int, float]], np.ndarray]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray, first: int = 0, base: np.ndarray | None = None) -> np.ndarray:
        out = np.tile(self.start, (len(x), 1)) if base is None else base.copy()
        for splits, values in self.rounds[first:]:
            out += self.rate * values[leaves(x, splits)]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(x))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def leaves(x: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.int64)
    for j, border in splits:
        out = 2 * out + (x[:, j] > border)
    return out


def borders_of(rows: DataFrame, width: int, most: int) -> list[np.ndarray]:
    """Borders between bins of about equally many rows for each feature; no border cuts off nothing."""
    columns = rows.select(*[F.get("features", F.lit(j)).alias(f"f{j}") for j in range(width)])
    shares = [(i + 1) / (most + 1) for i in range(most)]
    found = columns.approxQuantile(columns.columns, shares, 0.1 / (most + 1))
    tops = columns.agg(*[F.max(c).alias(c) for c in columns.columns]).first()
    return [np.array(sorted({v for v in marks if v < tops[j]})) for j, marks in enumerate(found)]


def best_split(sums: np.ndarray, penalty: float) -> tuple[int, int] | None:
    """Feature and border of the split of a whole level with the largest gain.

    ``sums`` (2, leaves, classes, features, bins) holds slopes and curvatures.
    """
    below = np.cumsum(sums, axis=-1)[..., :-1]
    above = sums.sum(axis=-1, keepdims=True) - below
    gain = lambda s: (s[0] ** 2 / (s[1] + penalty)).sum(axis=(0, 1))
    value = gain(below) + gain(above)
    if not value.size:
        return None
    j, b = np.unravel_index(int(value.argmax()), value.shape)
    return int(j), int(b)


def fit_boosting(
    rows: DataFrame, classes: int, depth: int = 4, rate: float = 0.1, rounds: int = 200, penalty: float = 3.0, bins: int = 32, kept_rounds: int = 25
) -> Boosted:
    """Softmax boosting (``features`` array, ``label`` 0..classes-1) with L2 weight ``penalty`` on leaf values.

    A level is one job: slopes and curvatures by (leaf, class, feature, bin); the split with the largest gain holds for the whole
    level. Margins are written with the rows every ``kept_rounds`` rounds, so a job only walks the rounds since. Loss before each round is kept
    in ``losses``.
    """
    data = rows.select("features", F.col("label").cast("int").alias("label"))
    first = data.select("features").first()
    if first is None:
        raise ValueError("no rows to learn from")
    width = len(first[0])
    borders = borders_of(data, width, bins - 1)
    slots = max([len(b) for b in borders], default=0) + 1
    model = Boosted(np.zeros(classes), rate)
    n = data.count()
    data = packed(materialise(data.withColumn("margin", F.array_repeat(F.lit(0.0), classes))), n, ONE_PARTITION)
    done, single = 0, n < ONE_PARTITION

    def state(frame, model, done):
        x, y = inputs(frame)
        base = np.array(frame["margin"].tolist(), dtype=float).reshape(len(frame), classes)
        margins = model.margins(x, done, base)
        p = softmax(margins)
        hot = np.eye(classes)[y]
        return x, y, margins, p - hot, p * (1 - p), -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()

    for _ in range(rounds):
        splits: list[tuple[int, float]] = []
        for level in range(depth + 1):

            def look(frames, model=model, done=done, splits=tuple(splits), level=level):
                for frame in frames:
                    x, _, _, slope, curve, loss = state(frame, model, done)
                    leaf = leaves(x, list(splits))
                    out = np.zeros((2, 2**level, classes, width, slots)) if level < depth else np.zeros((2, 2**level, classes))
                    if level == depth:
                        for k, part in enumerate((slope, curve)):
                            np.add.at(out[k], leaf, part)
                    else:
                        for j in range(width):
                            bin_ = np.searchsorted(borders[j], x[:, j], side="left")
                            for k, part in enumerate((slope, curve)):
                                for c in range(classes):
                                    np.add.at(out[k, :, c, j, :], (leaf, bin_), part[:, c])
                    yield pd.DataFrame({"v": [np.concatenate([[loss], out.ravel()]).tobytes()]})

            total = added(data.mapInPandas(look, "v binary"), single=single)
            if level == 0:
                model.losses.append(float(total[0]))
            sums = total[1:].reshape((2, 2**level, classes, width, slots) if level < depth else (2, 2**level, classes))
            if level == depth:
                model.rounds.append((splits, -sums[0] / (sums[1] + penalty)))
                break
            found = best_split(sums, penalty)
            if found is None or found[1] >= len(borders[found[0]]):
                return model
            splits.append((found[0], float(borders[found[0]][found[1]])))
        if len(model.rounds) - done >= kept_rounds:

            def advance(frames, model=model, done=done):
                for frame in frames:
                    margins = state(frame, model, done)[2]
                    yield frame.assign(margin=list(margins))

            data = materialise(data.mapInPandas(advance, "features array<double>, label int, margin array<double>"))
            done = len(model.rounds)
    return model
