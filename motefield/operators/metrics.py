"""Evaluation of predictions; every metric is an aggregation over the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motefield.ranking import BUCKET, QUANTILE_ROWS, running_totals, value_bucket


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def per_class(df: DataFrame, labels: list[int], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1 and support of each listed class; 0 where undefined."""
    t, p = F.col(true), F.col(pred)
    counts = []
    for c in labels:
        counts += [
            F.count_if((t == c) & (p == c)).alias(f"tp{c}"),
            F.count_if(p == c).alias(f"pp{c}"),
            F.count_if(t == c).alias(f"tt{c}"),
        ]
    entry = [
        F.struct(
            F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"pp{c}").alias("pp"), F.col(f"tt{c}").alias("support")
        )
        for c in labels
    ]
    rows = df.agg(*counts).select(F.explode(F.array(*entry)).alias("_e")).select("_e.*")
    tp, pp, tt = F.col("tp"), F.col("pp"), F.col("support")
    return rows.select(
        "class",
        _ratio(tp, pp).alias("precision"),
        _ratio(tp, tt).alias("recall"),
        _ratio(2 * tp, pp + tt).alias("f1"),
        "support",
    )


def basic(df: DataFrame, labels: list[int], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy and balanced accuracy (mean recall of the classes that occur)."""
    t, p = F.col(true), F.col(pred)
    recalls = [F.avg(F.when(t == c, (p == c).cast("int"))) for c in labels]
    known = F.filter(F.array(*recalls), lambda v: v.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known)
    return df.agg(
        F.avg((t == p).cast("int")).alias("accuracy"), mean.alias("balanced_accuracy"), F.count("*").alias("n")
    )


def classification_report(df: DataFrame, labels: list[int], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows per class plus ``macro avg`` and ``weighted avg``."""
    rows = per_class(df, labels, true, pred)
    named = rows.select(F.col("class").cast("string").alias("name"), "precision", "recall", "f1", "support")
    macro = rows.agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support")
    ).withColumn("name", F.lit("macro avg"))
    total = F.sum("support")
    weighted = rows.agg(
        *[_ratio(F.sum(F.col(c) * F.col("support")), total).alias(c) for c in ("precision", "recall", "f1")],
        total.alias("support"),
    ).withColumn("name", F.lit("weighted avg"))
    return named.unionByName(macro).unionByName(weighted)


def confusion_matrix(df: DataFrame, labels: list[int], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows are true classes, columns ``pred_<class>``; listed classes only."""
    cells = [
        F.count_if((F.col(true) == a) & (F.col(pred) == b)).alias(f"c{a}_{b}") for a in labels for b in labels
    ]
    rows = [
        F.struct(F.lit(a).alias("y_true"), *[F.col(f"c{a}_{b}").alias(f"pred_{b}") for b in labels]) for a in labels
    ]
    return df.agg(*cells).select(F.explode(F.array(*rows)).alias("_e")).select("_e.*")


def _by_score(df: DataFrame, positive: Column, score: str, by: list[str], rows: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score, cut into score buckets."""
    counted = df.groupBy(*by, score).agg(
        F.sum(positive.cast("long")).alias("pos"), F.sum((~positive).cast("long")).alias("neg")
    )
    return value_bucket(counted, score, QUANTILE_ROWS, rows)


def roc_auc(
    df: DataFrame, true: str, score: str, by: list[str] | None = None, n_rows: int | None = None
) -> DataFrame:
    """Rank-sum area under the ROC curve, tied scores share their average rank.

    NULL when only one class occurs. ``n_rows`` is the row count when it is known.
    """
    by = by or []
    rows = _by_score(df, F.col(true) == 1, score, by, n_rows)
    run = running_totals(
        rows, by, [F.col(score)], {"_all": F.col("pos") + F.col("neg"), "_pos": F.col("pos")}, BUCKET
    )
    size = F.col("pos") + F.col("neg")
    rank = F.col("_all") - size + (size + 1) / 2
    sums = run.groupBy(*by).agg(
        F.sum(F.col("pos") * rank).alias("_r"), F.sum("pos").alias("_p"), F.sum("neg").alias("_q")
    )
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    return sums.select(*by, F.when((p > 0) & (q > 0), (F.col("_r") - p * (p + 1) / 2) / (p * q)).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, true: str, scores: str, classes: list[int]) -> DataFrame:
    """Mean of the one-vs-rest areas; ``scores`` is an array with one score per class.

    NULL when a class has no positive or no negative row.
    """
    entry = [
        F.struct(
            F.lit(c).alias("class"), (F.col(true) == c).cast("int").alias("hit"), F.col(scores)[i].alias("score")
        )
        for i, c in enumerate(classes)
    ]
    long = df.select(F.explode(F.array(*entry)).alias("_e")).select("_e.*")
    each = roc_auc(long, "hit", "score", ["class"])
    return each.agg(F.when(F.count("roc_auc") == len(classes), F.avg("roc_auc")).alias("roc_auc_ovr"))


def roc_curve(df: DataFrame, true: str, score: str) -> DataFrame:
    """False and true positive rates at every distinct score, highest score first."""
    rows = _by_score(df, F.col(true) == 1, score, [])
    run = running_totals(rows, [], [F.col(score)], {"_p": F.col("pos"), "_q": F.col("neg")}, BUCKET)
    above_p = F.col("_p_total") - F.col("_p") + F.col("pos")
    above_q = F.col("_q_total") - F.col("_q") + F.col("neg")
    return run.select(
        F.col(score).alias("threshold"),
        _ratio(above_q, F.col("_q_total")).alias("fpr"),
        _ratio(above_p, F.col("_p_total")).alias("tpr"),
    )


def evaluate(
    df: DataFrame, model: str, true: str = "y_true", pred: str = "y_pred", score: str = "score", n_rows: int | None = None
) -> DataFrame:
    """One row of binary metrics for a model."""
    sides = per_class(df, [0, 1], true, pred)
    picks = [
        F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{m}_{name}")
        for c, name in ((0, "no_motion"), (1, "motion"))
        for m in ("precision", "recall", "f1", "support")
    ]
    parts = [basic(df, [0, 1], true, pred).drop("n"), sides.agg(*picks), roc_auc(df, true, score, n_rows=n_rows)]
    out = parts[0].withColumn("model", F.lit(model))
    for part in parts[1:]:
        out = out.join(part.withColumn("model", F.lit(model)), "model")
    return out


def errors(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.filter(F.col(true) != F.col(pred))


def paired_predictions(preds: DataFrame, truth: DataFrame, unit: str) -> DataFrame:
    """Predictions with their truth; fails when a unit is missing on one side."""
    both = preds.withColumn("_p", F.lit(1)).join(truth.withColumn("_t", F.lit(1)), unit, "full_outer")
    whole = F.col("_p").isNotNull() & F.col("_t").isNotNull()
    guard = F.when(whole, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unit without prediction or truth: "), F.col(unit).cast("string"))).cast("boolean")
    )
    return both.filter(guard).drop("_p", "_t")


def logistic_score(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def minmax_score(df: DataFrame, margin: str, out: str, epsilon: float = 1e-8) -> DataFrame:
    """Margin scaled to [0, 1] over the whole table."""
    ends = df.agg(F.min(margin).alias("lo"), F.max(margin).alias("hi")).first()
    if ends["lo"] is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, (F.col(margin) - F.lit(ends["lo"])) / (F.lit(ends["hi"]) - F.lit(ends["lo"]) + epsilon))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes * n_c) per class."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return sizes.withColumn("weight", F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight; the table has one row per class."""
    rows = class_weights(df, label).collect()
    weight = F.lit(None).cast("double")
    for r in rows:
        weight = F.when(F.col(label) == r[label], F.lit(float(r["weight"]))).otherwise(weight)
    return df.withColumn(out, weight)
