"""Queries on feature tables and models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from motefield.catalog.common import rounded, sql_split
from motefield.catalog.registry import query
from motefield.catalog.unit_queries import MOMENTS_SQL, SCALED, SPECTRAL_SQL, SPLIT, STATS_SQL, scaled_series
from motefield.catalog.window_queries import SEGMENTS
from motefield.catalog.views import DEVICES, SIGNAL, lines, packets, packet_layout, signal, signal_layout, table
from motefield.functions.labels import binary_class, distance
from motefield.operators import batched, kernel_svm, metrics, models, neighbours, recordings, splits, trees, units
from motefield.operators.kernel_svm import Candidate
from motefield.plans import log_inference, robustness, unit_models
from motefield.runtime import lookup_join, materialise, new_table_path, packed
from motefield.series import measure
from motefield.sources import artifacts

NAMES = units.UNIT_FEATURES
WIDTH, STEP = 6, 4

# --- exact parts --------------------------------------------------------------------------

FEATURES_SQL = f"""{SCALED}, {STATS_SQL}, {MOMENTS_SQL}, {SPECTRAL_SQL},
zc as (select unit_id, t, x < avg(x) over (partition by unit_id) as neg from scaled),
zd as (select unit_id, case when lag(neg) over w is null then null when neg <> lag(neg) over w then 1 else 0 end as flip from zc window w as (partition by unit_id order by t)),
zcr as (select unit_id, avg(flip) as zcr from zd group by 1),
units as (select distinct unit_id, recording_id, device, label from signal),
features as (
  select u.unit_id, u.recording_id, u.device, u.label, role, mean, std, median, skew, kurtosis, spectral_centroid, spectral_spread, spectral_entropy, dominant_freq,
    spectral_rolloff_85, min, max, q25, q75, iqr, "range", rms, energy, zcr
  from units u join stats using (unit_id) join moments using (unit_id) join spec using (unit_id) join zcr using (unit_id)
  join split s on s.recording_id=u.recording_id and s.label=u.label)"""


def sql_name(c: str) -> str:
    return '"range"' if c == "range" else c


def features(spark, sf_dir):
    """Unit features with their split role."""
    df, layout = scaled_series(spark, sf_dir)
    rows = materialise(units.unit_features(df, "x", layout.with_keys(*unit_models.UNIT)))
    return rows.join(splits.stratified_split(rows, "recording_id", ["label"]), ["recording_id", "label"])


@query("unit_features", f"with {FEATURES_SQL} select unit_id, {', '.join(f'round({sql_name(c)},6) as {sql_name(c)}' for c in NAMES)} from features")
def unit_features(spark, sf_dir):
    return rounded(features(spark, sf_dir).select("unit_id", *NAMES))


LIMITS = f"""limits as (select device, {', '.join(f'min({sql_name(c)}) as lo_{c}, max({sql_name(c)}) as hi_{c}' for c in NAMES)} from features where role='train' group by device)"""


@query("feature_bounds", f"with {FEATURES_SQL}, {LIMITS} " + " union all ".join(
    f"select device, '{c}' as feature, round(lo_{c},6) as low, round(hi_{c},6) as high from limits" for c in NAMES))
def feature_bounds(spark, sf_dir):
    train = features(spark, sf_dir).filter("role = 'train'")
    limits = models.column_bounds(train, NAMES, ["device"])
    names = F.array(*[F.lit(c) for c in NAMES])
    rows = limits.select("device", F.explode(F.arrays_zip(names.alias("n"), "feature_min", "feature_max")).alias("e"))
    return rounded(rows.select("device", F.col("e.n").alias("feature"), F.col("e.feature_min").alias("low"), F.col("e.feature_max").alias("high")))


@query("feature_clip", f"with {FEATURES_SQL}, {LIMITS} select unit_id, {', '.join(f'round(least(greatest({sql_name(c)},lo_{c}),hi_{c}),6) as {sql_name(c)}' for c in NAMES)} from features join limits using (device)")
def feature_clip(spark, sf_dir):
    rows = materialise(features(spark, sf_dir))
    limits = models.column_bounds(rows.filter("role = 'train'"), NAMES, ["device"])
    return rounded(models.clip_to_bounds(lookup_join(rows, limits, ["device"]), NAMES).select("unit_id", *NAMES))


PLAIN = ["mean", "std", "median", "energy"]
PLAIN_SQL = f"""{SCALED}, {STATS_SQL}, units as (select distinct unit_id, recording_id, label from signal),
plain as (select u.unit_id, role, cast(right(u.label,1) as int) as y, mean, std, median, energy from units u join stats using (unit_id)
  join split s on s.recording_id=u.recording_id and s.label=u.label)"""


def plain_features(spark, sf_dir):
    df, layout = scaled_series(spark, sf_dir)
    rows = materialise(units.unit_statistics(df, "x", layout.with_keys("unit_id", "recording_id", "label"), moments=False))
    roles = splits.stratified_split(rows, "recording_id", ["label"])
    out = materialise(rows.join(roles, ["recording_id", "label"]))
    return out.select("unit_id", "role", distance(F.col("label")).alias("y"), *PLAIN)


@query("standardize", f"""with {PLAIN_SQL}, s as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in PLAIN)} from plain where role='train')
select unit_id, {', '.join(f'round(({c}-m_{c})/s_{c},6) as {c}' for c in PLAIN)} from plain, s""")
def standardize(spark, sf_dir):
    rows = plain_features(spark, sf_dir)
    return rounded(models.standardize(rows.filter("role = 'train'"), rows, PLAIN).select("unit_id", *PLAIN))


@query("fit_dummy", f"""with {PLAIN_SQL}, b as (select y as pred from plain where role='train' group by y order by count(*) desc, y limit 1)
select unit_id, y, pred from plain, b where role='test'""")
def fit_dummy(spark, sf_dir):
    rows = plain_features(spark, sf_dir)
    best = models.majority_class(rows.filter("role = 'train'"), "y")
    return rows.filter("role = 'test'").select("unit_id", "y", F.lit(best).alias("pred"))


@query("fit_gaussian_nb", f"""with {PLAIN_SQL}, w as (select greatest({', '.join(f'var_pop({c})' for c in PLAIN)})*1e-9 as e from plain where role='train'),
c as (select y as k, count(*)/sum(count(*)) over () as prior, {', '.join(f'avg({c}) as m_{c}, var_pop({c}) as v_{c}' for c in PLAIN)} from plain where role='train' group by y),
s as (select unit_id, k, y, ln(prior) {' '.join(f'-0.5*ln(2*pi()*(v_{c}+e))-({c}-m_{c})**2/(2*(v_{c}+e))' for c in PLAIN)} as score from plain, c, w where role='test'),
r as (select *, row_number() over (partition by unit_id order by score desc, k) as place from s)
select unit_id, y, k as pred from r where place=1""")
def fit_gaussian_nb(spark, sf_dir):
    rows = plain_features(spark, sf_dir)
    model = models.fit_gaussian(rows.filter("role = 'train'"), PLAIN, "y")
    return model.predict(rows.filter("role = 'test'")).select("unit_id", "y", "pred")


KNN_SQL = """v as (select vec_id, label, embedding, row_number() over (order by md5(cast(vec_id as varchar)||':42'), vec_id) <= ceil(0.2::double*count(*) over ()) as is_test from embeddings),
d as (select a.vec_id as test_id, b.vec_id as train_id, b.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double-z[2]::double)**2))) as distance
  from v a join v b on a.is_test and not b.is_test),
n as (select *, row_number() over (partition by test_id order by distance, train_id) as rank from d)"""


def knn_sides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    roles = splits.group_shuffle_split(e, "vec_id", 0.2)
    rows = e.join(roles, "vec_id").withColumn("features", F.col("embedding").cast("array<double>"))
    train = rows.filter("role = 'train'").select(F.col("vec_id").alias("train_id"), "features", "label")
    return train, rows.filter("role = 'test'").select(F.col("vec_id").alias("test_id"), "features")


@query("knn_classify", f"""with {KNN_SQL}, c as (select test_id, label, count(*) as n from n where rank<=5 group by 1,2)
select test_id, arg_max(label, n*100-label) as pred from c group by 1""")
def knn_classify(spark, sf_dir):
    train, test = knn_sides(spark, sf_dir)
    return neighbours.classify(neighbours.nearest(train, test, 5))


@query("knn_neighbours", f"with {KNN_SQL} select test_id, train_id, cast(rank as int) as rank, round(distance,6) as distance from n where rank<=3")
def knn_neighbours(spark, sf_dir):
    train, test = knn_sides(spark, sf_dir)
    return rounded(neighbours.nearest(train, test, 3).select("test_id", "train_id", "rank", "distance"))


# --- fitted models (rows only) ------------------------------------------------------------


def unit_rows(spark, sf_dir, target=binary_class):
    layout = signal_layout(spark, sf_dir)
    return unit_models.unit_table(signal(spark, sf_dir, layout), layout, target)


def embedded_rows(spark, sf_dir, target=binary_class):
    """All units of all receivers in one embedding, with folds for the train side."""
    t = unit_rows(spark, sf_dir, target)
    emb = models.fit_embedding(t.side("train"), NAMES)
    ready = models.embed(t.features, emb).select(
        "unit_id", "recording_id", F.col("label").alias("label_name"), "role", "label_class", F.col("y").alias("label"), "features"
    )
    folds = splits.fold_table(ready, "recording_id", ["label_name"])
    rows = materialise(ready.join(folds, ["recording_id", "label_name"]))
    return packed(rows, rows.count()), emb


def fitted_query(make, target=binary_class):
    def run(spark, sf_dir):
        rows, _ = embedded_rows(spark, sf_dir, target)
        train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
        scored = make(metrics.with_class_weights(train, "label"), train.count(), test)
        return scored.select("unit_id", F.col("label_class").alias("y_true"), "y_pred", F.round("score", 6).alias("score"))

    return run


query("fit_logreg")(fitted_query(lambda train, n, test: models.predict(models.logistic(n, 1.0, "weight").fit(train), test)))
query("fit_random_forest")(fitted_query(lambda train, n, test: models.forest_predict(models.forest(300, 30, 2, weight="weight"), materialise(train), test)))
query("fit_svm_linear")(fitted_query(lambda train, n, test: models.predict(models.linear_svm(n, 1.0, "weight").fit(train), test)))
query("fit_svm_rbf")(fitted_query(lambda train, n, test: models.predict(unit_models.calibrated_machine(train, Candidate(1.0, "scale")), test)))
query("fit_svm_poly")(fitted_query(lambda train, n, test: models.predict(unit_models.calibrated_machine(train, Candidate(1.0, "scale", "poly")), test)))
query("fit_gbt")(fitted_query(lambda train, n, test: models.predict(models.boosting(4, 0.1, 200).fit(train), test)))


def grown_query(scored_by, target=distance):
    """Trees grown on the train units, and their classes and scores of the test units."""

    def run(spark, sf_dir):
        rows, _ = embedded_rows(spark, sf_dir, target)
        table = rows.select("unit_id", "role", "label_class", F.col("label").cast("int").alias("label"), vector_to_array("features").alias("features"))
        table = materialise(table)
        scored = scored_by(table.filter("role = 'train'"), table.filter("role = 'test'").select("unit_id", "label_class", "features"))
        return scored.select("unit_id", F.col("label_class").alias("y_true"), "y_pred", F.round("score", 6).alias("score"))

    return run


query("fit_trees_nobootstrap")(grown_query(lambda train, test: trees.with_choice(
    test.join(materialise(trees.extra_tree_scores(train, test, "unit_id", 4, 300, leaf=2)), "unit_id"))))
query("fit_boosting_multiclass")(grown_query(lambda train, test: trees.with_predictions(test, trees.fit_boosting(train, 4, 4, 0.1, 20, 3.0).scores)))


@query("pca_evr")
def pca_evr(spark, sf_dir):
    _, emb = embedded_rows(spark, sf_dir)
    return models.variance_table(spark, emb.variance).select("component", "evr")


@query("evr_cumulative")
def evr_cumulative(spark, sf_dir):
    _, emb = embedded_rows(spark, sf_dir)
    return models.variance_table(spark, emb.variance)


@query("pca_k95")
def pca_k95(spark, sf_dir):
    rows, emb = embedded_rows(spark, sf_dir)
    return rows.agg(F.count("*").alias("n_units")).withColumn("k_95", F.lit(emb.k_95))


@query("pca_importance")
def pca_importance(spark, sf_dir):
    from motefield.operators.reports import top

    _, emb = embedded_rows(spark, sf_dir)
    return top(models.component_importance(spark, emb, NAMES), "importance", 10, ["feature"])


@query("unit_embedding")
def unit_embedding(spark, sf_dir):
    rows, emb = embedded_rows(spark, sf_dir)
    return rows.select("unit_id", "role", F.lit(emb.k_95).alias("k_95"), vector_to_array("features").alias("embedding"))


TRAIN_UNITS = f"""units as (select distinct unit_id, recording_id, device, label from signal),
train as (select u.device, u.label, u.unit_id, cast(u.label <> 'label_00' as int) as y from units u join split s on s.recording_id=u.recording_id and s.label=u.label where role='train')"""
GRID_SQL = f"""with {SIGNAL}, {SPLIT}, {TRAIN_UNITS},
strata as (select device, label, count(*) as n from train group by all),
folds as (select device, least(5, max(n)) as folds from strata group by device),
sums as (select device, count(*) as n_rows, sum(y) as n_positive from train group by device)
select device, cast(c.i*5+g.i as int) as candidate, c.v as "C", g.v as gamma, cast(folds as bigint) as folds, n_rows, cast(n_positive as bigint) as n_positive
from folds join sums using (device), (values (0,'0.5'),(1,'1.0'),(2,'5.0'),(3,'10.0')) c(i,v), (values (0,'scale'),(1,'auto'),(2,'0.01'),(3,'0.1'),(4,'1.0')) g(i,v)"""


def searched(spark, sf_dir):
    tuned = unit_models.tune_devices(unit_rows(spark, sf_dir), DEVICES)
    named = [(i, str(c.cost), str(c.gamma)) for i, c in enumerate(unit_models.DEVICE_GRID)]
    return tuned.scores.join(spark.createDataFrame(named, "candidate int, C string, gamma string"), "candidate")


@query("grid_search")
def grid_search(spark, sf_dir):
    """Cross-validation score of all 20 candidates of every receiver."""
    return searched(spark, sf_dir).select("device", "candidate", "C", "gamma", F.round("cv_f1", 6).alias("cv_f1"), "n_rows")


@query("grid_search_sizes", GRID_SQL)
def grid_search_sizes(spark, sf_dir):
    """What can be said exactly of the same search: candidates, folds, scored rows, positive rows."""
    return searched(spark, sf_dir).select("device", "candidate", "C", "gamma", "folds", "n_rows", "n_positive")


RANKED = {
    "logistic": (0.1, 1.0, 10.0),
    "svm": kernel_svm.grid((0.5, 1.0, 5.0), ("scale", "auto"), ("linear", "rbf")),
}  # fmt: skip  # fixed values: costs, widths and kernels of the compared spaces


def fold_f1(scored, folds: str = "fold"):
    """Mean over the folds of the F1 of the positive class, for every model (``said``, ``label``)."""
    sums = scored.groupBy("model", "candidate", folds).agg(
        F.count_if(F.col("said") & (F.col("label") > 0)).alias("hits"), F.count_if("said").alias("said"), F.count_if(F.col("label") > 0).alias("real")
    )
    f1 = F.when(F.col("said") + F.col("real") > 0, 2 * F.col("hits") / (F.col("said") + F.col("real"))).otherwise(0.0)
    return sums.groupBy("model", "candidate").agg(F.avg(f1).alias("f1"))


def ranked_families(spark, sf_dir):
    """Scores of unseen rows by every candidate of the linear and the kernel family: by folds on the train side, and on the test side."""
    rows, _ = embedded_rows(spark, sf_dir)
    table = materialise(rows.select(
        F.lit("all").alias("key"), F.col("unit_id").cast("string").alias("row_id"), "role", "fold", "label", vector_to_array("features").alias("features")
    ))
    train = F.col("role") == "train"
    used = table.withColumn("uses", batched.fold_uses(5, "fold", train))
    width = len(table.select("features").first()[0])
    fits = [batched.Fit(c, s) for c in RANKED["logistic"] for s in range(6)]
    known = batched.split_statistics(used, 6, width)
    weights = batched.fit_logistic(used, fits, known, balanced=False)
    linear = batched.unseen_scores(used, fits, weights, known, ["row_id", "role", "fold", "label"]).select(
        F.lit("logistic").alias("model"), F.floor(F.col("fit") / 6).cast("int").alias("candidate"), (F.col("fit") % 6).alias("split"),
        "role", "fold", "label", (F.col("score") > 0.5).alias("said"),
    )
    linear = linear.where(((F.col("role") == "train") & (F.col("split") == F.col("fold"))) | ((F.col("role") == "test") & (F.col("split") == 5)))
    grid = RANKED["svm"]
    made = kernel_svm.fit_machines(table.where(train), "key", grid, [0, 1, 2, 3, 4])
    asked = table.withColumn("fold", F.when(train, F.col("fold")).otherwise(kernel_svm.ALL_ROWS))
    kernel = kernel_svm.fold_margins(asked.select("key", "role", "fold", "label", "features"), "key", made, grid)
    kernel = kernel.select("role", "fold", "label", F.posexplode("unseen").alias("candidate", "margin")).select(
        F.lit("svm").alias("model"), "candidate", "role", "fold", "label", (F.col("margin") > 0).alias("said")
    )
    return linear.drop("split").unionByName(kernel)


@query("model_ranking")
def model_ranking(spark, sf_dir):
    """Families by the cross-validation F1 of their best candidate, with its F1 on the test units."""
    scored = materialise(ranked_families(spark, sf_dir))
    cv = fold_f1(scored.where("role = 'train'")).withColumnRenamed("f1", "cv_score")
    test = fold_f1(scored.where("role = 'test'").withColumn("fold", F.lit(0))).withColumnRenamed("f1", "test_score")
    best = cv.groupBy("model").agg(F.max_by("candidate", F.struct("cv_score", -F.col("candidate"))).alias("candidate"), F.max("cv_score").alias("cv_score"))
    table = best.join(test, ["model", "candidate"])
    return rounded(table.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cv_score"), "model"))))


RANKING_SQL = f"""with {SIGNAL}, {SPLIT}, units as (select distinct unit_id, recording_id, device, label from signal),
u as (select role, cast(u.label <> 'label_00' as int) as y from units u join split s on s.recording_id=u.recording_id and s.label=u.label),
sizes as (select role, count(*) as n_rows, cast(sum(y) as bigint) as n_positive from u group by 1)
select model, cast(candidate as int) as candidate, role, n_rows, n_positive from sizes,
 (select 'logistic' as model, unnest(range(3)) as candidate union all select 'svm', unnest(range(12)))"""


@query("model_ranking_sizes", RANKING_SQL)
def model_ranking_sizes(spark, sf_dir):
    """The exact part of ``model_ranking``: every candidate is scored once on every unit, by a model that has not seen it."""
    return ranked_families(spark, sf_dir).groupBy("model", "candidate", "role").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("label") > 0).alias("n_positive")
    )


def trained(spark, sf_dir):
    """All units, and the tuned and calibrated machine of every receiver."""
    t = unit_rows(spark, sf_dir)
    return t, unit_models.tune_devices(t, DEVICES).artifacts


@query("per_device_models")
def per_device_models(spark, sf_dir):
    t, found = trained(spark, sf_dir)
    scored = unit_models.score_units(t.side("test"), found)
    return scored.select("unit_id", "device", F.col("label_class").alias("y_true"), "y_pred", F.round("score", 6).alias("score"))


@query("device_vote_metrics")
def device_vote_metrics(spark, sf_dir):
    """Test units by the tuned models of their receivers, voted per recording in two levels, and the report on the votes."""
    t, found = trained(spark, sf_dir)
    voted = unit_models.group_votes(unit_models.score_units(t.side("test"), found), DEVICES)
    return rounded(metrics.classification_report(materialise(voted), [0, 1]))


@query("device_vote_supports", f"""with {SIGNAL}, {SPLIT}, test as (select recording_id, min(cast(label <> 'label_00' as int)) as y from split where role='test' group by 1)
select cast(y as varchar) as name, count(*) as support from test group by y""")
def device_vote_supports(spark, sf_dir):
    """The exact part of ``device_vote_metrics``: how many voted recordings have each class."""
    t, found = trained(spark, sf_dir)
    voted = unit_models.group_votes(unit_models.score_units(t.side("test"), found), DEVICES)
    return voted.groupBy(F.col("y_true").cast("string").alias("name")).agg(F.count("*").alias("support"))


def squares_of_shares(names: list[str]) -> str:
    """Sum of squared correlations over the square of their number: what squared shares of variance add up to."""
    q = [sql_name(c) for c in names]
    own = "+".join(f"case when stddev_pop({c})>1e-12 then 1 else 0 end" for c in q)
    pairs = "+".join(f"coalesce(case when stddev_pop({a})>1e-12 and stddev_pop({b})>1e-12 then (covar_pop({a},{b})/stddev_pop({a})/stddev_pop({b}))**2 end,0)" for i, a in enumerate(q) for b in q[:i])
    return f"(({own})+2*({pairs}))/(({own})::double*({own}))"


def component_sizes(t):
    sizes = t.features.groupBy("device").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )
    return sizes.join(unit_models.receiver_components(t), "device")


@query("pca_summary")
def pca_summary(spark, sf_dir):
    return component_sizes(unit_rows(spark, sf_dir)).select("device", "n_train", "n_test", "k_95")


@query("pca_shares", f"""with {FEATURES_SQL}, sizes as (select device, count(*) filter (role='train') as n_train, count(*) filter (role='test') as n_test from features group by device),
shares as (select device, {squares_of_shares(NAMES)} as squares from features where role='train' group by device)
select device, n_train, n_test, 1.0::double as share_sum, round(squares, 6) as share_squares from sizes join shares using (device)""")
def pca_shares(spark, sf_dir):
    """What can be said exactly of the components of every receiver: their shares add up to 1, the squares to those of the correlations."""
    add = lambda f: F.aggregate("evr", F.lit(0.0), f)
    rows = component_sizes(unit_rows(spark, sf_dir))
    return rounded(rows.select("device", "n_train", "n_test", add(lambda a, v: a + v).alias("share_sum"), add(lambda a, v: a + v * v).alias("share_squares")))


def saved(spark, sf_dir):
    t, found = trained(spark, sf_dir)
    root = new_table_path(spark, "artifacts")
    for artifact in found.values():
        artifacts.save_artifact(spark, root, artifact)
    return t, root


@query("artifact_bundle")
def artifact_bundle(spark, sf_dir):
    _, root = saved(spark, sf_dir)
    return artifacts.load_bundles(spark, root)


@query("artifact_bounds", f"with {FEATURES_SQL}, {LIMITS} " + " union all ".join(
    f"select device as esp_id, '{c}' as feature, round(lo_{c},6) as low, round(hi_{c},6) as high, 5 as median_width from limits" for c in NAMES))
def artifact_bounds(spark, sf_dir):
    """The exact part of the bundles: feature bounds as they are read back."""
    rows = artifact_bundle(spark, sf_dir)
    each = rows.select("esp_id", "median_width", F.explode(F.arrays_zip("feature_cols", "feature_min", "feature_max")).alias("e"))
    return rounded(each.select("esp_id", F.col("e.feature_cols").alias("feature"), F.col("e.feature_min").alias("low"), F.col("e.feature_max").alias("high"), "median_width"))


@query("bundle_roundtrip")
def bundle_roundtrip(spark, sf_dir):
    """Predictions of the loaded models on all units."""
    t, root = saved(spark, sf_dir)
    loaded = {d: artifacts.load_artifact(spark, root, d) for d in DEVICES}
    return unit_models.score_units(t.features, loaded).select("unit_id", "device", "y_pred", "k_95")


@query("inference_report")
def inference_report(spark, sf_dir):
    t, found = trained(spark, sf_dir)
    return unit_models.json_records(unit_models.inference_report(unit_models.score_units(t.features, found)))


@query("inference_units", f"with {SIGNAL} select cast(unit_id as varchar) as data_file, count(*) as n_packets, 'svm' as model_type from signal group by unit_id")
def inference_units(spark, sf_dir):
    """The exact part of the records of ``inference_report``."""
    t, found = trained(spark, sf_dir)
    return unit_models.inference_report(unit_models.score_units(t.features, found)).select("data_file", "n_packets", "model_type")


@query("batch_inference")
def batch_inference(spark, sf_dir):
    """Raw log lines to one prediction or failure per recording."""
    logs = lines(spark, sf_dir)
    signals, rejected = log_inference.unit_signals(log_inference.log_packets(logs))
    signals = materialise(signals)
    t = unit_models.unit_table(signals, measure(signals, ["unit_id"]), binary_class)
    found = unit_models.tune_devices(t, DEVICES).artifacts
    scored = unit_models.score_units(t.features, found)
    return log_inference.recording_votes(scored, rejected, logs, DEVICES)


def window_packets(spark, sf_dir):
    return materialise(recordings.binary_windows(packets(spark, sf_dir), packet_layout(spark, sf_dir), DEVICES, WIDTH, STEP))


@query("importance_mass")
def importance_mass(spark, sf_dir):
    return robustness.importance_mass(window_packets(spark, sf_dir), WIDTH, DEVICES)


@query("robustness_grid")
def robustness_grid(spark, sf_dir):
    return robustness.robustness_grid(window_packets(spark, sf_dir), WIDTH, DEVICES)


SIZES_SQL = f"""with {SEGMENTS}, windows as (select distinct recording_id, segment, 'id_person_0'||(1+(recording_id//4)%4) as person_id, cast(recording_id%4>0 as int) as y from seg),
{sql_split('windows', 'recording_id', None, 'rs', '0.3')}, {sql_split('windows', 'person_id', None, 'ps', '0.3')},
sides as (select 'recording_id' as split, role='train' as used, y from windows join rs using (recording_id)
  union all select 'person_id', role='train', y from windows join ps using (person_id)
  union all select 'without '||p.person_id, w.person_id<>p.person_id, y from windows w, (select distinct person_id from windows) p),
sizes as (select split, count(*) filter (used) as n_train, count(*) filter (not used) as n_test, count(*) filter (not used and y=0) as support_no_motion,
  count(*) filter (not used and y=1) as support_motion, count(distinct y) filter (used) as classes from sides group by split)
select 'smooth_raw_scale' as config, split, subset as feature_subset, n_train, n_test, support_no_motion, support_motion
from sizes, (select unnest(['all_selected','without_dev3','dev1_only','dev2_only','dev3_only','global_only','pairs_only']) as subset)
where classes=2 and n_test>0 and (subset='all_selected' or split not like 'without%')"""


@query("robustness_sizes", SIZES_SQL)
def robustness_sizes(spark, sf_dir):
    """The exact part of ``robustness_grid``, for its first setting."""
    name, config = next(iter(robustness.CONFIGS.items()))
    rows = robustness.robustness_grid(window_packets(spark, sf_dir), WIDTH, DEVICES, {name: config})
    return rows.select("config", "split", "feature_subset", "n_train", "n_test", "support_no_motion", "support_motion")


@query("inference_report_multiclass")
def inference_report_multiclass(spark, sf_dir):
    """JSON record per test unit with the probability of every class by name."""
    rows, _ = embedded_rows(spark, sf_dir, distance)
    train = metrics.with_class_weights(rows.filter("role = 'train'"), "label")
    scored = models.forest_predict(models.forest(300, 30, 2, weight="weight"), materialise(train), rows.filter("role = 'test'"))
    return unit_models.json_records(unit_models.multiclass_report(scored, {i: f"label_0{i}" for i in range(4)}))
