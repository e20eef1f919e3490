"""Queries on splits, samples, votes and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from motefield.catalog.common import r6, rounded, sql_split
from motefield.catalog.registry import query
from motefield.catalog.unit_queries import FILTERED, filtered, train_side
from motefield.catalog.views import DEVICES, PREDS, SIGNAL, VOTES, preds, signal, unit_names, votes, table
from motefield.operators import metrics, reports, sampling, splits
from motefield.operators import votes as voting

LABELS = ["label_00", "label_01", "label_02", "label_03"]
CLASSES = [0, 1, 2, 3]


def units_of(spark, sf_dir):
    """One row per unit; only the user column is read."""
    return unit_names(table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id")).distinct())


UNITS = SIGNAL + ", units as (select distinct unit_id, recording_id, device, label, person_id from signal)"
RECS = UNITS + ", recs as (select distinct recording_id, label, cast(label<>'label_00' as int) as binary_label from units)"


# --- splits -------------------------------------------------------------------------------


@query("split_stratified", f"with {UNITS}, {sql_split('units', 'recording_id', 'label', 's')} select recording_id, label, role from s")
def split_stratified(spark, sf_dir):
    return splits.stratified_split(units_of(spark, sf_dir), "recording_id", ["label"])


@query("split_per_device", f"with {UNITS}, {sql_split('units', 'recording_id', 'label, device', 's')} select recording_id, label, device, role from s")
def split_per_device(spark, sf_dir):
    return splits.stratified_split(units_of(spark, sf_dir), "recording_id", ["label", "device"])


@query("split_group_shuffle", f"with {UNITS}, {sql_split('units', 'recording_id', None, 's', '0.3')} select recording_id, role from s")
def split_group_shuffle(spark, sf_dir):
    return splits.group_shuffle_split(units_of(spark, sf_dir), "recording_id")


@query("split_apply", f"with {UNITS}, {sql_split('units', 'recording_id', 'label', 's')} select unit_id, recording_id, label, role from units join s using (recording_id, label)")
def split_apply(spark, sf_dir):
    u = units_of(spark, sf_dir)
    roles = splits.stratified_split(u, "recording_id", ["label"])
    return u.join(roles, ["recording_id", "label"]).select("unit_id", "recording_id", "label", "role")


@query("split_leakage", f"""with {UNITS}, {sql_split('units', 'recording_id', 'label', 's')},
j as (select u.*, role from units u join s using (recording_id, label))
select (select count(*) from (select recording_id from j where role='train' intersect select recording_id from j where role='test')) as leaking_recordings,
       (select count(*) from (select person_id from j where role='train' intersect select person_id from j where role='test')) as leaking_persons""")
def split_leakage(spark, sf_dir):
    u = units_of(spark, sf_dir)
    rows = u.join(splits.stratified_split(u, "recording_id", ["label"]), ["recording_id", "label"])
    train, test = rows.filter("role='train'"), rows.filter("role='test'")
    both = splits.leaking_groups(train, test, "recording_id").select(F.lit("r").alias("kind")).unionByName(
        splits.leaking_groups(train, test, "person_id").select(F.lit("p").alias("kind"))
    )
    return both.agg(
        F.count_if(F.col("kind") == "r").alias("leaking_recordings"), F.count_if(F.col("kind") == "p").alias("leaking_persons")
    )


def sql_folds(group: str, strata: str, src: str) -> str:
    return f"""select {group}, {strata}, cast((row_number() over (partition by {strata} order by md5(cast({group} as varchar)||':42'), {group})-1)%5 as int) as fold
from (select distinct {group}, {strata} from {src})"""


@query("folds_grouped", f"with {UNITS} {sql_folds('recording_id', 'label', 'units')}")
def folds_grouped(spark, sf_dir):
    return splits.fold_table(units_of(spark, sf_dir), "recording_id", ["label"])


@query("folds_units", f"with {UNITS} {sql_folds('unit_id', 'label', 'units')}")
def folds_units(spark, sf_dir):
    return splits.fold_table(units_of(spark, sf_dir), "unit_id", ["label"])


@query("split_lopo", f"with {UNITS} select person_id as held_out, (select count(*) from units)-count(*) as n_train, count(*) as n_test from units group by person_id")
def split_lopo(spark, sf_dir):
    return splits.leave_one_out_sizes(units_of(spark, sf_dir), "person_id")


@query("group_labels", f"with {UNITS} select distinct recording_id, label from units")
def group_labels(spark, sf_dir):
    return units_of(spark, sf_dir).select("recording_id", "label").distinct()


@query("features_union", f"""with {FILTERED}, {sql_split('signal', 'recording_id', 'label', 'split')}
select unit_id, role, round(avg(x),6) as mean from filtered join split using (recording_id, label) group by 1,2""")
def features_union(spark, sf_dir):
    f = filtered(spark, sf_dir)
    roles = splits.stratified_split(f, "recording_id", ["label"])
    sides = [
        f.join(roles.filter(F.col("role") == side), ["recording_id", "label"]).groupBy("unit_id", "role").agg(F.avg("x").alias("mean"))
        for side in ("train", "test")
    ]
    return rounded(sides[0].unionByName(sides[1]))


# --- samples ------------------------------------------------------------------------------


def recordings_of(spark, sf_dir):
    u = units_of(spark, sf_dir).select("recording_id", "label").distinct()
    return u.withColumn("binary_label", (F.col("label") != "label_00").cast("int"))


@query("round_robin_sample", f"""with {RECS},
r as (select *, row_number() over (partition by label order by md5(recording_id||':42'), recording_id) as rank from recs),
p as (select *, row_number() over (order by rank, label) as turn from r) select recording_id, label, turn from p where turn<=20""")
def round_robin_sample(spark, sf_dir):
    out = sampling.round_robin_sample(recordings_of(spark, sf_dir), "recording_id", "label", 20)
    return out.select("recording_id", "label", F.col("turn").cast("long").alias("turn"))


@query("balanced_sample", f"""with {RECS},
r as (select *, row_number() over (partition by binary_label, label order by md5(recording_id||':'||(42+binary_label)), recording_id) as rank from recs),
p as (select *, row_number() over (partition by binary_label order by rank, label) as turn from r)
select recording_id, label, binary_label from p where turn <= (select min(n) from (select count(*) as n from recs group by binary_label))""")
def balanced_sample(spark, sf_dir):
    out = sampling.balanced_sample(recordings_of(spark, sf_dir), "recording_id", "binary_label", "label")
    return out.select("recording_id", "label", "binary_label")


# --- votes --------------------------------------------------------------------------------


BIN = VOTES + ", files as (select *, cast(pred_class>0 as int) as pred from votes)"


def binary_files(spark, sf_dir):
    return votes(spark, sf_dir).withColumn("pred", (F.col("pred_class") > 0).cast("int"))


@query("vote_three", f"""with {BIN}, last as (select group_id, device, arg_max(pred, file_id) as pred from files group by 1,2)
select group_id, cast(sum(pred) as bigint) as ones, cast(sum(pred)>=2 as int) as pred from last group by 1 having count(*)=3""")
def vote_three(spark, sf_dir):
    last = binary_files(spark, sf_dir).groupBy("group_id", "device").agg(F.max_by("pred", "file_id").alias("pred"))
    return voting.vote_of_three(last, "group_id")


DEV_SQL = "d as (select group_id, device, cast(sum(pred)*2>=count(*) as int) as pred, count(*) as n_files from files group by 1,2)"
GROUP_SQL = """select group_id, cast(sum(pred)*2>=count(*) as int) as pred, count(*) as n_devices, cast(sum(n_files) as bigint) as n_files,
  max(case when device='dev1' then pred end) as pred_dev1, max(case when device='dev2' then pred end) as pred_dev2,
  max(case when device='dev3' then pred end) as pred_dev3 from d group by 1"""


@query("vote_binary", f"with {BIN}, {DEV_SQL} {GROUP_SQL}")
def vote_binary(spark, sf_dir):
    return voting.vote_binary(binary_files(spark, sf_dir), "group_id", DEVICES)


@query("vote_binary_complete", f"with {BIN}, {DEV_SQL} {GROUP_SQL} having count(*)=3")
def vote_binary_complete(spark, sf_dir):
    return voting.vote_binary(binary_files(spark, sf_dir), "group_id", DEVICES, complete=True)


@query("vote_summary", f"""with {BIN}, {DEV_SQL}, g as ({GROUP_SQL} having count(*)=3)
select (select count(*) from g) as n_groups, (select count(distinct device) from files) as n_models, (select count(*) from files) as n_files""")
def vote_summary(spark, sf_dir):
    files = binary_files(spark, sf_dir)
    return voting.vote_summary(voting.vote_binary(files, "group_id", DEVICES, complete=True), files)


MC = """c as (select group_id, pred_class, count(*) as n from votes group by 1,2)
select group_id, arg_max(pred_class, n*10-pred_class) as pred, string_agg(pred_class||':'||n, ',' order by pred_class) as vote_counts,
  cast(sum(n) as bigint) as n_votes from c group by 1"""


@query("vote_multiclass", f"with {VOTES}, {MC}")
def vote_multiclass(spark, sf_dir):
    out = voting.vote_multiclass(votes(spark, sf_dir), "group_id", "pred_class")
    return out.withColumn("vote_counts", voting.counts_text(F.col("vote_counts")))


@query("vote_multiclass_two_level", f"""with {VOTES},
c1 as (select group_id, device, pred_class, count(*) as n from votes group by 1,2,3),
d as (select group_id, device, arg_max(pred_class, n*10-pred_class) as pred_class from c1 group by 1,2),
full_groups as (select group_id from d group by 1 having count(*)=3),
c as (select group_id, pred_class, count(*) as n from d join full_groups using (group_id) group by 1,2)
select group_id, arg_max(pred_class, n*10-pred_class) as pred, string_agg(pred_class||':'||n, ',' order by pred_class) as vote_counts,
  cast(sum(n) as bigint) as n_votes from c group by 1""")
def vote_two_level(spark, sf_dir):
    out = voting.vote_multiclass_two_level(votes(spark, sf_dir), "group_id", DEVICES, "pred_class")
    return out.withColumn("vote_counts", voting.counts_text(F.col("vote_counts")))


@query("vote_mixed_truth", f"with {VOTES} select device, count(distinct true_class) as n_true from votes group by 1 having count(distinct true_class)>1")
def vote_mixed_truth(spark, sf_dir):
    return voting.mixed_truth(votes(spark, sf_dir), "device", "true_class")


@query("vote_errors", f"""with {VOTES}, {MC.split('select group_id, arg_max')[0].strip()},
v as (select group_id, arg_max(pred_class, n*10-pred_class) as y_pred from c group by 1)
select group_id, cast(group_id%4 as int) as y_true, y_pred from v where y_pred<>group_id%4""")
def vote_errors(spark, sf_dir):
    f = votes(spark, sf_dir)
    truth = f.groupBy("group_id").agg(F.first("true_class").alias("y_true"))
    voted = voting.vote_multiclass(f, "group_id", "pred_class").select("group_id", F.col("pred").alias("y_pred"))
    return metrics.errors(voted.join(truth, "group_id")).select("group_id", "y_true", "y_pred")


# --- metrics ------------------------------------------------------------------------------


@query("metrics_basic", f"""with {PREDS} select avg(cast(y_true=y_pred as int)) as accuracy,
 round((avg(cast(y_pred=0 as int)) filter (where y_true=0)+avg(cast(y_pred=1 as int)) filter (where y_true=1))/2,6) as balanced_accuracy, count(*) as n from preds""".replace(
     "avg(cast(y_true=y_pred as int)) as", "round(avg(cast(y_true=y_pred as int)),6) as"))
def metrics_basic(spark, sf_dir):
    return rounded(metrics.basic(preds(spark, sf_dir), [0, 1]))


def sql_per_class(src: str, labels: list[int], true: str = "y_true", pred: str = "y_pred") -> str:
    rows = " union all ".join(
        f"select {c} as class, count(*) filter (where {true}={c} and {pred}={c}) as tp, count(*) filter (where {pred}={c}) as pp, "
        f"count(*) filter (where {true}={c}) as support from {src}"
        for c in labels
    )
    return f"""counts as ({rows}),
per_class as (select class, coalesce(tp/nullif(pp,0),0)::double as precision, coalesce(tp/nullif(support,0),0)::double as recall,
  coalesce(2*tp/nullif(pp+support,0),0)::double as f1, support from counts)"""


MULTI = VOTES + ", {}".format(sql_per_class("votes", CLASSES, "true_class", "pred_class"))


@query("metrics_per_class", f"with {MULTI} select class, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, support from per_class")
def metrics_per_class(spark, sf_dir):
    return rounded(metrics.per_class(votes(spark, sf_dir), CLASSES, "true_class", "pred_class"))


@query("classification_report", f"""with {MULTI}
select cast(class as varchar) as name, round(precision,6) as precision, round(recall,6) as recall, round(f1,6) as f1, support from per_class
union all select 'macro avg', round(avg(precision),6), round(avg(recall),6), round(avg(f1),6), cast(sum(support) as bigint) from per_class
union all select 'weighted avg', round(sum(precision*support)/sum(support),6), round(sum(recall*support)/sum(support),6), round(sum(f1*support)/sum(support),6),
  cast(sum(support) as bigint) from per_class""")
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(votes(spark, sf_dir), CLASSES, "true_class", "pred_class"))


@query("confusion_matrix", f"""with {VOTES}, t as (select unnest([0,1,2,3]) as y_true)
select cast(t.y_true as int) as y_true, {', '.join(f'count(*) filter (where pred_class={c}) as pred_{c}' for c in CLASSES)}
from t left join votes v on v.true_class=t.y_true group by 1""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(votes(spark, sf_dir), CLASSES, "true_class", "pred_class")


AUC_SQL = """(select case when count(distinct y)=2 then (sum(case when y=1 then r end)-sum(y)*(sum(y)+1)/2.0::double)/(sum(y)*(count(*)-sum(y)))::double end
  from (select y, rank() over (order by score)+(count(*) over (partition by score)-1)/2.0::double as r from {src}))"""


@query("roc_auc", f"with {PREDS}, s as (select y_true as y, score from preds) select round({AUC_SQL.format(src='s')},6) as roc_auc")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(preds(spark, sf_dir), "y_true", "score"))


def class_scores(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        (F.floor(F.col("vec_id") / 4) % 4).cast("int").alias("y"),
        F.transform(F.array(*[v[i] for i in CLASSES]), lambda x: F.round(x.cast("double"), 1)).alias("scores"),
    )


@query("roc_auc_ovr", "with " + ", ".join(
    f"s{c} as (select cast(cast(floor(vec_id/4) as int)%4={c} as int) as y, round(embedding[{c + 1}]::double, 1) as score from embeddings)" for c in CLASSES)
    + " select round((" + "+".join(AUC_SQL.format(src=f"s{c}") for c in CLASSES) + ")/4,6) as roc_auc_ovr")
def roc_auc_ovr(spark, sf_dir):
    return rounded(metrics.roc_auc_ovr(class_scores(spark, sf_dir), "y", "scores", CLASSES))


@query("roc_curve", f"""with {PREDS}, c as (select score, sum(y_true) as pos, count(*)-sum(y_true) as neg from preds group by 1)
select round(score,6) as threshold, round(sum(neg) over w/sum(neg) over (),6) as fpr, round(sum(pos) over w/sum(pos) over (),6) as tpr
from c window w as (order by score desc rows unbounded preceding)""")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(preds(spark, sf_dir), "y_true", "score"))


@query("evaluate_model", f"""with {PREDS}, {sql_per_class('preds', [0, 1])}, s as (select y_true as y, score from preds)
select 'rule' as model, (select round(avg(cast(y_true=y_pred as int)),6) from preds) as accuracy, round(avg(recall),6) as balanced_accuracy,
 {', '.join(f"round(max(case when class={c} then {m} end),6) as {m}_{n}" for c, n in ((0, 'no_motion'), (1, 'motion')) for m in ('precision', 'recall', 'f1'))},
 max(case when class=0 then support end) as support_no_motion, max(case when class=1 then support end) as support_motion,
 round({AUC_SQL.format(src='s')},6) as roc_auc from per_class""")
def evaluate_model(spark, sf_dir):
    return rounded(metrics.evaluate(preds(spark, sf_dir), "rule"))


@query("file_predictions", f"with {PREDS} select unit_id, y_true, y_pred, cast(y_true=y_pred as int) as hit from preds")
def file_predictions(spark, sf_dir):
    p = preds(spark, sf_dir)
    both = metrics.paired_predictions(p.select("unit_id", "y_pred"), p.select("unit_id", "y_true"), "unit_id")
    return both.select("unit_id", "y_true", "y_pred", (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit"))


@query("score_fallbacks", f"""with {PREDS} select unit_id, round(1/(1+exp(-score)),6) as p_logistic,
 round((score-min(score) over ())/(max(score) over ()-min(score) over ()+1e-8),6) as p_minmax from preds""")
def score_fallbacks(spark, sf_dir):
    out = metrics.minmax_score(preds(spark, sf_dir), "score", "p_minmax")
    return out.select("unit_id", r6(metrics.logistic_score(F.col("score")), "p_logistic"), r6("p_minmax"))


@query("class_weights", f"with {UNITS}, c as (select label, count(*) as n from units group by 1) select label, n, round(sum(n) over ()/(count(*) over ()*n),6) as weight from c")
def class_weights(spark, sf_dir):
    return rounded(metrics.class_weights(units_of(spark, sf_dir), "label"))


# --- reports ------------------------------------------------------------------------------


@query("crosstab_person_label", f"with {UNITS} select person_id, {', '.join(f'''count(*) filter (where label='{v}') as {v}''' for v in LABELS)} from units group by 1")
def crosstab(spark, sf_dir):
    return reports.crosstab(units_of(spark, sf_dir), "person_id", "label", LABELS)


@query("class_balance", f"with {UNITS} select label, count(*) as n, count(distinct recording_id) as n_groups from units group by 1")
def class_balance(spark, sf_dir):
    return reports.value_counts(units_of(spark, sf_dir), "label", "recording_id")


@query("diagnostic_pivot", f"""with {SIGNAL} select device, {', '.join(f'''round(avg(x) filter (where label='{v}'),6) as {v}''' for v in LABELS)} from signal group by 1""")
def diagnostic_pivot(spark, sf_dir):
    rows = unit_names(table(spark, sf_dir, "events").select(F.col("user_id").alias("unit_id"), F.col("value").alias("x")))
    return rounded(reports.pivot_mean(rows, ["device"], "label", LABELS, "x"))


@query("observed_labels", """with l as (select 'label_0'||(cast(floor(floor(vec_id/3)/20) as int)%4) as label from embeddings union select 'label_0'||label from embeddings)
select label, cast(row_number() over (order by label)-1 as int) as label_class from l""")
def observed_labels(spark, sf_dir):
    """Labels of the recordings and labels that results use, together."""
    from motefield.catalog.views import packets

    used = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label_0"), F.col("label").cast("string")))
    return reports.observed_labels(packets(spark, sf_dir).select("label"), used)
