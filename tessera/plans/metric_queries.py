"""Metrics, losses and NaN-aware statistics over scored documents, with their SQL. Documents without a label have no target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import metrics, nanstats
from tessera.plans.registry import query

PREDS = """preds AS (SELECT d.doc_id AS row_id, t.task, CAST((d.n_chars % 97) AS DOUBLE) / 97 AS pred, CAST(CASE t.task WHEN 'quality' THEN l.quality ELSE l.toxic END AS DOUBLE) AS target
    FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES ('quality'), ('toxic')) t(task)), ok AS (SELECT * FROM preds WHERE target IS NOT NULL)"""
VALUES = """vals AS (SELECT l_returnflag AS k, CASE WHEN l_orderkey % 7 = 0 THEN 'NaN'::DOUBLE ELSE l_quantity END AS x FROM lineitem)"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select(F.col("doc_id"), ((F.col("n_chars") % 97).cast("double") / 97).alias("pred")).join(labels, "doc_id", "left")
    tasks = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("double").alias("target")) for t in ("quality", "toxic")]))
    return rows.select(F.col("doc_id").alias("row_id"), "pred", tasks.alias("x")).select("row_id", "x.task", "pred", "x.target")


def _r(df: DataFrame, *skip: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double" and c not in skip})


def _values(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), F.when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"))


@query(f"WITH {VALUES}, v AS (SELECT k, nullif(x, 'NaN'::DOUBLE) AS x FROM vals) SELECT k, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(var_pop(x), 6) AS var0, quantile_disc(x, 0.5) AS median FROM v GROUP BY k")
def nan_mean_std_median(spark, d):
    x = F.col("x")
    return _r(_values(spark, d).groupBy("k").agg(nanstats.nan_count(x).alias("n"), nanstats.nan_mean(x).alias("mean"), nanstats.nan_std(x).alias("std"), nanstats.nan_var(x, False).alias("var0"), nanstats.nan_median("x").alias("median")))


@query(f"WITH {VALUES}, v AS (SELECT k, nullif(x, 'NaN'::DOUBLE) AS x FROM vals), m AS (SELECT k, quantile_disc(x, 0.5) AS m FROM v GROUP BY k) SELECT k, round(1.4826::DOUBLE * quantile_disc(abs(x - m), 0.5), 6) AS mad FROM v JOIN m USING (k) GROUP BY k")
def nan_mad(spark, d):
    v = _values(spark, d)
    middle = v.groupBy("k").agg(nanstats.nan_median("x").alias("m"))
    return _r(v.join(middle, "k").withColumn("a", F.abs(F.col("x") - F.col("m"))).groupBy("k").agg((1.4826 * nanstats.nan_median("a")).alias("mad")))


@query(f"WITH {PREDS} SELECT task, round(avg(abs(pred - target)), 6) AS mae, round(avg(pow(pred - target, 2)), 6) AS mse, round(sqrt(avg(pow(pred - target, 2))), 6) AS rmse FROM ok GROUP BY task")
def mae_mse_rmse(spark, d):
    m = metrics.regression()
    return _r(metrics.present(predictions(spark, d)).groupBy("task").agg(*[m[k].alias(k) for k in ("mae", "mse", "rmse")]))


@query(f"WITH {PREDS}, p AS (SELECT task, pred, target + 1 AS target FROM ok) SELECT task, round(avg(abs(pred - target) / greatest(abs(target), 1.17e-6)), 6) AS mape, round(avg(pow(ln(1 + pred) - ln(1 + target), 2)), 6) AS msle, round(sum(pred * target) / (sqrt(sum(pred * pred)) * sqrt(sum(target * target))), 6) AS cosine FROM p GROUP BY task")
def mape_msle_cosine(spark, d):
    m = metrics.regression()
    return _r(metrics.present(predictions(spark, d)).withColumn("target", F.col("target") + 1).groupBy("task").agg(*[m[k].alias(k) for k in ("mape", "msle", "cosine")]))


@query(f"WITH {PREDS} SELECT task, round(corr(pred, target), 6) AS pearsonr, round(1 - sum(pow(target - pred, 2)) / (var_pop(target) * count(*)), 5) AS r2 FROM ok GROUP BY task")
def pearson_r2(spark, d):
    m = metrics.regression()
    out = metrics.present(predictions(spark, d)).groupBy("task").agg(m["pearsonr"].alias("pearsonr"), m["r2"].alias("r2"))
    return out.select("task", F.round("pearsonr", 6).alias("pearsonr"), F.round("r2", 5).alias("r2"))


@query(f"WITH {PREDS}, r AS (SELECT task, CAST(row_number() OVER (PARTITION BY task ORDER BY pred, row_id) AS DOUBLE) AS a, CAST(row_number() OVER (PARTITION BY task ORDER BY target, row_id) AS DOUBLE) AS b FROM ok) SELECT task, round(corr(a, b), 6) AS spearman FROM r GROUP BY task")
def spearman_ordinal(spark, d):
    return _r(metrics.spearman(metrics.present(predictions(spark, d)), "task", average=False))


@query(f"WITH {PREDS}, r AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY pred) + (count(*) OVER (PARTITION BY task, pred) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY task ORDER BY target) + (count(*) OVER (PARTITION BY task, target) - 1) / 2.0::DOUBLE AS b FROM ok) SELECT task, round(corr(a, b), 6) AS spearman FROM r GROUP BY task")
def spearman_avg_rank(spark, d):
    return _r(metrics.spearman(metrics.present(predictions(spark, d)), "task"))


_COUNTS = "count(*) FILTER (pred >= 0.5 AND target = 1) AS tp, count(*) FILTER (pred >= 0.5 AND target <> 1) AS fp, count(*) FILTER (pred < 0.5 AND target <> 1) AS tn, count(*) FILTER (pred < 0.5 AND target = 1) AS fn"


@query(f"WITH {PREDS} SELECT task, {_COUNTS} FROM ok GROUP BY task")
def confusion_counts(spark, d):
    return metrics.present(predictions(spark, d)).groupBy("task").agg(*[c.alias(k) for k, c in metrics.counts().items()])


@query(f"""WITH {PREDS}, c AS (SELECT task, {_COUNTS} FROM ok GROUP BY task) SELECT task, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
    round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0), 6) AS fbeta, round(coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""")
def accuracy_precision_recall_fbeta_mcc(spark, d):
    counted = metrics.present(predictions(spark, d)).groupBy("task").agg(*[c.alias(k) for k, c in metrics.counts().items()])
    return _r(metrics.classification(counted, beta=2.0).drop("tp", "fp", "tn", "fn"))


@query(f"WITH {PREDS}, r AS (SELECT task, target, rank() OVER (PARTITION BY task ORDER BY pred) + (count(*) OVER (PARTITION BY task, pred) - 1) / 2.0::DOUBLE AS a FROM ok) SELECT task, round((sum(a * target) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target))), 6) AS auroc FROM r GROUP BY task")
def auroc(spark, d):
    return _r(metrics.auroc(metrics.present(predictions(spark, d)), "task"))


_SCORES = "s AS (SELECT task, pred, count(*) AS n, sum(target) AS pos FROM ok GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY task ORDER BY pred DESC) AS seen, sum(pos) OVER (PARTITION BY task ORDER BY pred DESC) AS tp, sum(pos) OVER (PARTITION BY task) AS pos_all FROM s)"


@query(f"WITH {PREDS}, {_SCORES} SELECT task, round(sum(pos * tp / seen) / max(pos_all), 6) AS ap FROM w GROUP BY task")
def average_precision(spark, d):
    return _r(metrics.average_precision(metrics.present(predictions(spark, d)), "task"))


@query(f"WITH {PREDS}, {_SCORES} SELECT task, round(pred, 6) AS threshold, round(tp / seen, 6) AS precision, round(tp / pos_all, 6) AS recall FROM w")
def pr_curve(spark, d):
    return _r(metrics.pr_curve(metrics.present(predictions(spark, d)), "task"))


@query(f"WITH {PREDS}, c AS (SELECT task, target AS t, pred, least(greatest(pred, 1e-7), 1 - 1e-7) AS p FROM ok) SELECT task, round(avg(-(t * ln(p) + (1 - t) * ln(1 - p))), 6) AS bce, round(avg(greatest(pred, 0) - pred * t + ln(1 + exp(-abs(pred)))), 6) AS bce_logits, round(avg(pow(pred - t, 2)), 6) AS mse, round(avg(abs(pred - t)), 6) AS l1 FROM c GROUP BY task")
def masked_losses(spark, d):
    return _r(metrics.present(predictions(spark, d)).groupBy("task").agg(*[c.alias(k) for k, c in metrics.losses().items()]))


@query(f"""WITH {PREDS}, s AS (SELECT row_id, task, target, pred AS a, 1 - pred AS b, pred * pred AS c FROM ok), e AS (SELECT *, greatest(a, b, c) AS m FROM s), z AS (SELECT *, exp(a - m) AS ea, exp(b - m) AS eb, exp(c - m) AS ec FROM e)
    SELECT task, round(avg(0.3::DOUBLE * -(CASE WHEN target = 0 THEN a ELSE b END - m - ln(ea + eb + ec)) + 0.7::DOUBLE * pow((eb + 2 * ec) / (ea + eb + ec) - target, 2)), 6) AS loss FROM z GROUP BY task""")
def hybrid_ce(spark, d):
    scores = F.array(F.col("pred"), 1 - F.col("pred"), F.col("pred") * F.col("pred"))
    return _r(metrics.present(predictions(spark, d)).groupBy("task").agg(F.avg(metrics.hybrid_ce(scores, F.col("target"), 3, 0.3)).alias("loss")))


@query(f"WITH {PREDS} SELECT round(avg(abs(pred - target)), 6) AS mae, count(*) AS n FROM ok")
def metric_flatten(spark, d):
    return _r(metrics.present(predictions(spark, d)).agg(metrics.regression()["mae"].alias("mae"), F.count("*").alias("n")))


@query(f"WITH {PREDS}, m AS (SELECT task, avg(abs(pred - target)) AS mae FROM ok GROUP BY task) SELECT round(avg(mae), 6) AS mae FROM m")
def metric_mean_per_label(spark, d):
    return _r(metrics.present(predictions(spark, d)).groupBy("task").agg(metrics.regression()["mae"].alias("mae")).agg(F.avg("mae").alias("mae")))


@query(f"WITH {PREDS} SELECT task, round(avg(abs(pred - coalesce(target, 1.5))), 6) AS mae, count(*) AS n FROM preds GROUP BY task")
def metric_nan_fill(spark, d):
    return _r(metrics.present(predictions(spark, d), 1.5).groupBy("task").agg(metrics.regression()["mae"].alias("mae"), F.count("*").alias("n")))


@query(f"WITH {PREDS}, m AS (SELECT task, avg(pow(pred - target, 2)) AS loss FROM ok GROUP BY task) SELECT task, round(loss, 6) AS loss FROM m UNION ALL SELECT '_global', round(avg(loss), 6) FROM m")
def multitask_loss(spark, d):
    """Loss of each task, and the plain mean of the tasks as _global."""
    per = metrics.present(predictions(spark, d)).groupBy("task").agg(metrics.losses()["mse"].alias("loss"))
    return _r(per.unionByName(per.agg(F.avg("loss").alias("loss")).select(F.lit("_global").alias("task"), "loss")))


@query(f"WITH {PREDS} SELECT task, round(avg(pred), 6) AS mean_pred, round(stddev_samp(pred), 6) AS std_pred, round(quantile_disc(pred, 0.5), 6) AS median_pred, round(avg(target), 6) AS mean_target, round(stddev_samp(target), 6) AS std_target, quantile_disc(target, 0.5) AS median_target FROM ok GROUP BY task")
def epoch_summary(spark, d):
    return _r(metrics.present(predictions(spark, d)).groupBy("task").agg(*[f(c).alias(f"{n}_{c}") for c in ("pred", "target") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("median", nanstats.nan_median))]))


@query(f"WITH {PREDS} SELECT row_id, task, CAST(pred > 0.7 AS DOUBLE) AS hit, CAST(target < 0.5 AS DOUBLE) AS low FROM preds")
def threshold_predicate(spark, d):
    return predictions(spark, d).select("row_id", "task", metrics.threshold(F.col("pred"), 0.7).alias("hit"), metrics.threshold(F.col("target"), 0.5, "lower").alias("low"))


@query(f"WITH {PREDS}, e AS (SELECT task, row_id % 5 AS epoch, avg(abs(pred - target)) AS value FROM ok GROUP BY ALL) SELECT task, arg_min(epoch, value) AS best_epoch FROM e GROUP BY task")
def best_epoch(spark, d):
    per = metrics.present(predictions(spark, d)).groupBy("task", (F.col("row_id") % 5).alias("epoch")).agg(metrics.regression()["mae"].alias("value"))
    return per.groupBy("task").agg(metrics.best_epoch(per, "mae").alias("best_epoch"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS mean_so_far FROM events")
def moving_average(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.round(F.avg("value").over(w), 10).alias("mean_so_far"))


@query(f"WITH {PREDS} SELECT task, row_id, quantile_disc(v, 0.5) AS median, round(avg(v), 9) AS mean, max(v) AS max FROM (SELECT task, row_id, unnest([round(pred, 6), round(pred * pred, 6), round(1 - pred, 6), 0.25::DOUBLE]) AS v FROM preds) GROUP BY ALL")
def ensemble_reduce(spark, d):
    members = F.explode(F.array(F.round("pred", 6), F.round(F.col("pred") * F.col("pred"), 6), F.round(1 - F.col("pred"), 6), F.lit(0.25)))
    rows = predictions(spark, d).select("task", "row_id", members.alias("v"))
    return rows.groupBy("task", "row_id").agg(nanstats.nan_median("v").alias("median"), F.round(F.avg("v"), 9).alias("mean"), F.max("v").alias("max"))


# three scores a line item against its flag; the highest score is the predicted class
_CLASSES = """c AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS t, l_quantity AS s0, l_discount * 500 AS s1, l_tax * 600 AS s2 FROM lineitem),
    h AS (SELECT t, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS p FROM c),
    k AS (SELECT x.k AS class, count(*) FILTER (t = x.k AND p = x.k) AS tp, count(*) FILTER (t <> x.k AND p = x.k) AS fp, count(*) FILTER (t = x.k AND p <> x.k) AS fn, count(*) FILTER (t <> x.k AND p <> x.k) AS tn, count(*) FILTER (t = x.k) AS support
      FROM h, (VALUES (0), (1), (2)) x(k) GROUP BY x.k)"""
_PER_CLASS = "round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0), 6) AS fbeta"
_NAMES = ("accuracy", "precision", "recall", "specificity", "fbeta")


def _classes(spark, d):
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return metrics.class_counts(spark.read.parquet(f"{d}/lineitem.parquet").select(flag.alias("target"), F.array(F.col("l_quantity"), F.col("l_discount") * 500, F.col("l_tax") * 600).alias("scores")))


@query(f"WITH {_CLASSES} SELECT class, tp, fp, fn, tn, support FROM k")
def multiclass_counts(spark, d):
    return _classes(spark, d)


@query(f"WITH {_CLASSES} SELECT class, support, {_PER_CLASS} FROM k")
def multiclass_per_class(spark, d):
    return _r(metrics.averaged(_classes(spark, d), None), 6, *_NAMES)


@query(f"WITH {_CLASSES}, m AS (SELECT support, {_PER_CLASS.replace('round(', '(').replace(', 6)', ')')} FROM k) SELECT 'macro' AS average, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _NAMES)} FROM m UNION ALL SELECT 'weighted', {', '.join(f'round(sum({n} * support) / sum(support), 6)' for n in _NAMES)} FROM m UNION ALL SELECT 'micro', {_PER_CLASS} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM k)")
def multiclass_averages(spark, d):
    counted = _classes(spark, d)
    parts = [metrics.averaged(counted, a).select(F.lit(a).alias("average"), *_NAMES) for a in ("macro", "weighted", "micro")]
    return _r(parts[0].unionByName(parts[1]).unionByName(parts[2]), 6, *_NAMES)


_ROC = f"""{PREDS}, w AS (SELECT task, pred, sum((1 + row_id % 3) * target) AS p, sum((1 + row_id % 3) * (1 - target)) AS q FROM ok GROUP BY ALL),
    s AS (SELECT task, p / sum(p) OVER (PARTITION BY task) AS up, q / sum(q) OVER (PARTITION BY task) AS along, sum(p) OVER d / sum(p) OVER (PARTITION BY task) AS tpr, sum(q) OVER d / sum(q) OVER (PARTITION BY task) AS fpr FROM w WINDOW d AS (PARTITION BY task ORDER BY pred DESC ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT task, up, along, tpr, fpr, CASE WHEN along > 0 THEN least(greatest(0.3 - (fpr - along), 0.0) / along, 1.0) ELSE 0.0 END AS part FROM s)"""


@query(f"WITH {_ROC} SELECT task, round(sum(along * (tpr - up + up / 2)), 6) AS whole, round(0.5 * (1 + (sum(part * along * (tpr - up + part * up / 2)) - 0.045) / 0.255), 6) AS partial FROM c GROUP BY task")
def auroc_weighted_partial(spark, d):
    """Weighted area under the ROC curve, whole and up to a false positive rate of 0.3."""
    rows = predictions(spark, d).withColumn("weight", (1 + F.col("row_id") % 3).cast("double"))
    whole, part = metrics.weighted_auroc(rows, "task"), metrics.weighted_auroc(rows, "task", max_fpr=0.3)
    return _r(whole.withColumnRenamed("auroc", "whole").join(part.withColumnRenamed("auroc", "partial"), "task"))


@query(f"""WITH {PREDS}, c AS (SELECT row_id, CAST(count(*) FILTER (pred > 0.5 AND target > 0) AS DOUBLE) AS tp, count(*) FILTER (pred > 0.5 AND NOT target > 0) AS fp, count(*) FILTER (NOT pred > 0.5 AND NOT target > 0) AS tn, count(*) FILTER (NOT pred > 0.5 AND target > 0) AS fn FROM ok GROUP BY row_id)
    SELECT round(avg((tp + tn) / (tp + tn + fp + fn)), 6) AS accuracy, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS recall, round(avg(coalesce(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 0)), 6) AS specificity, round(avg(coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0)), 6) AS fbeta FROM c""")
def sample_averages(spark, d):
    """Metrics of each document over its two labels, averaged over documents."""
    return _r(metrics.sample_averages(predictions(spark, d), "row_id"))
