"""Metrics over (pred, target) as aggregates; a NULL target is missing. All are mergeable sums, or windows over scores where a
metric needs an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(rows: DataFrame, handling: str | float | None = "ignore") -> DataFrame:
    """Missing targets: "ignore" drops the rows, a number takes their place, None leaves them."""
    target = F.nanvl(F.col("target").cast("double"), F.lit(None).cast("double"))
    rows = rows.withColumn("target", target)
    if handling == "ignore":
        return rows.where("target is not null")
    return rows if handling is None else rows.withColumn("target", F.coalesce("target", F.lit(float(handling))))


def threshold(x: Column, at: float, operator: str = "greater") -> Column:
    """1 where x > at (or <), else 0; NULL stays NULL, so missing targets never become negatives."""
    if operator not in ("greater", "lower"):
        raise ValueError(f"operator is greater or lower, not {operator!r}")
    return (x > at if operator == "greater" else x < at).cast("double")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, from mergeable moments of the rows that have both; null where one of them is constant (corr() raises an error there)."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression() -> dict[str, Column]:
    p, t = F.col("pred"), F.col("target")
    e = p - t
    return {
        "mae": F.avg(F.abs(e)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mape": F.avg(F.abs(e) / F.greatest(F.abs(t), F.lit(1.17e-6))),
        "msle": F.avg(F.pow(F.log1p(p) - F.log1p(t), F.lit(2))), "cosine": F.try_divide(F.sum(p * t), F.sqrt(F.sum(p * p)) * F.sqrt(F.sum(t * t))), "pearsonr": correlation(p, t),
        # the sum of squares around the mean from mergeable sums; null where the target is constant, as cosine is for zero vectors
        "r2": 1 - F.try_divide(F.sum(e * e), F.var_pop(t) * F.count(t)),
    }


def counts(at: float = 0.5) -> dict[str, Column]:
    hit, true = F.col("pred") >= at, F.col("target") == 1
    return {"tp": F.count_if(hit & true), "fp": F.count_if(hit & ~true), "tn": F.count_if(~hit & ~true), "fn": F.count_if(~hit & true)}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def classification(counted: DataFrame, beta: float = 1.0) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    b2 = beta * beta
    return counted.withColumns({
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp),
        "fbeta": ratio((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    })


def class_counts(rows: DataFrame, top_k: int = 1, ignore_index: int | None = None) -> DataFrame:
    """class, tp, fp, fn, tn, support over (scores: array, one a class; target: class number). The `top_k` highest scores are the
    predicted classes, the lowest number first of equals; rows with a null target or `ignore_index` are left out. Classes that
    are neither target nor predicted have no row. A row is turned into 1 + top_k small ones, which are summed before the shuffle."""
    rows = rows.where("target is not null")
    rows = rows if ignore_index is None else rows.where(F.col("target") != ignore_index)
    best = F.slice(F.array_sort(F.transform("scores", lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, top_k)
    own = rows.select(F.col("target").cast("int").alias("target"), F.transform(best, lambda x: x["i"]).alias("best"))
    hit = F.array_contains("best", F.col("target")).cast("long")
    mark = lambda c, support, tp, chosen: F.struct(c.alias("class"), F.lit(support).alias("support"), tp.alias("tp"), F.lit(chosen).alias("chosen"))
    parts = F.concat(F.array(mark(F.col("target"), 1, hit, 0)), F.transform("best", lambda c: mark(c, 0, F.lit(0).cast("long"), 1)))
    summed = own.select(F.explode(parts).alias("x")).groupBy("x.class").agg(*[F.sum(f"x.{c}").alias(c) for c in ("support", "tp", "chosen")])
    n = F.sum("support").over(Window.partitionBy(F.lit(0)))  # one row a class
    return summed.select("class", "tp", (F.col("chosen") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), (n - F.col("support") - F.col("chosen") + F.col("tp")).alias("tn"), "support")


def averaged(counted: DataFrame, average: str | None = "macro", beta: float = 1.0) -> DataFrame:
    """Metrics of class_counts(): "micro" from the sums, "macro" the plain mean over classes, "weighted" by support, None a row
    for each class. Classes that nobody predicted or had are in no average."""
    if average not in ("micro", "macro", "weighted", None):
        raise ValueError(f"average is micro, macro, weighted or None, not {average!r}")
    names = ["accuracy", "precision", "recall", "specificity", "fbeta"]
    if average == "micro":
        return classification(counted.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")]), beta).select(*names)
    per = classification(counted, beta)
    if average is None:
        return per.select("class", "support", *names)
    if average == "macro":
        return per.agg(*[F.avg(c).alias(c) for c in names])
    return per.agg(*[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names])


def by_score(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows and positives of every distinct score (summed before any window, so windows see scores and not rows), with the
    running sums from the highest score and from the lowest."""
    level = rows.groupBy(*keys, "pred").agg(F.count("*").alias("n"), F.sum(F.col("target")).alias("pos"))
    down = Window.partitionBy(*keys).orderBy(F.desc("pred")).rowsBetween(Window.unboundedPreceding, 0)
    return level.withColumns({"seen": F.sum("n").over(down), "tp": F.sum("pos").over(down), "all": F.sum("n").over(Window.partitionBy(*keys)), "pos_all": F.sum("pos").over(Window.partitionBy(*keys))})


def auroc(rows: DataFrame, *keys: str) -> DataFrame:
    """Mann-Whitney with ties counted half."""
    s = by_score(rows, *keys)
    below = F.col("all") - F.col("seen") - (F.col("pos_all") - F.col("tp"))  # negatives with a lower score
    wins = F.sum(F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    return s.groupBy(*keys).agg((wins / F.nullif(F.max("pos_all") * (F.max("all") - F.max("pos_all")), F.lit(0.0))).alias("auroc"))


def weighted_auroc(rows: DataFrame, *keys: str, max_fpr: float = 1.0) -> DataFrame:
    """Area under the ROC curve of (pred, target, weight), up to the false positive rate `max_fpr`: there the curve is cut on its straight
    line, and the area scaled so that chance is 0.5 and perfection 1. Null without positive or negative weight. Scores are summed before
    windows see them; rows with a null weight or target are left out."""
    if not 0 < max_fpr <= 1:
        raise ValueError("max_fpr lies in (0, 1]")
    own = rows.where("weight is not null and target is not null")
    level = own.groupBy(*keys, "pred").agg(F.sum(F.col("weight") * F.col("target")).alias("p"), F.sum(F.col("weight") * (1 - F.col("target"))).alias("q"))
    down, every = Window.partitionBy(*keys).orderBy(F.desc("pred")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    share = lambda c: F.try_divide(F.sum(c).over(down), F.sum(c).over(every))
    step = lambda c: F.try_divide(F.col(c), F.sum(c).over(every))
    s = level.select(*keys, share("p").alias("tpr"), share("q").alias("fpr"), step("p").alias("up"), step("q").alias("along"))
    before, low = F.col("fpr") - F.col("along"), F.col("tpr") - F.col("up")
    part = F.when(F.col("along") > 0, F.least(F.greatest(F.lit(max_fpr) - before, F.lit(0.0)) / F.col("along"), F.lit(1.0))).otherwise(F.lit(0.0))
    area = F.sum(part * F.col("along") * (low + part * F.col("up") / 2)).alias("area")
    out = s.groupBy(*keys).agg(area, F.count_if(F.col("tpr").isNull() | F.col("fpr").isNull()).alias("none"))
    least = max_fpr * max_fpr / 2
    scaled = F.col("area") if max_fpr == 1 else 0.5 * (1 + (F.col("area") - least) / (max_fpr - least))
    return out.select(*keys, F.when(F.col("none") == 0, scaled).alias("auroc"))


def sample_averages(rows: DataFrame, sample: str, at: float = 0.5, beta: float = 1.0) -> DataFrame:
    """One row: precision, recall, fbeta, accuracy and specificity of each sample over its labels (pred, target), averaged over samples. Rows
    without a target are left out, so a sample without any does not count."""
    hit = rows.where("target is not null and pred is not null").select(sample, (F.col("pred") > at).alias("h"), (F.col("target") > 0).alias("t"))
    counted = hit.groupBy(sample).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.col("h") & F.col("t")), ("fp", F.col("h") & ~F.col("t")), ("tn", ~F.col("h") & ~F.col("t")), ("fn", ~F.col("h") & F.col("t")))])
    return classification(counted, beta).agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "fbeta")])


def multidim_averages(rows: DataFrame, sample: str, how: str, average: str = "macro", beta: float = 1.0) -> DataFrame:
    """Multi-class metrics where a sample has several (scores, target) rows: `global` counts all rows together, `samplewise` averages each
    sample's rows by `average` and then the samples."""
    if how == "global":
        return averaged(class_counts(rows), average, beta)
    if how != "samplewise" or average not in ("micro", "macro"):
        raise ValueError(f"how is global, or samplewise with micro or macro, not {how!r} with {average!r}")
    best = F.array_min(F.transform("scores", lambda x, i: F.struct((-x).alias("x"), i.alias("i"))))["i"]
    own = rows.where("target is not null").select(sample, F.col("target").cast("int").alias("t"), best.alias("b"))
    parts = F.array(F.struct(F.col("t").alias("class"), F.lit(1).alias("support"), (F.col("t") == F.col("b")).cast("int").alias("tp"), F.lit(0).alias("chosen")), F.struct(F.col("b").alias("class"), F.lit(0).alias("support"), F.lit(0).alias("tp"), F.lit(1).alias("chosen")))
    summed = own.select(sample, F.explode(parts).alias("x")).groupBy(sample, "x.class").agg(*[F.sum(f"x.{c}").alias(c) for c in ("support", "tp", "chosen")])
    n = F.sum("support").over(Window.partitionBy(sample))
    counted = summed.select(sample, "tp", (F.col("chosen") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), (n - F.col("support") - F.col("chosen") + F.col("tp")).alias("tn"))
    if average == "micro":
        counted = counted.groupBy(sample).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    names = ["accuracy", "precision", "recall", "specificity", "fbeta"]
    per = classification(counted, beta).groupBy(sample).agg(*[F.avg(c).alias(c) for c in names])
    return per.agg(*[F.avg(c).alias(c) for c in names])


def average_precision(rows: DataFrame, *keys: str) -> DataFrame:
    return by_score(rows, *keys).groupBy(*keys).agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.max("pos_all"), F.lit(0.0))).alias("ap"))


def pr_curve(rows: DataFrame, *keys: str) -> DataFrame:
    """Precision and recall at every score; recall is null where there is no positive."""
    return by_score(rows, *keys).select(*keys, F.col("pred").alias("threshold"), (F.col("tp") / F.col("seen")).alias("precision"), F.try_divide("tp", "pos_all").alias("recall"))


def _ranks(rows: DataFrame, column: str, key: list[str], average: bool) -> DataFrame:
    """Ranks of one column. Values are counted first; equal values share their mean rank, or are told apart by row."""
    level = rows.groupBy(*key, column).agg(F.count("*").alias("n"))
    up = Window.partitionBy(*key).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    level = level.withColumn("before", F.coalesce(F.sum("n").over(up), F.lit(0)))
    out = rows.join(level, [*key, column])
    own = (F.col("n") + 1) / 2 if average else F.row_number().over(Window.partitionBy(*key, column).orderBy("row_id"))
    return out.withColumn(f"rank_{column}", (F.col("before") + own).cast("double")).drop("n", "before")


def spearman(rows: DataFrame, *keys: str, average: bool = True) -> DataFrame:
    """Pearson correlation of ranks; ties share ranks, or with average=False are ordered by row_id."""
    out = _ranks(_ranks(rows, "pred", list(keys), average), "target", list(keys), average)
    return out.groupBy(*keys).agg(correlation(F.col("rank_pred"), F.col("rank_target")).alias("spearman"))


def losses() -> dict[str, Column]:
    p, t = F.col("pred"), F.col("target")
    safe = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return {
        "bce": F.coalesce(F.avg(-(t * F.log(safe) + (1 - t) * F.log(1 - safe))), F.lit(0.0)), "bce_logits": F.coalesce(F.avg(F.greatest(p, F.lit(0.0)) - p * t + F.log1p(F.exp(-F.abs(p)))), F.lit(0.0)),
        "mse": F.coalesce(F.avg((p - t) * (p - t)), F.lit(0.0)), "l1": F.coalesce(F.avg(F.abs(p - t)), F.lit(0.0)),
    }


def hybrid_ce(scores: Column, target: Column, brackets: int, alpha: float = 0.5, regression_loss: str = "mse") -> Column:
    """alpha * cross entropy + (1 - alpha) * regression loss between the expected bracket and the target, for an array of scores."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    if regression_loss not in ("mse", "mae"):
        raise ValueError(f"no regression loss {regression_loss!r}")
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    ce = -(F.get(scores, target.cast("int")) - top - F.log(total))
    expected = F.aggregate(F.zip_with(e, F.sequence(F.lit(0), F.lit(brackets - 1)), lambda x, k: x / total * k), F.lit(0.0), lambda a, x: a + x)
    gap = expected - target
    return alpha * ce + (1 - alpha) * (gap * gap if regression_loss == "mse" else F.abs(gap))


#: Whether a larger value of a benchmark's metric is better.
MODES = {"mae": "min", "mse": "min", "rmse": "min", "auroc": "max", "auprc": "max", "ap": "max", "spearman": "max", "pearsonr": "max", "r2": "max", "accuracy": "max", "fbeta": "max", "mcc": "max"}


def best_epoch(summary: DataFrame, metric: str) -> Column:
    """The epoch whose metric is best, as an aggregate over (epoch, value)."""
    pick = F.min_by if MODES[metric] == "min" else F.max_by
    return pick("epoch", "value")
