"""Metrics of predictions, as aggregates. Frames have the columns y, p and, for areas under the curve, a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import medians

MAX_LABELS = 20
#: Every one is larger for better models.
SCORERS = (
    "accuracy", "balanced_accuracy", "f1", "precision", "recall", *(f"{m}_{how}" for m in ("f1", "precision", "recall") for how in ("weighted", "macro", "micro")),
    "matthews_corrcoef", "roc_auc", "roc_auc_ovr_weighted", "average_precision", "neg_log_loss", "neg_brier_score",
    "r2", "explained_variance", "neg_max_error", "neg_mean_squared_error", "neg_root_mean_squared_error", "neg_mean_absolute_error",
    "neg_median_absolute_error", "neg_mean_absolute_percentage_error", "neg_mean_squared_log_error", "neg_root_mean_squared_log_error",
)


def regression_metrics(df: DataFrame) -> DataFrame:
    """test_rmse, test_mae, test_r2; r2 from sums of squares around the first pass's mean."""
    y, p = F.col("y").cast("double"), F.col("p").cast("double")
    mean = df.agg(F.avg(y).alias("mean_y"))
    e = df.join(F.broadcast(mean)).agg(F.avg((y - p) ** 2).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.sum((y - p) ** 2).alias("left"), F.sum((y - F.col("mean_y")) ** 2).alias("all"))
    r2 = F.when(F.col("all") > 0, 1 - F.col("left") / F.col("all")).otherwise(F.when(F.col("left") == 0, 1.0).otherwise(0.0))
    return e.select(F.sqrt("mse").alias("test_rmse"), F.col("mae").alias("test_mae"), r2.alias("test_r2"))


def confusion_matrix(df: DataFrame, dense: bool = True) -> DataFrame:
    """(y, p, n); dense: all pairs of the labels that occur. No rows for more than MAX_LABELS labels."""
    counts = df.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select("y").union(counts.select("p")).distinct()
    few = labels.agg((F.count(F.lit(1)) <= MAX_LABELS).alias("few"))
    if dense:  # at most MAX_LABELS ** 2 pairs
        some = labels.join(F.broadcast(few)).where("few").select("y")
        pairs = some.join(F.broadcast(some.select(F.col("y").alias("p"))))
        counts = pairs.join(counts, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        return counts
    return counts.join(F.broadcast(few)).where("few").select("y", "p", "n")


def classification_metrics(df: DataFrame) -> DataFrame:
    """test_accuracy and test_precision, test_recall, test_f1, weighted by support; 0/0 is 0."""
    each = class_figures(df)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    f1 = ratio(2 * F.col("hit"), F.col("said") + F.col("support"))
    weighted = lambda x: F.sum(x * F.col("support")) / F.sum("support")
    return each.agg((F.sum("hit") / F.sum("support")).alias("test_accuracy"), weighted(precision).alias("test_precision"), weighted(recall).alias("test_recall"), weighted(f1).alias("test_f1"))


def _area(points: DataFrame, by: list[str]) -> DataFrame:
    """points (by..., score, pos, neg): rows with the same score are one point. (by..., auc, n_pos, n_neg) by mid-ranks: each
    positive beats the negatives with smaller scores and half of those with the same. Running sums are taken over ranges
    of the score, with the totals of the ranges before added."""
    points = points.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    placed = points.repartitionByRange("score").withColumn("part", F.spark_partition_id()).persist()
    inside = Window.partitionBy("part", *by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*by, "part").agg(F.sum("neg").alias("total"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).drop("total")
    below = placed.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(sums, [*by, "part"])
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("below") + F.col("neg") / 2))
    return below.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), wins.alias("wins")).select(
        *by, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg"
    )


def average_precision(df: DataFrame, positive) -> DataFrame:
    """average_precision of (y, score): the mean over the positives of the precision among all rows with at least their
    score. Running sums from the largest score down are taken over ranges, with the totals of the ranges above added; NULL
    without a positive."""
    hit = (F.col("y") == F.lit(positive)).cast("long")
    points = df.select((-F.col("score")).alias("lower"), hit.alias("pos")).groupBy("lower").agg(F.sum("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    placed = points.repartitionByRange("lower").withColumn("part", F.spark_partition_id()).persist()
    try:
        sums = placed.groupBy("part").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).orderBy("part").collect()  # one row a range
        before, starts = (0, 0), []
        for r in sums:
            starts.append((r.part, *before))
            before = before[0] + r.pos, before[1] + r.n
        offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "part int, pos_above long, n_above long"))
        upto = Window.partitionBy("part").orderBy("lower").rowsBetween(Window.unboundedPreceding, 0)
        share = (F.col("pos_above") + F.sum("pos").over(upto)) / (F.col("n_above") + F.sum("n").over(upto))
        each = placed.join(offsets, "part").select("pos", share.alias("precision"))
        value = each.agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * F.col("precision")) / F.sum("pos")).alias("average_precision")).first()[0]
    finally:
        placed.unpersist()
    return df.sparkSession.createDataFrame([(value,)], "average_precision double")


def error_metrics(df: DataFrame) -> DataFrame:
    """Further figures of errors: explained variance, the largest, the median (exact, by counts) and the relative error, and
    the squared error of logarithms (NULL if a value is below zero)."""
    y, p = F.col("y").cast("double"), F.col("p").cast("double")
    logs = F.when((F.min(y) >= 0) & (F.min(p) >= 0), F.avg((F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(F.greatest(p, F.lit(0.0)))) ** 2))
    r = df.agg(F.var_pop(y - p).alias("left"), F.var_pop(y).alias("all"), F.max(F.abs(y - p)).alias("most"), F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(2.0**-52))).alias("share"), logs.alias("logs")).first()
    explained = None if r.left is None else 1 - r.left / r["all"] if r["all"] else float(r.left == 0)
    return df.sparkSession.createDataFrame([(explained, r.most, medians(df, {"e": F.abs(y - p)})["e"], r.share, r.logs)], "explained_variance double, max_error double, median_absolute_error double, mean_absolute_percentage_error double, mean_squared_log_error double")


def class_figures(df: DataFrame) -> DataFrame:
    """(label, support, said, hit) of each label that occurs."""
    counts = df.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
    )
    return counts.select(F.explode(both).alias("r")).select("r.*").groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))


def averaged_metrics(df: DataFrame) -> DataFrame:
    """Balanced accuracy, Matthews' correlation, and precision, recall and F1 as means over labels and over all rows."""
    r = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    hit, said, support = F.col("hit"), F.col("said").cast("double"), F.col("support").cast("double")
    n, all_hit = F.sum(support), F.sum(hit)
    spread = F.sqrt((n * n - F.sum(said * said)) * (n * n - F.sum(support * support)))
    macro = {"precision": r(hit, said), "recall": r(hit, support), "f1": r(2 * hit, said + support)}
    return class_figures(df).agg(
        F.avg(F.when(support > 0, hit / support)).alias("balanced_accuracy"), F.when(spread > 0, (all_hit * n - F.sum(said * support)) / spread).otherwise(0.0).alias("matthews_corrcoef"),
        *(F.avg(v).alias(f"{k}_macro") for k, v in macro.items()), *((all_hit / n).alias(f"{k}_micro") for k in macro),
    )


def roc_auc(df: DataFrame, positive) -> DataFrame:
    """test_roc_auc of (y, score); NULL if one class is missing."""
    hit = (F.col("y") == F.lit(positive)).cast("long")
    return _area(df.select("score", hit.alias("pos"), (1 - hit).alias("neg")), []).select(F.col("auc").alias("test_roc_auc"))


def roc_auc_ovr_weighted(df: DataFrame, labels: list) -> DataFrame:
    """Each label's area against the rest, weighted by how often it occurs; df has (y, scores: an array in order of labels)."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.get("scores", i).alias("score"), (F.col("y") == F.lit(k)).cast("long").alias("pos")) for i, k in enumerate(labels))))
    points = df.select(each.alias("r")).select("r.*").withColumn("neg", 1 - F.col("pos"))
    return _area(points, ["label"]).agg((F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("roc_auc_ovr_weighted"))


def scored(df: DataFrame, metric: str, labels: list | None = None) -> float:
    """One figure, larger for better models. df: y, p and, where needed, scores (an array in order of labels)."""
    if metric not in SCORERS:
        raise ValueError(f"unknown metric {metric!r}; there are {', '.join(SCORERS)}")
    if metric in ("r2", "neg_mean_squared_error", "neg_root_mean_squared_error", "neg_mean_absolute_error"):
        r = regression_metrics(df).first()
        return {"r2": r.test_r2, "neg_root_mean_squared_error": -r.test_rmse, "neg_mean_squared_error": -(r.test_rmse**2), "neg_mean_absolute_error": -r.test_mae}[metric]
    errors = {"explained_variance": 1, "neg_max_error": -1, "neg_median_absolute_error": -1, "neg_mean_absolute_percentage_error": -1, "neg_mean_squared_log_error": -1, "neg_root_mean_squared_log_error": -1}
    if metric in errors:
        value = error_metrics(df).first()[metric.removeprefix("neg_").replace("root_", "")]
        return None if value is None else errors[metric] * (value**0.5 if "root_" in metric else value)
    if metric in ("f1", "precision", "recall"):  # of the second label
        r = class_figures(df).where(F.col("label") == F.lit(labels[1])).first()
        top, below = (2 * r.hit, r.said + r.support) if r and metric == "f1" else (r.hit, r.said if metric == "precision" else r.support) if r else (0, 0)
        return top / below if below else 0.0
    if metric in ("balanced_accuracy", "matthews_corrcoef") or metric.endswith(("_macro", "_micro")):
        return averaged_metrics(df).first()[metric]
    if metric == "average_precision":
        return average_precision(df.select("y", F.get("scores", 1).alias("score")), labels[1]).first()[0]
    if metric == "neg_brier_score":
        return df.agg(-F.avg((F.get("scores", 1) - (F.col("y") == F.lit(labels[1])).cast("double")) ** 2)).first()[0]
    if metric == "neg_log_loss":
        right = F.lit(None)
        for i, k in enumerate(labels):
            right = F.when(F.col("y") == F.lit(k), F.get("scores", i)).otherwise(right)
        return df.agg(F.avg(F.log(F.least(F.greatest(right, F.lit(1e-15)), F.lit(1.0))))).first()[0]
    if metric == "roc_auc":
        return roc_auc(df.select("y", F.get("scores", 1).alias("score")), labels[1]).first()[0]
    if metric == "roc_auc_ovr_weighted":
        return roc_auc_ovr_weighted(df, labels).first()[0]
    r = classification_metrics(df).first()
    return {"accuracy": r.test_accuracy, "f1_weighted": r.test_f1, "precision_weighted": r.test_precision, "recall_weighted": r.test_recall}[metric]


def cv_summary(scores: DataFrame, by: str = "trial_number") -> DataFrame:
    """(by, cv_mean, cv_std) of fold scores (by, score); the population deviation."""
    return scores.groupBy(by).agg(F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def leaderboard(trials: DataFrame, n: int | None = None) -> DataFrame:
    """Trials from the best score down; of equal ones the earlier first. Trials without a score (NaN) come last."""
    ordered = trials.orderBy(F.desc_nulls_last(F.nanvl("cv_score", F.lit(None))), "trial_number")
    return ordered.limit(n) if n else ordered


def best_trial(trials: DataFrame) -> DataFrame:
    """The one row with the highest score, the earliest of several; trials without a score (NaN) don't count."""
    return trials.where(~F.isnan("cv_score")).agg(F.max_by(F.struct(*trials.columns), F.struct("cv_score", -F.col("trial_number"))).alias("r")).select("r.*")


def top_importances(importances: DataFrame, n: int = 25) -> DataFrame:
    """The n largest of (feature, importance)."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def finite(metrics: DataFrame) -> DataFrame:
    """Rows of (key, value) whose value is a finite number."""
    v = F.col("value")
    return metrics.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
