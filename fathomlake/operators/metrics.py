"""Metrics.  Classification metrics follow from the confusion counts alone."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import log_clip
from .curves import one_vs_rest


#: Labels are gathered on the driver; a column with more is refused.
MOST_LABELS = 10_000


def regression_metrics(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """mse, rmse, mae and r2 = 1 - SSres / SStot, in one aggregate."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(prediction)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                  (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


def labels_of(df: DataFrame, truth: str, prediction: str) -> list:
    """All labels of both columns, ascending."""
    both = df.select(F.col(truth).alias("l")).union(df.select(F.col(prediction).alias("l"))).distinct()
    found = both.filter(F.col("l").isNotNull()).limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels: that is no class column")
    return sorted(r[0] for r in found)


def confusion(df: DataFrame, truth: str, prediction: str, labels: Sequence | None = None) -> DataFrame:
    """true_label, pred_label, n with zero cells; pairs off the list are dropped."""
    labels = labels_of(df, truth, prediction) if labels is None else list(labels)
    kind = df.schema[truth].dataType
    levels = F.array(*[F.lit(v).cast(kind) for v in labels])
    grid = df.sparkSession.range(1).select(F.explode(levels).alias("true_label")).withColumn("pred_label", F.explode(levels))
    counts = df.groupBy(F.col(truth).alias("_t"), F.col(prediction).cast(kind).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    same = (F.col("true_label") == F.col("_t")) & (F.col("pred_label") == F.col("_p"))
    return grid.join(counts, same, "left").select("true_label", "pred_label", F.coalesce("_n", F.lit(0)).alias("n"))


def accuracy(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.col(truth).eqNullSafe(F.col(prediction)).cast("double")).alias("accuracy"))


def _ratio(a: Column, b: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(float(otherwise)))


def class_scores(counts: DataFrame, zero_division: float = 0.0) -> DataFrame:
    """label, precision, recall, f1, support from confusion counts."""
    both = counts.select(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        counts.select(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))
    sums = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("tp"))
    p, r = _ratio(F.col("tp"), F.col("predicted"), zero_division), _ratio(F.col("tp"), F.col("support"), zero_division)
    return sums.select("label", "support", "tp", "predicted", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def precision_recall_f1(counts: DataFrame, averages: Sequence[str] = ("micro", "macro", "weighted"), zero_division: float = 0.0) -> DataFrame:
    """average, precision, recall, f1; f1 is that of the averaged two."""
    scores = class_scores(counts, zero_division)
    row = scores.agg(
        _ratio(F.sum("tp"), F.sum("predicted"), zero_division).alias("micro_p"), _ratio(F.sum("tp"), F.sum("support"), zero_division).alias("micro_r"),
        F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"),
        _ratio(F.sum(F.col("precision") * F.col("support")), F.sum("support"), 0).alias("weighted_p"),
        _ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support"), 0).alias("weighted_r"))
    rows = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("average"), F.col(f"{a}_p").alias("precision"), F.col(f"{a}_r").alias("recall")) for a in averages])).alias("s")).select("s.*")
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def plain_scores(counts: DataFrame, average: str = "binary") -> DataFrame:
    """label, precision, recall, f1 without micro or weighted means.

    ``none``: a row a class.  ``binary``: that of the second of two classes, else
    the means (null label), as for any other name.  f1 is that of the two numbers
    beside it; where both are 0 it is 0 for ``binary`` and NaN otherwise.
    """
    scores = class_scores(counts)
    if average == "none":
        rows = scores.select("label", "precision", "recall")
    else:
        means = scores.agg(F.lit(None).cast(scores.schema["label"].dataType).alias("label"), F.avg("precision").alias("precision"),
                           F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("_n"), F.max_by(F.struct("label", "precision", "recall"), "label").alias("_second"))
        two = F.lit(average == "binary") & (F.col("_n") == 2)
        rows = means.select(*[F.when(two, F.col("_second")[c]).otherwise(F.col(c)).alias(c) for c in ("label", "precision", "recall")])
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), both, 0.0 if average == "binary" else float("nan")))


def binary_scores(df: DataFrame, truth: str, prediction: str, strict: bool = False) -> DataFrame:
    """precision, recall and f1 of the second label, or of label 1 unless there are two."""
    labels = labels_of(df, truth, prediction)
    if strict and len(labels) != 2:
        raise ValueError("binary scores need exactly two labels")
    positive = labels[1] if len(labels) == 2 else 1
    return class_scores(confusion(df, truth, prediction, labels)).filter(F.col("label") == F.lit(positive)).select("label", "precision", "recall", "f1")


def class_report(counts: DataFrame) -> DataFrame:
    """scope, metric, value: classes, accuracy, and macro and weighted means.

    Macro and weighted f1 are means of the class f1 here.
    """
    scores = class_scores(counts)
    metrics = ["precision", "recall", "f1", "support"]
    classes = scores.select(F.col("label").cast("string").alias("scope"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("s")).select("scope", "s.*")
    w = F.sum("support")
    row = scores.agg(_ratio(F.sum("tp"), w, 0).alias("accuracy"), *[F.avg(m).alias(f"macro_{m}") for m in metrics[:3]],
                     *[_ratio(F.sum(F.col(m) * F.col("support")), w, 0).alias(f"weighted_{m}") for m in metrics[:3]])
    cells = [("all", "accuracy", "accuracy")] + [(s, m, f"{s}_{m}") for s in ("macro", "weighted") for m in metrics[:3]]
    return classes.unionByName(row.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(m).alias("metric"), F.col(c).alias("value")) for s, m, c in cells])).alias("s")).select("s.*"))


def class_report_with_areas(df: DataFrame, truth: str, prediction: str, scores: Mapping, positive=None) -> DataFrame:
    """``class_report`` with auc_roc and auc_pr of each class and of all.

    ``scores`` maps each class to its score column.  For all: those of the
    positive class (by default the second) if there are two, else the means over
    the classes.  Classes that never or always are the truth count as 0.
    """
    found = {r["curve"]: r for r in one_vs_rest(df, truth, scores).collect()}  # a row a class
    names = list(scores)
    rows = []
    for metric in ("auc_roc", "auc_pr"):
        own = [float(found[i][metric]) if i in found else 0.0 for i in range(len(names))]
        rows += [(str(c), metric, v) for c, v in zip(names, own, strict=True)]
        one = names.index(positive) if positive is not None else 1
        rows.append(("all", metric, own[one] if len(names) == 2 else sum(own) / max(len(names), 1)))
    report = class_report(confusion(df, truth, prediction))
    return report.unionByName(df.sparkSession.createDataFrame(rows, "scope string, metric string, value double"))


def cross_entropy(df: DataFrame, probability_of_truth: str, floor: float = 1e-10, weights_squared: float = 0.0, penalty: float = 0.0) -> DataFrame:
    """Mean -ln p of the true class, and lambda / (2n) times the squared weights."""
    return df.agg((F.avg(-log_clip(F.col(probability_of_truth), floor)) + F.lit(penalty * weights_squared / 2) / F.count(F.lit(1))).alias("cross_entropy"))


def majority_map(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, majority: the most frequent label, the smallest of equals."""
    counts = df.groupBy(cluster, label).count()
    order = Window.partitionBy(cluster).orderBy(F.desc("count"), label)
    return counts.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").select(F.col(cluster).alias("cluster"), F.col(label).alias("majority"))


def mapped_accuracy(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """Accuracy after each cluster takes its majority label."""
    mapping = majority_map(df, cluster, label).withColumnRenamed("cluster", "_c")
    joined = df.join(mapping, F.col(cluster) == F.col("_c"), "left")
    return joined.agg(F.avg(F.coalesce(F.col(label) == F.col("majority"), F.lit(False)).cast("double")).alias("accuracy"))


def vae_loss(df: DataFrame, truth: str, reconstruction: str, mean: str, log_variance: str, beta: float = 1.0) -> DataFrame:
    """Summed binary cross-entropy plus beta times the KL divergence."""
    bce = F.aggregate(F.zip_with(truth, reconstruction, lambda x, p: -(x * log_clip(p, 1e-12) + (1 - x) * log_clip(1 - p, 1e-12))), F.lit(0.0), lambda s, x: s + x)
    kl = F.aggregate(F.zip_with(mean, log_variance, lambda m, v: -0.5 * (1 + v - m * m - F.exp(v))), F.lit(0.0), lambda s, x: s + x)
    return df.agg(F.sum(bce + beta * kl).alias("loss"))
