"""ROC and precision-recall curves at distinct scores, and areas under them.

Rows are aggregated by score first, so ties are one point; running counts over
the scores are taken in ranges.  Positives are labels equal to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import durable
from ..functions.ordered import in_ranges, neighbours, running_sums


def threshold_counts(df: DataFrame, truth: str, score: str) -> DataFrame:
    """score, tp, fp (both at thresholds down to the score), n_pos, n_neg."""
    positive = (F.col(truth) == 1).cast("long")
    by_score = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    total = by_score.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"))
    running = running_sums(by_score, "score", {"tp": "pos", "fp": "neg"})
    return running.crossJoin(F.broadcast(total)).select("score", "tp", "fp", "n_pos", "n_neg")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def roc_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """score, fpr, tpr in any order; the point (0, 0) has a null score."""
    points = threshold_counts(df, truth, score).select("score", _share(F.col("fp"), F.col("n_neg")).alias("fpr"), _share(F.col("tp"), F.col("n_pos")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)


def pr_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """score, recall, precision; the first precision again at recall 0 (null score)."""
    points = threshold_counts(df, truth, score).select(
        "score", _share(F.col("tp"), F.col("n_pos")).alias("recall"),
        F.when(F.col("n_pos") > 0, _share(F.col("tp"), F.col("tp") + F.col("fp"))).otherwise(0.0).alias("precision"))
    first = points.agg(F.max_by("precision", "score").alias("precision")).select(F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("recall"), F.coalesce("precision", F.lit(0.0)).alias("precision"))
    return first.unionByName(points)


def _trapezoids(points: DataFrame) -> DataFrame:
    """Area under (x, y) with distinct x; 0 for fewer than two points."""
    steps = neighbours(points, "x", ["x", "y"])
    return steps.agg(F.coalesce(F.sum((F.col("x") - F.col("prev_x")) * (F.col("y") + F.col("prev_y")) / 2), F.lit(0.0)).alias("auc"))


def auc_collapsed(curve: DataFrame, x: str, y: str) -> DataFrame:
    """One y for each distinct x, the one met first along the curve.

    That is the point with the highest threshold: the smallest tpr of a ROC
    curve.  Vertical stretches count for nothing, so the area of a ROC curve is
    at most the standard one.
    """
    along = F.coalesce(F.col("score"), F.lit(float("inf")))
    points = curve.groupBy(F.col(x).alias("x")).agg(F.max_by(F.col(y), along).alias("y"))
    return _trapezoids(points)


def auc_standard(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The usual trapezoid area: vertical stretches included.

    Of the points at one x the first and the last along the curve bound the
    trapezoids to either side.
    """
    along = F.coalesce(F.col("score"), F.lit(float("inf")))
    points = curve.groupBy(F.col(x).alias("x")).agg(F.max_by(F.col(y), along).alias("first"), F.min_by(F.col(y), along).alias("last"))
    steps = neighbours(points, "x", ["x", "last"])
    return steps.agg(F.coalesce(F.sum((F.col("x") - F.col("prev_x")) * (F.col("first") + F.col("prev_last")) / 2), F.lit(0.0)).alias("auc"))


def threshold_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """score, fpr, tpr, precision at every distinct score; no point is added at the start.

    The recall at a threshold is its tpr.  Shares of nothing are 0.
    """
    positives, negatives = F.col("n_pos"), F.col("n_neg")
    return threshold_counts(df, truth, score).select(
        "score", _share(F.col("fp"), negatives).alias("fpr"), _share(F.col("tp"), positives).alias("tpr"),
        _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def auc_along(points: DataFrame, x: str, y: str) -> DataFrame:
    """Trapezoid area between consecutive points by falling score, the sign turned if x ends no higher than it began.

    Nothing is put before the first point, so its stretch from 0 is left out.
    """
    steps = neighbours(points.select((-F.col("score")).alias("at"), F.col(x).alias("x"), F.col(y).alias("y")), "at", ["x", "y"])
    area = F.sum((F.col("x") - F.col("prev_x")) * (F.col("y") + F.col("prev_y")) / 2)
    sums = steps.agg(area.alias("area"), F.min_by("x", "at").alias("first"), F.max_by("x", "at").alias("last"))
    return sums.select(F.coalesce(F.when(F.col("last") > F.col("first"), F.col("area")).otherwise(-F.col("area")), F.lit(0.0)).alias("auc"))


def areas(df: DataFrame) -> DataFrame:
    """curve, auc_roc, auc_pr: the collapsed areas of many curves in one plan.

    ``df`` has curve, y (1 is positive) and score; rows without a score take no
    part.  Scores of all curves lie in ranges of (curve, score): sums and
    neighbours run inside a range and take what they need of the ranges before
    from a table of a row a curve and range.  A curve without positives or
    without negatives has a ROC area of 0, one without positives a PR area of 0.
    """
    positive = (F.col("y") == 1).cast("long")
    scores = df.filter(F.col("score").isNotNull()).groupBy("curve", "score").agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    cut = in_ranges(scores, [F.asc("curve"), F.desc("score")])
    inside = Window.partitionBy("curve", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("curve").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("curve")
    sums = cut.groupBy("curve", "_part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = sums.select("curve", "_part", F.sum("pos").over(whole).alias("n_pos"), F.sum("neg").over(whole).alias("n_neg"),
                       *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in ("pos", "neg")])
    points = cut.join(sums, ["curve", "_part"]).withColumn("tp", F.sum("pos").over(inside) + F.col("before_pos")).withColumn(
        "fp", F.sum("neg").over(inside) + F.col("before_neg"))
    points = durable(points.select("curve", "_part", "_at", "pos", "neg", "n_pos", "n_neg", "tp", "fp"))

    def along(kept: Column, height: Column, start: Column) -> Column:
        """Trapezoids between the kept points: half the height here and at the kept point before."""
        last = F.last(F.when(kept, height), ignorenulls=True)
        here = last.over(Window.partitionBy("curve", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        return F.when(kept, (height + F.coalesce(here, F.col("_carried"), start)) / 2)

    def area(name: str, kept: Column, width: Column, height: Column, start: Column) -> DataFrame:
        ends = points.groupBy("curve", "_part").agg(F.max_by(F.when(kept, height), F.when(kept, F.col("_at"))).alias("_end"))
        carried = ends.select("curve", "_part", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
        first = points.groupBy("curve").agg(F.min_by(height, F.struct("_part", "_at")).alias("_first"))
        steps = points.join(carried, ["curve", "_part"]).join(F.broadcast(first), "curve").withColumn("_mean", along(kept, height, start))
        return steps.groupBy("curve").agg(F.coalesce(F.sum(width * F.col("_mean")), F.lit(0.0)).alias(name))

    def share(a: str, b: Column) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))

    roc = area("auc_roc", F.col("neg") > 0, share("neg", F.col("n_neg")), share("tp", F.col("n_pos")), F.lit(0.0))
    pr = area("auc_pr", F.col("pos") > 0, share("pos", F.col("n_pos")), share("tp", F.col("tp") + F.col("fp")), F.col("_first"))
    return roc.join(pr, "curve")


def one_vs_rest(df: DataFrame, truth: str, scores: dict) -> DataFrame:
    """curve (the place of the class in ``scores``), auc_roc, auc_pr: each class against the others.

    ``scores`` maps a class to its score column; a class that never or always
    is the truth has no row.
    """
    cells = [F.struct(F.lit(i).alias("curve"), F.coalesce((F.col(truth) == F.lit(label)).cast("int"), F.lit(0)).alias("y"), F.col(column).cast("double").alias("score"))
             for i, (label, column) in enumerate(scores.items())]
    tall = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    both = tall.groupBy("curve").agg(F.min("y").alias("low"), F.max("y").alias("high")).filter("low = 0 and high = 1").select("curve")
    return areas(tall).join(F.broadcast(both), "curve")  # a row a class


def auc_one_vs_rest(df: DataFrame, truth: str, scores: dict) -> float:
    """Sum of the classes' collapsed ROC areas over the number of all classes.

    A class that never or always is the truth counts as 0.
    """
    total = one_vs_rest(df, truth, scores).agg(F.sum("auc_roc")).first()[0] or 0.0
    return total / max(len(scores), 1)


def fixed_threshold_curve(df: DataFrame, truth: str, score: str, thresholds: int = 100) -> DataFrame:
    """tp, fp, fn, tn, fpr, tpr, precision at evenly spaced thresholds in [0, 1].

    One pass: rows are counted by the number of thresholds they reach, and the
    counts of at most ``thresholds + 1`` groups are joined to the thresholds.
    """
    step = 1.0 / (thresholds - 1)
    cuts = df.sparkSession.range(thresholds).select((F.col("id") * step).alias("threshold"), F.col("id").alias("i"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(thresholds - 1)), lambda i: i * step)
    reached = F.size(F.filter(grid, lambda t: t <= F.col(score))) - 1
    positive = (F.col(truth) == 1).cast("long")
    counts = df.groupBy(reached.alias("top")).agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))
    hit = F.col("top") >= F.col("i")
    sums = cuts.crossJoin(F.broadcast(counts)).groupBy("threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"))
    return sums.select("threshold", "tp", "fp", "fn", "tn", _share(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                       _share(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"), _share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
