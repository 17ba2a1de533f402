"""Evaluation of predictions (y_true 0/1, y_prob) by groups, all in aggregates and windows over distinct scores.

Curves are computed per group on one row for each distinct score, so ties collapse first; what is left is put in order range
by range (see `ranges`), so that a group of very many scores isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ranges


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pred: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts and the metrics made of them; a metric without a denominator is 0."""
    p, y = F.col("y_prob") >= threshold, F.col("y_true") == 1
    c = pred.groupBy(*by).agg(*(F.count_if(x).alias(n) for n, x in (("tp", p & y), ("fp", p & ~y), ("tn", ~p & ~y), ("fn", ~p & y))))
    tp, fp, tn, fn = (F.col(n) for n in ("tp", "fp", "tn", "fn"))
    return c.withColumns({
        "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1_score": _ratio(2 * tp, 2 * tp + fp + fn),
        "bac": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
    })


def _steps(pred: DataFrame, by: list[str], ahead: bool = False, size: int | None = None) -> DataFrame:
    """by, threshold, p, m (positives and negatives of that score), tps, fps (cumulated from the highest score), pos, neg, k
    (1 for the highest), _part; and with `ahead` the next score's p and m."""
    per = pred.groupBy(*by, F.col("y_prob").alias("threshold")).agg(F.sum(F.col("y_true").cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).withColumn("m", F.col("n") - F.col("p"))
    sums = {"tps": F.col("p"), "fps": F.col("m"), "k": F.lit(1).cast("long")}
    s = ranges.running(ranges.cut(per, by, "threshold", True, size), by, [F.desc("threshold")], sums, {"next_p": "p", "next_m": "m"} if ahead else None)
    return s.select(*by, "threshold", "p", "m", "tps", "fps", F.col("tps_all").alias("pos"), F.col("fps_all").alias("neg"), "k", "_part", *(["next_p", "next_m"] if ahead else []))


def roc_curve(pred: DataFrame, by: list[str], drop_intermediate: bool = True, size: int | None = None) -> DataFrame:
    """by, k, threshold, fpr, tpr from (infinity, 0, 0) on; points on a straight line between their neighbours are dropped.
    A group of one class has null rates on the missing side. `size` is the scores a range of the order has (see `ranges`)."""
    return _roc(_steps(pred, by, True, size), by, drop_intermediate)


def _roc(s: DataFrame, by: list[str], drop_intermediate: bool = True) -> DataFrame:
    if drop_intermediate:
        # The first and the last point stay; so does each that isn't straight.
        s = s.where("next_p is null or next_p <> p or next_m <> m or k = 1")
    rate = lambda a, b: F.try_divide(a.cast("double"), F.col(b).cast("double"))
    # Before the highest score there is one point more.
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("fps"), F.lit(0).cast("long").alias("tps"))
    own = F.struct(F.lit(1).cast("long").alias("c"), F.col("threshold"), F.col("fps"), F.col("tps"))
    points = ranges.running(s.drop("k"), by, [F.desc("threshold")], {"k": F.lit(1).cast("long")})
    both = points.select(*by, "k", "pos", "neg", F.explode(F.when(F.col("k") == 1, F.array(start, own)).otherwise(F.array(own))).alias("o"))
    return both.select(*by, F.when(F.col("o.c") == 0, F.lit(0).cast("long")).otherwise(F.col("k")).alias("k"), F.col("o.threshold").alias("threshold"), rate(F.col("o.fps"), "neg").alias("fpr"), rate(F.col("o.tps"), "pos").alias("tpr"))


def roc_auc(pred: DataFrame, by: list[str]) -> DataFrame:
    """Rank-sum form over distinct scores; null for a group of one class."""
    return _areas(_steps(pred, by), by).select(*by, "auc")


def pr_areas(pred: DataFrame, by: list[str]) -> DataFrame:
    """auprc by trapezoids (from precision 1 at recall 0) and ap, the average precision by steps; null without positives."""
    return _areas(_steps(pred, by), by).select(*by, "auprc", "ap")


def areas(pred: DataFrame, by: list[str], size: int | None = None) -> DataFrame:
    """by, auc, auprc, ap in one pass."""
    return _areas(_steps(pred, by, size=size), by)


def _areas(s: DataFrame, by: list[str]) -> DataFrame:
    tps, n = F.col("tps"), F.col("tps") + F.col("fps")
    under = F.col("m") * (2 * tps - F.col("p")) / 2.0
    now, before = tps / n, F.coalesce(F.try_divide((tps - F.col("p")).cast("double"), (n - F.col("p") - F.col("m")).cast("double")), F.lit(1.0))
    d = F.try_divide(F.col("p").cast("double"), F.col("pos").cast("double"))
    auc = F.try_divide(F.sum(under), (F.first("pos") * F.first("neg")).cast("double"))
    return s.groupBy(*by).agg(auc.alias("auc"), F.sum(d * (now + before) / 2).alias("auprc"), F.sum(d * now).alias("ap"))


def bac_at_sensitivity(pred: DataFrame, by: list[str], sensitivity: float = 0.8) -> DataFrame:
    """Balanced accuracy at the first (highest) threshold whose true-positive rate reaches `sensitivity`."""
    return _first_at(roc_curve(pred, by), by, sensitivity)


def _first_at(curve: DataFrame, by: list[str], sensitivity: float) -> DataFrame:
    c = curve.where(F.col("tpr") >= sensitivity)
    return c.groupBy(*by).agg(F.min(F.struct("k", "threshold", "tpr", "fpr")).alias("m")).select(*by, F.col("m.threshold").alias("threshold"), ((F.col("m.tpr") + 1 - F.col("m.fpr")) / 2).alias("bac"))


def optimal_threshold(pred: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with the largest sqrt(TPR (1 - FPR)), the highest of equals."""
    g = F.round(F.sqrt(F.col("tpr") * (1 - F.col("fpr"))), 12)
    c = roc_curve(pred, by).withColumn("gmean", g)
    return c.groupBy(*by).agg(F.max(F.struct("gmean", (-F.col("k")).alias("_k"), "threshold")).alias("m")).select(*by, F.col("m.threshold").alias("threshold"), F.col("m.gmean").alias("gmean"))


def posterior_slope(pred: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """threshold * P(negative) / (P(positive) * (1 - threshold))."""
    p = pred.groupBy(*by).agg(F.avg(F.col("y_true").cast("double")).alias("prior"))
    return p.select(*by, "prior", F.try_divide(threshold * (1 - F.col("prior")), F.col("prior") * (1 - threshold)).alias("slope"))


def class_weight(pred: DataFrame, by: list[str]) -> DataFrame:
    """Negatives for each positive, 1 without positives."""
    pos = F.count_if(F.col("y_true") == 1)
    return pred.groupBy(*by).agg(F.coalesce(F.try_divide(F.count_if(F.col("y_true") == 0).cast("double"), pos.cast("double")), F.lit(1.0)).alias("weight"))


def vertical_average(curves: DataFrame, curve: str, strips: int = 64) -> DataFrame:
    """Mean TPR of several curves at every FPR that any has, by linear interpolation."""
    return vertical_averages(curves, [], curve, strips)


def vertical_averages(curves: DataFrame, by: list[str], curve: str, strips: int = 64) -> DataFrame:
    """Of each group its curves' mean TPR at every FPR that any of them has; points without a rate are left out.

    A curve is a sum of steps and bends: where it has a point, its value jumps and its slope changes. These changes add up
    over curves, so the mean at a place is a running sum of all changes up to it. Changes are added up by place, summed in
    `strips` of the unit interval apart, and each strip starts from what the ones before it add up to: no curve is met with
    another's points, and no task holds them all.
    """
    points = curves.where("fpr is not null and tpr is not null").groupBy(*by, curve, "fpr").agg(F.max("tpr").alias("hi"), F.min("tpr").alias("lo"))
    along = Window.partitionBy(*by, curve).orderBy("fpr")
    ahead = F.coalesce(F.try_divide(F.lead("lo").over(along) - F.col("hi"), F.lead("fpr").over(along) - F.col("fpr")), F.lit(0.0))
    steps = points.withColumn("slope", ahead).withColumn("first", F.lag("fpr").over(along).isNull())
    steps = steps.withColumn("bend", F.col("slope") - F.coalesce(F.lag("slope").over(along), F.lit(0.0))).withColumn("jump", F.when(F.col("first"), F.col("hi")).otherwise(F.col("hi") - F.col("lo")))
    places = steps.groupBy(*by, "fpr").agg(F.sum("jump").alias("jump"), F.sum("bend").alias("bend"), F.count_if("first").alias("curves"))
    places = places.withColumn("level", F.col("jump") - F.col("bend") * F.col("fpr")).withColumn("strip", F.least(F.floor(F.col("fpr") * strips), F.lit(strips - 1)))
    sums = ("level", "bend", "curves")
    upto = Window.partitionBy(*by).orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    totals = places.groupBy(*by, "strip").agg(*(F.sum(c).alias(c) for c in sums))  # at most `strips` rows a group
    before = totals.select(*by, "strip", *(F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_0") for c in sums))
    own = Window.partitionBy(*by, "strip").orderBy("fpr")
    run = lambda c: F.sum(c).over(own) + F.col(f"{c}_0")
    made = places.join(before, [*by, "strip"]).select(*by, "fpr", run("level").alias("level"), run("bend").alias("bend"), run("curves").alias("curves"))
    return made.select(*by, "fpr", ((F.col("level") + F.col("bend") * F.col("fpr")) / F.col("curves")).alias("tpr"))


def curve_area(curve: DataFrame, by: list[str]) -> DataFrame:
    """Area under fpr, tpr by trapezoids."""
    x = ranges.running(ranges.cut(curve, by, "fpr"), by, [F.asc("fpr"), F.asc("tpr")], {}, behind={"_x": "fpr", "_y": "tpr"})
    strip = (F.col("fpr") - F.col("_x")) * (F.col("tpr") + F.col("_y")) / 2
    return x.groupBy(*by).agg(F.sum(strip).alias("area"))


def summary(pred: DataFrame, by: list[str]) -> DataFrame:
    """Of each run: accuracy, precision, recall, f1_score and bac of y_pred; auc, bac80, auprc and ap of y_prob."""
    flat = confusion(pred.withColumn("y_prob", F.col("y_pred").cast("double")), by).select(*by, "accuracy", "precision", "recall", "f1_score", "bac")
    steps = _steps(pred, by, ahead=True)
    first = _first_at(_roc(steps, by), by, 0.8).select(*by, F.col("bac").alias("bac80"))
    return flat.join(_areas(steps, by), by).join(first, by, "left")


def mean_std(log: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def best_of(rows: DataFrame, by: list[str], score: Column, tie: list[str]) -> DataFrame:
    """The row with the best score of each group; ties to the least `tie` columns."""
    w = Window.partitionBy(*by).orderBy(F.desc("_score"), *tie)
    return rows.withColumn("_score", score).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_score")


def top(rows: DataFrame, score: str, tie: list[str], n: int) -> DataFrame:
    return rows.orderBy(F.desc(score), *tie).limit(n)
