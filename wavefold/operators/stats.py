"""Rank tests, quantile bins and accumulated local effects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.learn import t_quantile
from ..sources import shared
from . import ranges


def two_sided(z: Column | str) -> Column:
    """p-value of a standard normal: erfc(|z| / sqrt 2), by its series near 0 and its continued fraction beyond."""
    x = F.abs(F.col(z) if isinstance(z, str) else z) / F.lit(2.0**0.5)
    terms = F.sequence(F.lit(1), F.lit(90))
    # erf x = 2 / sqrt pi * x exp(-x^2) * sum of (2 x^2)^n / (1 3 5 ... (2n + 1)); all terms are positive
    near = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, n: F.struct((a.t * 2 * x * x / (2 * n + 1)).alias("t"), (a.s + a.t * 2 * x * x / (2 * n + 1)).alias("s")), lambda a: a.s)
    far = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, n: x + n / 2.0 / a)
    root = F.lit(3.141592653589793**0.5)
    return F.when(x < 3, 1 - 2 / root * x * F.exp(-x * x) * near).otherwise(F.exp(-x * x) / root / far)


def mann_whitney(values: DataFrame, by: list[str], value: str = "v", label: str = "y", least: int = 10, least_each: int = 3, size: int | None = None) -> DataFrame:
    """by, n1, n0, u, z: U of label 1 by average ranks, z with tie and continuity correction; groups that are too small
    are left out. One row for each distinct value is ranked, so ties cost nothing, and ranks are counted range by range."""
    x = values.where(F.col(value).isNotNull() & ~F.isnan(value))
    per = x.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col(label) == 1).alias("c1"))
    x = ranges.running(ranges.cut(per, by, value, size=size), by, [F.asc(value)], {"n": F.col("c"), "n1": F.col("c1")})
    r = x.select(*by, "c", "c1", (F.col("n") - (F.col("c") - 1) / 2.0).alias("rank"), F.col("n_all").alias("n"), F.col("n1_all").alias("n1"))
    s = r.groupBy(*by, "n", "n1").agg(F.sum(F.col("rank") * F.col("c1")).alias("r1"), F.sum((F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double")).alias("ties"))
    n1, n0, n = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double"), F.col("n").cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    s = s.where((F.col("n") >= least) & (F.col("n1") >= least_each) & (F.col("n") - F.col("n1") >= least_each)).withColumn("u", u)
    big = F.greatest("u", n1 * n0 - F.col("u"))
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(*by, F.col("n1"), (F.col("n") - F.col("n1")).alias("n0"), "u", F.try_divide(big - n1 * n0 / 2 - 0.5, sd).alias("z"))


def bonferroni(tests: DataFrame, p: str = "p") -> DataFrame:
    """Adds p_adjusted = min(1, p times the number of tests); the number is one aggregated row."""
    n = tests.where(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("_n"))
    return tests.crossJoin(F.broadcast(n)).withColumn("p_adjusted", F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")


def quantile_edges(values: DataFrame, by: list[str], value: str = "v", bins: int = 20) -> DataFrame:
    """by, k, edge: the distinct exact quantiles at 0, 1/bins, ... 1."""
    q = ranges.quantiles(values, by, value, [k / bins for k in range(bins + 1)]).select(*by, F.array_sort(F.array_distinct("q")).alias("e"))
    return q.select(*by, F.posexplode("e").alias("k", "edge")).withColumn("k", F.col("k").cast("long"))


def percentile_range(values: DataFrame, by: list[str], value: str = "v", low: float = 0.05, high: float = 0.95) -> DataFrame:
    return ranges.quantiles(values, by, value, [low, high]).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def to_bins(values: DataFrame, edges: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Adds bin: half-open between edges, the last one closed. The edges of a group travel as one short array."""
    e = edges.groupBy(*by).agg(F.array_sort(F.collect_list("edge")).alias("_e"))
    at = F.size(F.filter("_e", lambda x: x <= F.col(value))) - 1
    return values.join(e, by).withColumn("bin", F.least(at, F.size("_e") - 2).cast("long")).drop("_e")


def weighted_mean(x: Column, w: Column) -> Column:
    return F.try_divide(F.sum(x * w), F.sum(w))


def accumulate(effects: DataFrame, by: list[str]) -> DataFrame:
    """effects (by, bin, effect, n): running sum over bins, centred by its mean weighted with n."""
    w = Window.partitionBy(*by).orderBy("bin")
    run = effects.withColumn("_a", F.sum("effect").over(w))
    mean = F.sum(F.col("_a") * F.col("n")).over(Window.partitionBy(*by)) / F.sum("n").over(Window.partitionBy(*by))
    return run.withColumn("ale", F.col("_a") - mean).drop("_a")


def interpolate(curves: DataFrame, curve: list[str], grid: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Every curve (keys, x, y) at every point of its grid, an array expression over the keys, linearly; null outside the
    curve's range. A curve's points, as many as it has bins, travel as one array, so nothing is joined."""
    points = curves.where(F.col(y).isNotNull()).groupBy(*curve).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"))
    asked = points.select(*curve, "_p", F.explode(grid).alias(x))
    a = F.element_at(F.filter("_p", lambda p: p.x <= F.col(x)), -1)
    z = asked.withColumn("_a", F.when(F.exists("_p", lambda p: p.x <= F.col(x)), a)).withColumn("_b", F.try_element_at(F.filter("_p", lambda p: p.x >= F.col(x)), F.lit(1)))
    at = F.when(F.col("_a.x") == F.col(x), F.col("_a.y")).otherwise(F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * F.try_divide(F.col(x) - F.col("_a.x"), F.col("_b.x") - F.col("_a.x")))
    return z.select(*curve, x, at.alias(y))


@F.pandas_udf(DoubleType())
def _t(n: pd.Series, level: pd.Series) -> pd.Series:
    """Student's t for n values; a number of folds repeats often, so each is worked out once a batch."""
    known = {(k, p): t_quantile(p, k - 1) for k, p in set(zip(n, level, strict=True)) if k > 1}
    return pd.Series([known.get((k, p)) for k, p in zip(n, level, strict=True)], dtype="float64")


def interval(values: DataFrame, by: list[str], value: str, level: float = 0.975, weight: str | None = None) -> DataFrame:
    """Count, mean (weighted, if asked for), deviation and t-based confidence limits over folds; none for a single fold."""
    mean = F.avg(value) if weight is None else weighted_mean(F.col(value), F.when(F.col(value).isNotNull(), F.col(weight)))
    s = values.groupBy(*by).agg(F.count(value).alias("n"), mean.alias("mean"), F.stddev_samp(value).alias("std"))
    half = _t("n", F.lit(level)) * F.col("std") / F.sqrt(F.col("n"))
    return s.select(*by, "n", "mean", "std", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def aggregate_effects(effects: DataFrame, by: list[str], points: int = 100, folds: int = 3) -> DataFrame:
    """effects (by, fold, x, y, n): of each feature that at least `folds` folds know, the folds' curves on a common grid from
    the least to the largest x, their mean weighted with each fold's rows, deviation and limits. Effects are stored, as they
    are read three times and a fold's model is behind them."""
    known = shared.store(effects.where("y is not null"), "effects")
    ends = known.groupBy(*by).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.countDistinct("fold").alias("_f")).where(F.col("_f") >= folds).drop("_f")
    weights = known.groupBy(*by, "fold").agg(F.sum("n").alias("weight"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / (points - 1))
    curves = interpolate(known.join(ends, by), [*by, "fold", "_lo", "_hi"], grid)
    return interval(curves.where("y is not null").join(weights, [*by, "fold"]), [*by, "x"], "y", weight="weight")
