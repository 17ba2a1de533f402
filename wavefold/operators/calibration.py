"""Isotonic calibration of scores as an aggregate that merges.

The least-squares non-decreasing fit has the slopes of the lower convex hull of the points (weight so far, sum so far) in the
order of scores. A hull of hulls is the hull of all, so each range of scores (see `ranges`) gives up what is inside its own
hull, and what is left of a group's ranges, far fewer points than it has scores, is put together once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ranges


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the corners of the lower convex hull of points with ascending x; the first and last are among them.

    Points above the line between their neighbours go, all at once again and again while many do, then one by one.
    """
    at = np.arange(len(x))
    while len(at) > 2:
        a, b, c = at[:-2], at[1:-1], at[2:]
        keep = np.ones(len(at), bool)
        keep[1:-1] = (y[b] - y[a]) * (x[c] - x[b]) < (y[c] - y[b]) * (x[b] - x[a])
        # Of neighbours that would both go, every other one waits for the next round.
        out = np.flatnonzero(~keep)
        runs = np.cumsum(np.concatenate([[0], np.diff(out) != 1])) if len(out) else out
        keep[out] = (out - out[np.searchsorted(runs, runs)]) % 2 == 1 if len(out) else False
        if keep.all():
            break
        at = at[keep]
    return at


def isotonic(pred: DataFrame, by: list[str], x: str = "y_prob", y: str = "y_true", size: int | None = None) -> DataFrame:
    """by, block, low, high, value, weight: the blocks of the non-decreasing fit of y over x in each group, by ascending
    scores from `low` to `high`, with the fit's value and the rows there. Rows without x or y don't count; NaN is the greatest score."""
    per = pred.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_w"), F.sum(F.col(y).cast("double")).alias("_s"))
    sums = ranges.running(ranges.cut(per, by, "_x", size=size), by, [F.asc("_x")], {"_tw": F.col("_w"), "_ts": F.col("_s")}, ahead={"_next": "_x"}, behind={"_before": "_x"})
    # Each score is the step between two points; the one before the first score is the origin. `_next` is the score that a block
    # after the point begins with.
    origin = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("x"), F.col("_x").alias("next"))
    own = F.struct(F.col("_tw").cast("double").alias("w"), F.col("_ts").alias("s"), F.col("_x").alias("x"), F.col("_next").alias("next"))
    points = sums.select(*by, "_part", F.explode(F.when(F.col("_before").isNull(), F.array(origin, own)).otherwise(F.array(own))).alias("p")).select(*by, "_part", "p.*")
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in by)
    head = f"{kinds}, " if by else ""

    def corners(table: pa.Table) -> pa.Table:
        table = table.sort_by("w")
        return table.take(pa.array(lower_hull(np.asarray(table["w"]), np.asarray(table["s"]))))

    def blocks(table: pa.Table) -> pa.Table:
        table = corners(table)
        w, s = np.asarray(table["w"]), np.asarray(table["s"])
        n = len(w) - 1
        made = {c: table[c].slice(1) for c in by}
        return pa.table(made | {"block": np.arange(n), "low": table["next"].slice(0, n), "high": table["x"].slice(1), "value": np.diff(s) / np.diff(w), "weight": np.diff(w).astype(np.int64)})

    kept = points.groupBy(*by, "_part").applyInArrow(corners, f"{head}_part int, w double, s double, x double, next double")
    return kept.drop("_part").groupBy(*by).applyInArrow(blocks, f"{head}block long, low double, high double, value double, weight long")


def calibrated(scores: DataFrame, blocks: DataFrame, by: list[str], x: str = "y_prob", name: str = "calibrated", size: int | None = None) -> DataFrame:
    """scores with `name`: the fit at their x, linear between blocks and constant beyond the ends; null without x or blocks."""
    points = blocks.select(*by, F.explode(F.array("low", "high")).alias(x), F.col("value").alias(name)).distinct()
    return ranges.interpolate_asof(scores, points, by, x, name, hold=True, size=size).drop("before", "after")
