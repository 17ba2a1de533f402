"""Connected components of links by alternating large-star and small-star rounds, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import Stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v). Large: each neighbour above u is linked to the least of u and its neighbours. Small: the same for u and those below."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, rounds: int = 60) -> Stored:
    """links (u, v) -> node, class: the least node of its component; only nodes that have a link to another."""
    now = Stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # Done when all edges lead from a node with one edge to a node that leads nowhere.
        sides = now.df.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(now.df.select("v", F.lit(0), F.lit(1)))
        if not sides.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and `in` > 0)").limit(1).count():
            break
        new = Stored(_star(_star(now.df, True), False), "edges")
        now.drop()
        now = new
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    out = Stored(now.df.select(F.col("u").alias("node"), F.col("v").alias("class")).union(now.df.select(F.col("v"), F.col("v"))).distinct(), "classes")
    now.drop()
    return out
