"""Graph operators on an edge list (keys, i, j, w) of undirected links i > j, in joins and aggregates.

`both` turns links into directed pairs; everything after it is an equi-join on the graph's keys and a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def normalise(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Weights without NaN and infinity, over the graph's largest absolute weight; zero links go."""
    w = F.when(F.isnan("w") | (F.abs("w") == float("inf")), 0.0).otherwise(F.coalesce("w", F.lit(0.0)))
    top = F.max(F.abs("w")).over(Window.partitionBy(*keys))
    return edges.withColumn("w", w).withColumn("w", F.try_divide(F.col("w"), top)).where("w <> 0")


def both(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, u, v, w in both directions."""
    return edges.select(*keys, F.explode(F.array(F.struct(F.col("i").alias("u"), F.col("j").alias("v")), F.struct(F.col("j").alias("u"), F.col("i").alias("v")))).alias("_p"), "w").select(*keys, "_p.u", "_p.v", "w")


def degree_strength(edges: DataFrame, keys: list[str]) -> DataFrame:
    return both(edges, keys).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted clustering coefficient of each node: cube roots of its triangles' weights over the pairs of neighbours."""
    e = edges.select(*keys, "i", "j", F.cbrt("w").alias("c"))
    # Triangles i > j > k once each.
    ab = e.toDF(*keys, "a", "b", "c1")
    bc = e.toDF(*keys, "b", "d", "c2")
    ac = e.toDF(*keys, "a", "d", "c3")
    tri = ab.join(bc, [*keys, "b"]).join(ac, [*keys, "a", "d"]).select(*keys, F.explode(F.array("a", "b", "d")).alias("u"), (F.col("c1") * F.col("c2") * F.col("c3")).alias("c"))
    sums = tri.groupBy(*keys, "u").agg(F.sum("c").alias("c"))
    k = degree_strength(edges, keys)
    value = F.coalesce(F.try_divide(2 * F.col("c"), (F.col("degree") * (F.col("degree") - 1)).cast("double")), F.lit(0.0))
    return k.join(sums, [*keys, "u"], "left").select(*keys, "u", "degree", F.coalesce("c", F.lit(0.0)).alias("triangles"), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("clustering"))


def transitivity(edges: DataFrame, keys: list[str]) -> DataFrame:
    c = clustering(edges, keys)
    return c.groupBy(*keys).agg(F.coalesce(F.try_divide(2 * F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1)).cast("double")), F.lit(0.0)).alias("transitivity"))


def matching(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of each pair of nodes with a common neighbour: the share of their other links that go to the same nodes."""
    d = both(edges, keys)
    k = d.groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("k"))
    a, b = d.select(*keys, F.col("u").alias("a"), "v"), d.select(*keys, F.col("u").alias("b"), "v")
    common = a.join(b, [*keys, "v"]).where("a > b").groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    linked = edges.select(*keys, F.col("i").alias("a"), F.col("j").alias("b"), F.lit(2).alias("_l"))
    out = common.join(linked, [*keys, "a", "b"], "left").join(k.toDF(*keys, "a", "ka"), [*keys, "a"]).join(k.toDF(*keys, "b", "kb"), [*keys, "b"])
    return out.select(*keys, "a", "b", F.coalesce(F.try_divide(2 * F.col("n"), F.col("ka") + F.col("kb") - F.coalesce("_l", F.lit(0))), F.lit(0.0)).alias("matching"))


def assortativity(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of the strengths at the ends of links."""
    s = degree_strength(edges, keys).select(*keys, "u", "strength")
    e = edges.join(s.toDF(*keys, "i", "a"), [*keys, "i"]).join(s.toDF(*keys, "j", "b"), [*keys, "j"])
    m = e.groupBy(*keys).agg(F.avg(F.col("a") * F.col("b")).alias("p"), F.avg((F.col("a") + F.col("b")) / 2).alias("m"), F.avg((F.col("a") ** 2 + F.col("b") ** 2) / 2).alias("q"))
    return m.select(*keys, F.try_divide(F.col("p") - F.col("m") ** 2, F.col("q") - F.col("m") ** 2).alias("assortativity"))


def edge_overlap(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Means over links: share of common neighbours of the ends, and degree of the ends."""
    d, k = both(edges, keys), degree_strength(edges, keys)
    e = edges.select(*keys, "i", "j")
    common = e.join(d.select(*keys, F.col("u").alias("i"), "v"), [*keys, "i"]).join(d.select(*keys, F.col("u").alias("j"), "v"), [*keys, "j", "v"]).groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    deg = k.select(*keys, "u", "degree")
    x = e.join(common, [*keys, "i", "j"], "left").join(deg.toDF(*keys, "i", "di"), [*keys, "i"]).join(deg.toDF(*keys, "j", "dj"), [*keys, "j"])
    n = F.coalesce("n", F.lit(0))
    return x.groupBy(*keys).agg(F.avg(F.coalesce(F.try_divide(n.cast("double"), F.col("di") + F.col("dj") - 2 - n), F.lit(0.0))).alias("overlap"), F.avg((F.col("di") + F.col("dj")) / 2.0).alias("pair_degree"))


def participation(edges: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """communities (keys, u, c): 1 - sum of squared shares of a node's strength over communities, and their entropy by log of their number."""
    d = both(edges, keys).join(communities.toDF(*keys, "v", "c"), [*keys, "v"])
    kinds = communities.groupBy(*keys).agg(F.countDistinct("c").alias("_m"))
    per = d.groupBy(*keys, "u", "c").agg(F.sum("w").alias("s"))
    p = F.col("s") / F.sum("s").over(Window.partitionBy(*keys, "u"))
    return per.withColumn("p", p).join(kinds, keys).groupBy(*keys, "u").agg((1 - F.sum(F.col("p") ** 2)).alias("participation"), F.coalesce(F.try_divide(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)), F.ln(F.first("_m").cast("double"))), F.lit(0.0)).alias("diversity"))
