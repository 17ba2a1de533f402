"""Order-dependent work on groups of any size: a group's rows are cut into ranges of its order, each range is worked on by
itself, and what ranges owe each other (sums before them, neighbours beyond their ends) is carried by one row a range.

A group has as many ranges as its rows ask for, MOST at most, cut at approximate quantiles, so that one group with very many rows
is many tasks. What is carried is ordered by group, but that is at most MOST rows each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources import shared

#: Rows of a range, and ranges of a group at most.
SIZE, MOST = 1_000_000, 256


def _joined(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys, nulls being equal; the other's keys go."""
    if not keys:
        return rows.crossJoin(F.broadcast(other))  # one row
    renamed = other.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return rows.join(renamed, reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]), how).drop(*(f"_r_{k}" for k in keys))


def cut(rows: DataFrame, by: list[str], order: str, descending: bool = False, size: int | None = None) -> DataFrame:
    """Adds _part, the number of the range in the group, ascending in the order; equal values are in one range, nulls in the
    first (the last, if descending). The rows are stored, as they are read for the cuts, the sums and the result, and so are the
    cuts: approximate quantiles hang on the order in which rows come, and one result must not rest on two of them."""
    size, most = size or SIZE, MOST
    rows = shared.store(rows, "ordered")
    at = F.array(*(F.lit(k / most) for k in range(1, most)))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(order, at, F.lit(10 * most)).alias("_q"))
    wanted = F.least(F.lit(most), F.ceil(F.col("_n") / size)).cast("int")
    chosen = F.when((wanted > 1) & F.col("_q").isNotNull(), F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(wanted - 1, F.lit(1))), lambda j: F.element_at("_q", (j * most / wanted).cast("int")))))
    cuts = groups.select(*by, F.coalesce(chosen, F.slice("_q", 1, 0), F.array()).alias("_cuts"))
    cuts = shared.store(cuts, "cuts")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(order)))
    return _joined(rows, cuts, by).withColumn("_part", -below if descending else below).drop("_cuts")


def running(parted: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column], ahead: dict[str, str] | None = None, behind: dict[str, str] | None = None) -> DataFrame:
    """parted: rows of `cut`. Adds each name of `sums`, the sum of its column up to the row, and `{name}_all`, that of the whole
    group; each name of `ahead` and `behind`, the next and the previous row's value of a column (null at the ends)."""
    ahead, behind = ahead or {}, behind or {}
    keys, inner = [*by, "_part"], Window.partitionBy(*by, "_part").orderBy(*order)
    ranked = parted.withColumn("_k", F.row_number().over(inner)) if ahead or behind else parted
    ends = [F.min_by(F.struct(F.col(c).alias("v")), "_k").alias(f"_f_{n}") for n, c in ahead.items()] + [F.max_by(F.struct(F.col(c).alias("v")), "_k").alias(f"_l_{n}") for n, c in behind.items()]
    totals = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), *(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()), *ends)
    along, whole = Window.partitionBy(*by).orderBy("_part"), Window.partitionBy(*by)  # MOST rows at most
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums), *(F.sum(f"_s_{n}").over(whole).alias(f"{n}_all") for n in sums),
        *(F.lead(f"_f_{n}").over(along).alias(f"_a_{n}") for n in ahead), *(F.lag(f"_l_{n}").over(along).alias(f"_b_{n}") for n in behind),
    )
    x = _joined(ranked, carried, keys)
    made = {n: F.sum(c).over(inner) + F.col(f"_o_{n}") for n, c in sums.items()}
    made |= {n: F.coalesce(F.lead(F.struct(F.col(c).alias("v"))).over(inner), F.col(f"_a_{n}"))["v"] for n, c in ahead.items()}
    made |= {n: F.coalesce(F.lag(F.struct(F.col(c).alias("v"))).over(inner), F.col(f"_b_{n}"))["v"] for n, c in behind.items()}
    return x.withColumns(made).drop("_k", *(f"_o_{n}" for n in sums), *(f"_a_{n}" for n in ahead), *(f"_b_{n}" for n in behind))


def quantiles(values: DataFrame, by: list[str], value: str, at: list[float], size: int | None = None) -> DataFrame:
    """by, q: the exact quantiles of each group's values at `at`, linear between neighbours; nulls don't count, and groups
    without a value aren't there.

    Each distinct value is one row with its count. Ranges are counted, those that hold a rank that is asked for are
    kept, and these are cut again, until each has no more than `size` values (SIZE, if none is given); only they are put in
    order.
    """
    size = size or SIZE
    rows = shared.store(values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_w")), "values")
    sizes = rows.groupBy(*by).agg(F.sum("_w").alias("_n"))
    place = (F.col("_n") - 1) * F.col("_p")
    asked = sizes.select(*by, "_n", F.posexplode(F.array(*map(F.lit, at))).alias("_i", "_p")).select(*by, "_i", place.alias("_x"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("_r")).distinct()
    ranks, cells = asked.select(*by, "_r", F.col("_r").alias("_own")).distinct(), list(by)
    while (rows.groupBy(*cells).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > size:
        parted = cut(rows, cells, "_v", size=size)
        counts = parted.groupBy(*cells, "_part").agg(F.sum("_w").alias("_c"))
        upto = Window.partitionBy(*cells).orderBy("_part")  # MOST rows at most
        spans = counts.withColumn("_hi", F.sum("_c").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_c"))
        held = _joined(spans, ranks, cells).where("_r >= _lo and _r < _hi")
        name = f"_cell{len(cells)}"
        ranks = held.select(*cells, F.col("_part").alias(name), (F.col("_r") - F.col("_lo")).alias("_r"), "_own")
        ranks = shared.store(ranks, "ranks")
        rows = shared.store(_joined(parted, ranks.select(*cells, F.col(name).alias("_part")).distinct(), [*cells, "_part"]).withColumnRenamed("_part", name), "kept")
        cells.append(name)
    own = Window.partitionBy(*cells).orderBy("_v")  # `size` rows at most
    spans = rows.withColumn("_hi", F.sum("_w").over(own)).withColumn("_lo", F.col("_hi") - F.col("_w"))
    found = _joined(spans, ranks, cells).where("_r >= _lo and _r < _hi").select(*by, F.col("_own").alias("_r"), "_v")
    met = _joined(asked, found, [*by, "_r"])
    low, high = F.min_by("_v", "_r"), F.max_by("_v", "_r")
    each = met.groupBy(*by, "_i", "_x").agg(low.alias("_a"), high.alias("_b"))
    made = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.floor("_x")))
    return each.withColumn("_q", made).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_l")).select(*by, F.transform("_l", lambda s: s["_q"]).alias("q"))


def interpolate_asof(asked: DataFrame, points: DataFrame, by: list[str], x: str = "x", y: str = "y", hold: bool = False, size: int | None = None) -> DataFrame:
    """asked (by, x, ...) with `y` and `before`, `after` (the last point's x at or before the row's, and the next one's at or
    after): y linear between those two; beyond the first and the last point null, or, to `hold`, the end's y.

    Rows and points are put in one order and cut into ranges; the last point before a range and the first one after it are
    carried to it, so no point is paired with more than the rows it is next to, and no group is one task. Of points
    of one place the last y stands for what follows and the least for what comes before. Points without x or y don't
    count; rows without x have no y. Null keys are equal.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.min(F.col(y).cast("double")).alias("_lo"), F.max(F.col(y).cast("double")).alias("_hi"))
    rows = asked.select(*by, F.col(x).cast("double").alias("_x"), F.struct(*asked.columns).alias("_row"))
    kind = rows.schema["_row"].dataType
    both = rows.select(*by, "_x", "_row", F.lit(None).cast("struct<x:double,lo:double,hi:double>").alias("_p")).unionByName(known.select(*by, "_x", F.lit(None).cast(kind).alias("_row"), F.struct(F.col("_x").alias("x"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi")).alias("_p")))
    parted = cut(both, by, "_x", size=size)
    keys = [*by, "_part"]
    ends = parted.groupBy(*keys).agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    along = Window.partitionBy(*by).orderBy("_part")  # MOST rows at most
    carried = ends.select(*keys, F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"), F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_next"))
    inner = Window.partitionBy(*keys).orderBy("_x")
    down, up = inner.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys).orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
    met = _joined(parted, carried, keys).withColumn("_a", F.coalesce(F.max("_p").over(down), F.col("_prev"))).withColumn("_b", F.coalesce(F.min("_p").over(up), F.col("_next"))).where("_row is not null")
    met = met.withColumns({c: F.when(F.col("_x").isNotNull(), F.col(c)) for c in ("_a", "_b")})
    share = (F.col("_x") - F.col("_a.x")) / (F.col("_b.x") - F.col("_a.x"))
    inside = F.when(F.col("_a.x") == F.col("_b.x"), F.col("_a.hi")).otherwise(F.col("_a.hi") + (F.col("_b.lo") - F.col("_a.hi")) * share)
    value = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), inside)
    if hold:
        value = F.coalesce(value, F.col("_a.hi"), F.col("_b.lo"))
    return met.select("_row.*", value.alias(y), F.col("_a.x").alias("before"), F.col("_b.x").alias("after"))
