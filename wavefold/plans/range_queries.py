"""Queries of order-dependent operators on whole tables, cut into many ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.learn import BoostParams
from ..operators import boosting, calibration, evaluation as E, longsignal, ranges, stats
from ..sources.views import emb_arrays, evt_signal, scores, table
from .registry import query, r, rounded
from .signal_queries import _FILTERS, iir_sql

_PREDS = "pred as (select l_returnflag as g, l_extendedprice / 200000 as y_prob, (l_partkey % 3 = 0)::int as y_true from lineitem)"
_STEPS = """per as (select g, y_prob as threshold, sum(y_true)::bigint as p, count(*) as n from pred group by all),
st as (select g, threshold, p, n, (sum(p) over w)::bigint as tps, (sum(n - p) over w)::bigint as fps, (sum(p) over (partition by g))::bigint as pos, (sum(n - p) over (partition by g))::bigint as neg,
row_number() over w as k from per window w as (partition by g order by threshold desc))"""


def _pred(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 200000).alias("y_prob"), (F.col("l_partkey") % 3 == 0).cast("int").alias("y_true"))


@query(f"""with {_PREDS}, {_STEPS}, a as (select *, (n - p) * (2 * tps - p) / 2.0 as a, tps::double / (tps + fps) as now, coalesce((tps - p)::double / nullif(tps + fps - n, 0), 1.0) as before, p::double / pos as d from st)
select g, {r('sum(a) / (max(pos)::double * max(neg))')} as auc, {r('sum(d * (now + before) / 2)')} as auprc, {r('sum(d * now)')} as ap from a group by g""")
def areas_by_ranges(spark, sf_dir):
    return rounded(E.areas(_pred(spark, sf_dir), ["g"], size=500), "auc", "auprc", "ap")


@query(f"""with {_PREDS}, {_STEPS}, bend as (select *, lead(p) over w as np, lead(n - p) over w as nm from st window w as (partition by g order by k)),
pts as (select g, threshold, tps, fps, pos, neg, k from bend where np is null or np <> p or nm <> n - p or k = 1 union all select distinct g, 'infinity'::double, 0, 0, pos, neg, 0 from st)
select g, row_number() over (partition by g order by k) - 1 as k, {r('threshold', 9)} as threshold, {r('fps::double / neg', 9)} as fpr, {r('tps::double / pos', 9)} as tpr from pts""")
def roc_by_ranges(spark, sf_dir):
    return rounded(E.roc_curve(_pred(spark, sf_dir), ["g"], size=500), "threshold", "fpr", "tpr", digits=9)


@query(f"""with {_PREDS}, per as (select g, y_prob as v, count(*) as c, sum(y_true)::bigint as c1 from pred group by all),
k as (select g, c, c1, (sum(c) over (partition by g order by v)) - (c - 1) / 2.0 as rank from per),
s as (select g, sum(c) as n, sum(c1) as n1, sum(rank * c1) as r1 from k group by g)
select g, n1::bigint as n1, (n - n1)::bigint as n0, {r('r1 - n1 * (n1 + 1) / 2.0')} as u from s""")
def rank_sums_by_ranges(spark, sf_dir):
    x = stats.mann_whitney(_pred(spark, sf_dir), ["g"], "y_prob", "y_true", size=500)
    return rounded(x.select("g", "n1", "n0", "u"), "u")


_AT = [0.0, 0.001, 0.05, 0.25, 0.5, 0.9, 0.999, 1.0]


@query(f"""with q as (select l_linestatus as g, quantile_cont(l_extendedprice, {_AT}) as q from lineitem group by all), w as (select 'all' as g, quantile_cont(l_extendedprice, {_AT}) as q from lineitem)
select g, k - 1 as k, {r('q[k]')} as q from (select * from q union all select * from w), unnest(range(1, {len(_AT) + 1})) as t(k)""")
def quantiles_by_narrowing(spark, sf_dir):
    """Of each half of the line items and of all of them."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("g"), "l_extendedprice")
    each, whole = ranges.quantiles(li, ["g"], "l_extendedprice", _AT, size=200), ranges.quantiles(li, [], "l_extendedprice", _AT, size=200)
    q = each.unionByName(whole.withColumn("g", F.lit("all"))).select("g", F.posexplode("q").alias("k", "q"))
    return rounded(q.withColumn("k", F.col("k").cast("long")), "q")


@query(f"""with p as (select o_totalprice as x, min(o_custkey)::double as lo, max(o_custkey)::double as hi from orders group by all),
a as (select l_orderkey, l_linenumber, l_extendedprice * 4 as x from lineitem),
b as (select a.*, p.x as before, p.hi as y0 from a asof left join p on a.x >= p.x),
c as (select b.*, q.x as after, q.lo as y1 from b asof left join p q on b.x <= q.x)
select l_orderkey, l_linenumber, {r('before')} as before, {r('after')} as after, {r('case when before = after then y0 else y0 + (y1 - y0) * (x - before) / (after - before) end')} as y from c""")
def asof_interpolation(spark, sf_dir):
    """Every line item among the orders next to it in price, in one order of both tables."""
    asked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 4).alias("x"))
    points = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x"), F.col("o_custkey").alias("y"))
    return rounded(ranges.interpolate_asof(asked, points, [], size=2000).select("l_orderkey", "l_linenumber", "before", "after", "y"), "before", "after", "y")


@query("""with recursive e as (select rec, ch, t, floor(v / 5) as v from evt), d as (select *, lag(v) over (partition by rec, ch order by t) as b from e),
s as (select rec, ch, t, v, b, lead(v) over w as a, lead(t) over w as ta from d where b is null or b <> v window w as (partition by rec, ch order by t)),
c as (select rec, ch, (t + ta - 1) // 2 as t, v, row_number() over (partition by rec, ch order by v desc, (t + ta - 1) // 2 desc) as k from s where b < v and a < v and v >= 8),
f as (select rec, ch, 0::bigint as k, []::bigint[] as kept from c group by all union all
select f.rec, f.ch, f.k + 1, case when len(list_filter(f.kept, lambda x: abs(x - c.t) < 4)) = 0 then list_append(f.kept, c.t) else f.kept end from f join c on c.rec = f.rec and c.ch = f.ch and c.k = f.k + 1),
o as (select rec, ch, arg_max(kept, k) as kept from f group by all)
select o.rec, o.ch, c.t, c.v from o join c using (rec, ch) where list_contains(o.kept, c.t)""", "evt")
def peaks_apart(spark, sf_dir):
    """Peaks of coarse values, flat ones among them, at least four samples apart."""
    e = evt_signal(spark, sf_dir).withColumn("v", F.floor(F.col("v") / 5))
    return longsignal.peaks(e, ["rec", "ch"], 8.0, 4)


@query(f"with recursive x as (select vec_id // 20 as rec, vec_id % 20 as ch, embedding::double[] as v from embeddings), {iir_sql('x', 'rec, ch', 'v', 64)} select rec, ch, band, {r('energy', 4)} as energy from iir_")
def iir_across_blocks(spark, sf_dir):
    """Channels cut into blocks of ten samples, filtered block by block. Narrow bands keep some seven digits, of which four places are compared."""
    cuts = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.struct(k.alias("block"), F.slice("samples", k * 10 + 1, F.lit(10)).alias("samples")))
    blocks = emb_arrays(spark, sf_dir).select("rec", "ch", F.inline(cuts))
    out = longsignal.iir_blocks(blocks, ["rec", "ch"], _FILTERS)
    energy = F.sum(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v))
    return rounded(out.groupBy("rec", "ch", "band").agg(energy.alias("energy")), "energy", digits=4)


_FIT = """per as (select lang, y_prob as x, sum(y_true)::double as s, count(*) as w from scores group by all),
o as (select *, row_number() over (partition by lang order by x) as i, (sum(s) over (partition by lang order by x)) as ts, (sum(w) over (partition by lang order by x)) as tw from per),
m as (select a.lang, a.i as a, b.i as b, (b.ts - a.ts + a.s) / (b.tw - a.tw + a.w) as m from o a join o b on a.lang = b.lang and a.i <= b.i),
low as (select lang, a, b as i, min(m) over (partition by lang, a order by b desc) as m from m),
fit as (select o.lang, o.x, max(l.m) as fit from o join low l on l.lang = o.lang and l.i = o.i and l.a <= o.i group by all)"""


@query(f"with {_FIT} select lang, {r('x', 9)} as y_prob, {r('fit')} as fit from fit", "scores")
def isotonic_fit(spark, sf_dir):
    """The fit at every score: the largest over starts of the least over ends of the mean between them."""
    s = scores(spark, sf_dir)
    blocks = calibration.isotonic(s, ["lang"], size=10)
    at = calibration.calibrated(s.select("lang", "y_prob").distinct(), blocks, ["lang"], name="fit", size=10)
    return rounded(rounded(at, "fit"), "y_prob", digits=9)


_FEATURES = ("l_quantity", "l_discount", "l_tax")


@query(f"""with d as (select (case when l_quantity > 30 then l_orderkey % 4 > 0 else l_orderkey % 4 = 0 end)::int as y, {', '.join(_FEATURES)} from lineitem),
w as (select count(*) filter (where y = 0)::double / count(*) filter (where y = 1) as w from d),
long as ({' union all '.join(f'select {k} as f, {c} as v, y from d' for k, c in enumerate(_FEATURES))}),
hist as (select f, v, sum(case when y = 1 then -0.5 * w else 0.5 end) as g, sum(case when y = 1 then 0.25 * w else 0.25 end) as h from long, w group by all),
run as (select f, v, sum(g) over o as gl, sum(h) over o as hl, sum(g) over (partition by f) as gs, sum(h) over (partition by f) as hs from hist window o as (partition by f order by v)),
gain as (select *, (gl * gl / (hl + 1) + (gs - gl) * (gs - gl) / (hs - hl + 1) - gs * gs / (hs + 1)) / 2 - 0.1 as gain from run where hl >= 1 and hs - hl >= 1),
top as (select * from gain order by gain desc, f limit 1)
select f::bigint as feature, {r('v')} as cut, {r('-0.1 * gl / (hl + 1)')} as low_value, {r('-0.1 * (gs - gl) / (hs - hl + 1)')} as high_value, {r('hl', 3)} as low_cover, {r('hs - hl', 3)} as high_cover from top""")
def boosted_first_cut(spark, sf_dir):
    """The first cut of boosting over all line items: its feature and place, and what the two sides say and hold."""
    li = table(spark, sf_dir, "lineitem")
    y = F.when(F.col("l_quantity") > 30, F.col("l_orderkey") % 4 > 0).otherwise(F.col("l_orderkey") % 4 == 0).cast("int")
    rows = li.select(F.struct("l_orderkey", "l_linenumber").cast("string").alias("id"), y.alias("y"), F.array(*_FEATURES).alias("features"))
    feature, cut, left, right, _, value, cover = boosting.fit(rows, BoostParams(trees=1, depth=1, subsample=1.0)).trees[0]
    a, b = int(left[0]), int(right[0])
    one = [(int(feature[0]), float(cut[0]), float(value[a]), float(value[b]), float(cover[a]), float(cover[b]))]
    out = spark.createDataFrame(one, "feature long, cut double, low_value double, high_value double, low_cover double, high_cover double")
    return rounded(rounded(out, "cut", "low_value", "high_value"), "low_cover", "high_cover", digits=3)
