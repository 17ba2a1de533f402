"""Queries of the evaluation and statistics operators over the score, run-log and signal views."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..functions.learn import t_quantile
from ..operators import evaluation as E, stats
from ..sources.views import emb_signal, run_log, scores
from .registry import query, r, rounded

_CONF = """with c as (select lang, count(*) filter (where y_prob >= 0.1 and y_true = 1) as tp, count(*) filter (where y_prob >= 0.1 and y_true = 0) as fp,
count(*) filter (where y_prob < 0.1 and y_true = 0) as tn, count(*) filter (where y_prob < 0.1 and y_true = 1) as fn from scores group by lang)"""


def _div(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif({b}, 0), 0)"


@query(f"""{_CONF} select lang, tp, fp, tn, fn, {r(_div('tp + tn', 'tp + fp + tn + fn'))} as accuracy, {r(_div('tp', 'tp + fp'))} as precision, {r(_div('tp', 'tp + fn'))} as recall,
{r(_div('2 * tp', '2 * tp + fp + fn'))} as f1_score, {r(f"({_div('tp', 'tp + fn')} + {_div('tn', 'tn + fp')}) / 2")} as bac from c""", "scores")
def confusion_metrics(spark: SparkSession, sf_dir: str):
    return rounded(E.confusion(scores(spark, sf_dir), ["lang"], 0.1), "accuracy", "precision", "recall", "f1_score", "bac")


_STEPS = """per as (select lang, y_prob as threshold, sum(y_true)::bigint as p, count(*) as n from scores group by all),
st as (select lang, threshold, (sum(p) over w)::bigint as tps, (sum(n - p) over w)::bigint as fps, (sum(p) over (partition by lang))::bigint as pos, (sum(n - p) over (partition by lang))::bigint as neg,
row_number() over w as k from per window w as (partition by lang order by threshold desc))"""
_ROC = f"""{_STEPS},
bend as (select *, lead(tps) over w - 2 * tps + coalesce(lag(tps) over w, 0) as bt, lead(fps) over w - 2 * fps + coalesce(lag(fps) over w, 0) as bf from st window w as (partition by lang order by k)),
pts as (select lang, threshold, tps, fps, pos, neg, k from bend where bt is null or bt <> 0 or bf <> 0 or k = 1 union all select distinct lang, 'infinity'::double, 0, 0, pos, neg, 0 from st),
roc as (select lang, row_number() over (partition by lang order by k) - 1 as k, threshold, fps::double / nullif(neg, 0) as fpr, tps::double / nullif(pos, 0) as tpr from pts)"""


@query(f"with {_ROC} select lang, k, {r('threshold')} as threshold, {r('fpr')} as fpr, {r('tpr')} as tpr from roc ", "scores")
def roc_curve(spark, sf_dir):
    return rounded(E.roc_curve(scores(spark, sf_dir), ["lang"]), "threshold", "fpr", "tpr")


@query(f"""with {_STEPS}, a as (select *, (fps - coalesce(lag(fps) over w, 0)) * (tps + coalesce(lag(tps) over w, 0)) / 2.0 as a from st window w as (partition by lang order by k))
select lang, {r('sum(a) / nullif(max(pos) * max(neg), 0)')} as auc from a group by lang""", "scores")
def roc_auc(spark, sf_dir):
    return rounded(E.roc_auc(scores(spark, sf_dir), ["lang"]), "auc")


_PR = f"""with {_STEPS}, pr as (select *, tps::double / (tps + fps) as p, tps::double / nullif(pos, 0) as rec from st),
s as (select lang, (rec - coalesce(lag(rec) over w, 0)) as d, p, coalesce(lag(p) over w, 1.0) as q from pr window w as (partition by lang order by k))"""


@query(f"{_PR} select lang, {r('sum(d * (p + q) / 2)')} as auprc from s group by lang", "scores")
def pr_auc(spark, sf_dir):
    return rounded(E.pr_areas(scores(spark, sf_dir), ["lang"]).select("lang", "auprc"), "auprc")


@query(f"{_PR} select lang, {r('sum(d * p)')} as ap from s group by lang", "scores")
def average_precision(spark, sf_dir):
    return rounded(E.pr_areas(scores(spark, sf_dir), ["lang"]).select("lang", "ap"), "ap")


@query(f"with {_ROC}, f as (select *, row_number() over (partition by lang order by k) as o from roc where tpr >= 0.8) select lang, {r('threshold')} as threshold, {r('(tpr + 1 - fpr) / 2')} as bac from f where o = 1", "scores")
def bac80(spark, sf_dir):
    return rounded(E.bac_at_sensitivity(scores(spark, sf_dir), ["lang"]), "threshold", "bac")


@query(f"""with {_ROC}, g as (select *, round(sqrt(tpr * (1 - fpr)), 12) as g from roc), f as (select *, row_number() over (partition by lang order by g desc, k) as o from g)
select lang, {r('threshold')} as threshold, {r('g')} as gmean from f where o = 1""", "scores")
def optimal_threshold(spark, sf_dir):
    return rounded(E.optimal_threshold(scores(spark, sf_dir), ["lang"]), "threshold", "gmean")


@query(f"with p as (select source, avg(y_true::double) as prior from scores group by source) select source, {r('prior')} as prior, {r('0.3 * (1 - prior) / nullif(prior * 0.7, 0)')} as slope from p", "scores")
def posterior_slope(spark, sf_dir):
    return rounded(E.posterior_slope(scores(spark, sf_dir), ["source"], 0.3), "prior", "slope")


@query(f"select source, {r('coalesce(count(*) filter (where y_true = 0)::double / nullif(count(*) filter (where y_true = 1), 0), 1)')} as weight from scores group by source", "scores")
def class_weight(spark, sf_dir):
    return rounded(E.class_weight(scores(spark, sf_dir), ["source"]), "weight")


@query(f"""with {_ROC}, c as (select lang, fpr, max(tpr) as hi, min(tpr) as lo from roc where fpr is not null and tpr is not null group by all),
g as (select distinct fpr from c), ids as (select distinct lang from c),
x as (select g.fpr, ids.lang, (select max(c.fpr) from c where c.lang = ids.lang and c.fpr <= g.fpr) as a, (select min(c.fpr) from c where c.lang = ids.lang and c.fpr >= g.fpr) as b from g, ids),
y as (select x.fpr, case when x.a = x.b then p.hi else p.hi + (q.lo - p.hi) * (x.fpr - x.a) / (x.b - x.a) end as tpr from x join c p on p.lang = x.lang and p.fpr = x.a join c q on q.lang = x.lang and q.fpr = x.b)
select {r('fpr')} as fpr, {r('avg(tpr)')} as tpr from y group by y.fpr""", "scores")
def vertical_avg_roc(spark, sf_dir):
    return rounded(E.vertical_average(E.roc_curve(scores(spark, sf_dir), ["lang"]), "lang"), "fpr", "tpr")


@query(f"select family, montage, length, {r('avg(auc)')} as auc_mean, {r('stddev_samp(auc)')} as auc_std, {r('avg(auprc)')} as auprc_mean, {r('stddev_samp(auprc)')} as auprc_std from runs group by all", "runs")
def run_mean_std(spark, sf_dir):
    return rounded(E.mean_std(run_log(spark, sf_dir), ["family", "montage", "length"], ["auc", "auprc"]), "auc_mean", "auc_std", "auprc_mean", "auprc_std")


_RUN_MEANS = f"m as (select family, montage, length, {r('avg(auc)')} as auc_mean, {r('avg(auprc)')} as auprc_mean from runs group by all)"


def _run_means(spark, sf_dir):
    m = E.mean_std(run_log(spark, sf_dir), ["family", "montage", "length"], ["auc", "auprc"])
    return rounded(m.select("family", "montage", "length", "auc_mean", "auprc_mean"), "auc_mean", "auprc_mean")


@query(f"with {_RUN_MEANS}, k as (select *, row_number() over (partition by family order by round(auc_mean + auprc_mean, 6) desc, montage, length) as k from m) select family, montage, length, auc_mean, auprc_mean from k where k = 1", "runs")
def best_config_per_family(spark, sf_dir):
    return E.best_of(_run_means(spark, sf_dir), ["family"], F.round(F.col("auc_mean") + F.col("auprc_mean"), 6), ["montage", "length"])


@query(f"with {_RUN_MEANS}, k as (select *, row_number() over (partition by length order by round(auc_mean + auprc_mean, 6) desc, family, montage) as k from m) select family, montage, length, auc_mean, auprc_mean from k where k = 1", "runs")
def best_combo_per_length(spark, sf_dir):
    return E.best_of(_run_means(spark, sf_dir), ["length"], F.round(F.col("auc_mean") + F.col("auprc_mean"), 6), ["family", "montage"])


@query("select run, family, montage, length, auc from (select *, row_number() over (order by auc desc, run, length) as k from runs) where k <= 10", "runs")
def topk(spark, sf_dir):
    return E.top(run_log(spark, sf_dir).select("run", "family", "montage", "length", "auc"), "auc", ["run", "length"], 10)


# Statistics: feature of a recording and channel = its energy, label = parity of the recording

_FEAT = "feat as (select rec, ch, rec % 2 as y, sum(v * v) as x, round(sum(v), 2) as v from sig group by all)"


def _features(spark, sf_dir):
    return emb_signal(spark, sf_dir).groupBy("rec", "ch").agg(F.round(F.sum("v"), 2).alias("v")).withColumn("y", F.col("rec") % 2)


_MW = f"""with {_FEAT}, per as (select ch, v, count(*) as c, count(*) filter (where y = 1) as c1 from feat group by all),
k as (select *, sum(c) over (partition by ch order by v) - (c - 1) / 2.0 as rank from per),
s as (select ch, sum(c)::double as n, sum(c1)::double as n1, sum(rank * c1) as r1, sum(power(c, 3) - c) as ties from k group by ch),
u as (select ch, n, n1, n - n1 as n0, r1 - n1 * (n1 + 1) / 2 as u, ties from s where n >= 10 and n1 >= 3 and n - n1 >= 3)"""
_Z = "(greatest(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / nullif(sqrt(n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))), 0)"


@query(f"{_MW} select ch, n1::bigint as n1, n0::bigint as n0, {r('u')} as u, {r(_Z)} as z from u", "sig")
def mann_whitney_u(spark, sf_dir):
    return rounded(stats.mann_whitney(_features(spark, sf_dir), ["ch"]), "u", "z")


_P = """1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n: case when n % 2 = 0 then 1 else -1 end * exp((2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - lgamma(n + 1)) / (2 * n + 1)))"""


@query(f"""{_MW}, z as (select ch, n1::bigint as n1, n0::bigint as n0, u, {_Z} as z from u), p as (select *, {_P} as p from z)
select ch, n1, n0, {r('u')} as u, {r('z')} as z, {r('p')} as p, {r('least(1.0, p * (select count(*) from p))')} as p_adjusted from p order by p.p, ch limit 5""", "sig")
def mann_whitney_p(spark, sf_dir):
    t = stats.mann_whitney(_features(spark, sf_dir), ["ch"]).withColumn("p", stats.two_sided("z"))
    return rounded(stats.bonferroni(t).orderBy("p", "ch").limit(5), "u", "z", "p", "p_adjusted")


@query(f"""{_MW}, p as (select ch, {r(f'1 / (1 + abs({_Z}))')} as p from u) select ch, p, {r('least(1.0, p * (select count(*) from p))')} as p_adjusted from p order by p, ch limit 5""", "sig")
def bonferroni_topn(spark, sf_dir):
    """The correction on a stand-in p that SQL knows: 1 / (1 + |z|)."""
    t = stats.mann_whitney(_features(spark, sf_dir), ["ch"]).select("ch", (1 / (1 + F.abs("z"))).alias("p"))
    return rounded(stats.bonferroni(rounded(t, "p")), "p_adjusted").orderBy("p", "ch").limit(5)


_EDGE = "q as (select ch, unnest(list_sort(list_distinct(quantile_cont(v, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1])))) as edge from sig group by ch)"


@query(f"with {_EDGE} select ch, row_number() over (partition by ch order by edge) - 1 as k, {r('edge')} as edge from q", "sig")
def quantile_edges(spark, sf_dir):
    return rounded(stats.quantile_edges(emb_signal(spark, sf_dir), ["ch"]), "edge")


@query(f"select ch, {r('quantile_cont(v, 0.05)')} as low, {r('quantile_cont(v, 0.95)')} as high from sig group by ch", "sig")
def percentile_range(spark, sf_dir):
    return rounded(stats.percentile_range(emb_signal(spark, sf_dir), ["ch"]), "low", "high")


_QUARTERS = "q as (select ch, quantile_cont(v, [0, 0.25, 0.5, 0.75, 1]) as e from sig group by ch), b as (select sig.*, least(len(list_filter(e, lambda x: x <= v)) - 1, 3)::bigint as bin from sig join q using (ch))"


@query(f"with {_QUARTERS} select ch, bin, count(*) as n, {r('avg(v)')} as mean from b group by all", "sig")
def ale_bins(spark, sf_dir):
    s = emb_signal(spark, sf_dir)
    b = stats.to_bins(s, stats.quantile_edges(s, ["ch"], bins=4), ["ch"])
    return rounded(b.groupBy("ch", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")), "mean")


@query(f"""with {_QUARTERS}, f as (select ch, bin, count(*) as n, avg(v) as effect from b group by all), a as (select *, sum(effect) over (partition by ch order by bin) as a from f)
select ch, bin, n, {r('effect')} as effect, {r('a - sum(a * n) over (partition by ch) / sum(n) over (partition by ch)')} as ale from a""", "sig")
def ale_accumulate(spark, sf_dir):
    s = emb_signal(spark, sf_dir)
    b = stats.to_bins(s, stats.quantile_edges(s, ["ch"], bins=4), ["ch"]).groupBy("ch", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("effect"))
    return rounded(stats.accumulate(b, ["ch"]), "effect", "ale")


@query(f"""with c as (select ch, t * 1.5 + ch as x, avg(v) as y from sig group by all), g as (select x / 2.0 as x from range(0, 240) r(x)),
k as (select g.x, i.ch, (select max(c.x) from c where c.ch = i.ch and c.x <= g.x) as a, (select min(c.x) from c where c.ch = i.ch and c.x >= g.x) as b from g, (select distinct ch from c) i)
select k.ch, {r('k.x')} as x, {r('case when a = b then p.y else p.y + (q.y - p.y) * (k.x - a) / (b - a) end')} as y from k left join c p on p.ch = k.ch and p.x = a left join c q on q.ch = k.ch and q.x = b""", "sig")
def ale_grid_interp(spark, sf_dir):
    """Curves with points at t * 1.5 + channel on a grid of halves that reaches beyond them."""
    c = emb_signal(spark, sf_dir).groupBy("ch", (F.col("t") * 1.5 + F.col("ch")).alias("x")).agg(F.avg("v").alias("y"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(239)), lambda k: k / 2.0)
    return rounded(stats.interpolate(c, ["ch"], grid), "x", "y")


@query(f"with {_FEAT} select ch, {r('sum(v * x) / nullif(sum(x), 0)')} as weighted from feat group by ch", "sig")
def weighted_mean(spark, sf_dir):
    f = emb_signal(spark, sf_dir).groupBy("rec", "ch").agg(F.sum(F.col("v") * F.col("v")).alias("x"), F.round(F.sum("v"), 2).alias("v"))
    return rounded(f.groupBy("ch").agg(stats.weighted_mean(F.col("v"), F.col("x")).alias("weighted")), "weighted")


_T = ", ".join(f"({n}, {t_quantile(0.975, n - 1)!r}::double)" for n in range(2, 301))


def _limits(rows: str) -> str:
    return f"select s.*, mean - q.t * std / sqrt(n) as low, mean + q.t * std / sqrt(n) as high from ({rows}) s left join (values {_T}) as q(k, t) on q.k = s.n"


@query(f"""with {_FEAT}, s as ({_limits('select ch, count(v) as n, avg(v) as mean, stddev_samp(v) as std from feat group by ch')})
select ch, n, {r('mean')} as mean, {r('std')} as std, {r('low')} as low, {r('high')} as high from s""", "sig")
def t_interval(spark, sf_dir):
    return rounded(stats.interval(_features(spark, sf_dir), ["ch"], "v"), "mean", "std", "low", "high")


_EFFECTS = """e as (select ch as feature, (rec % 7)::bigint as fold, (t // 4 * (1 + rec % 3) / 2.0)::double as x, avg(v) as y, count(*) as n from sig where rec % 7 < 2 + ch group by all)"""


def _effects(spark, sf_dir):
    """Folds' effect curves: seven folds with points at three spacings; feature 0 is known to two folds only."""
    s = emb_signal(spark, sf_dir).where("rec % 7 < 2 + ch")
    x = (F.expr("t div 4") * (1 + F.col("rec") % 3) / 2.0).cast("double")
    return s.groupBy(F.col("ch").alias("feature"), (F.col("rec") % 7).alias("fold"), x.alias("x")).agg(F.avg("v").alias("y"), F.count(F.lit(1)).alias("n"))


_AGG = f"""with {_EFFECTS}, ends as (select feature, min(x) as lo, max(x) as hi from e group by feature having count(distinct fold) >= 3), w as (select feature, fold, sum(n) as w from e group by all),
c as (select ends.feature, w.fold, w.w, lo + (hi - lo) * k / 19 as x from ends join w using (feature), range(0, 20) as g(k)),
k as (select c.*, (select max(e.x) from e where e.feature = c.feature and e.fold = c.fold and e.x <= c.x) as a, (select min(e.x) from e where e.feature = c.feature and e.fold = c.fold and e.x >= c.x) as b from c),
y as (select k.feature, k.x, k.w, case when a = b then p.y else p.y + (q.y - p.y) * (k.x - a) / (b - a) end as y from k join e p on p.feature = k.feature and p.fold = k.fold and p.x = a join e q on q.feature = k.feature and q.fold = k.fold and q.x = b)"""


@query(f"""{_AGG}, s as ({_limits('select feature, x, count(y) as n, sum(y * w) / sum(w) as mean, stddev_samp(y) as std from y group by all')})
select feature, {r('x')} as x, n, {r('mean')} as mean, {r('std')} as std, {r('low')} as low, {r('high')} as high from s""", "sig")
def ale_aggregate(spark, sf_dir):
    return rounded(stats.aggregate_effects(_effects(spark, sf_dir), ["feature"], 20), "x", "mean", "std", "low", "high")
