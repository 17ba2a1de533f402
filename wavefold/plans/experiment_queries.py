"""Queries of the experiment layer: plans of runs, data preparation, sweeps, summaries and reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.learn import BoostParams
from ..operators import evaluation as E, families, relational as R, sweeps
from ..sources import shared
from ..sources.views import emb_arrays, emb_signal, table
from . import experiments
from .registry import query, r, rounded

_list = lambda values: ", ".join(f"({k}, {v!r})" for k, v in enumerate(values))


def _single_sql(name: str) -> str:
    e = experiments.PRESETS[name]
    skip = f"where not ({e.skip})" if e.skip else ""
    return f"""select '{name}' as project_name, (((mi * {len(e.families)} + fi) * {len(e.seconds)} + si) * {len(e.combiners)} + ci) * {e.runs} + run as run_no, run::int as run, family || '|' || montage || '|' || seconds || '|' || combiner || '_run_' || run as run_name
from (values {_list(e.montages)}) m(mi, montage), (values {_list(e.families)}) f(fi, family), (values {_list(e.seconds)}) s(si, seconds), (values {_list(e.combiners)}) c(ci, combiner), range({e.runs}) x(run) {skip}"""


def _ensemble_sql(name: str) -> str:
    e = experiments.PRESETS[name]
    names = "[" + ", ".join(f"'{f}'" for f in e.families) + "]"
    return f"""select '{name}' as project_name, k * {e.runs} + run as run_no, run::int as run, array_to_string(list_transform(s, lambda i: {names}[i + 1]), '+') || '_run_' || run as run_name
from (select s, row_number() over (order by len(s), s) - 1 as k from (select list_filter(range(0, {len(e.families)}), lambda i: (m >> i) & 1 = 1) as s from range(1, {1 << len(e.families)}) as t(m)) where len(s) >= {e.least} and len(s) < {e.below}), range({e.runs}) x(run)"""


_PLAN = " union all ".join((_single_sql if e.mode == "single" else _ensemble_sql)(n) for n, e in experiments.PRESETS.items())


@query(f"with p as ({_PLAN}) select project_name, run_no::bigint as run_no, run, run_name, (('0x' || substr(md5(run_name), 1, 8))::bigint % 5000)::int as seed from p")
def run_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of all twenty studies."""
    out = None
    for e in experiments.PRESETS.values():
        one = sweeps.run_plan(spark, e).select("project_name", "run_no", "run", "run_name", "seed")
        out = one if out is None else out.unionByName(one)
    return out


_START, _DONE = "plv+gcc_run_3", "clinic_ensemble_ips"


@query(f"""with p as ({_ensemble_sql(_DONE)}) select run_no::bigint as run_no, run_name from p where run_no >= (select run_no from p where run_name = '{_START}') and run % 2 = 0 and run_no < 2000""")
def run_plan_resumed(spark, sf_dir):
    """A study taken up at a run, without the runs that are done."""
    e = experiments.PRESETS[_DONE]
    done = sweeps.run_plan(spark, e).where("run % 2 = 1 or run_no >= 2000").select("run_name")
    return sweeps.run_plan(spark, e, done, _START).select("run_no", "run_name")


# Preparation: each recording has a row in two or three sources; its families' vectors are pieces of the recording's channels.

_PIECES = """f as (select s.source, (vec_id // 20)::varchar as subject, (vec_id // 20 % 2)::int as y, f.family, 'CAR' as montage, 1 as length, c.combiner, vec_id as pos, list_transform(embedding[s.k * 4 + 1 : s.k * 4 + 3 + f.k], lambda v: v::double) as features
from embeddings, (values (0, 'background'), (1, 'ips'), (2, 'hv')) s(k, source), (values (0, 'cc'), (1, 'dwt')) f(k, family), (values ('mean'), ('std')) c(combiner)
where vec_id % 20 in (s.k + 2, s.k + 5) and (vec_id // 20) % 5 <> s.k),
best as (select * from (values ('background', 'cc', 'CAR', 1, 'mean'), ('background', 'dwt', 'CAR', 1, 'std'), ('ips', 'cc', 'CAR', 1, 'std'), ('ips', 'dwt', 'CAR', 1, 'std'), ('hv', 'cc', 'CAR', 1, 'mean'), ('hv', 'dwt', 'CAR', 1, 'mean')) b(source, family, montage, length, combiner)),
own as (select source, subject, y, family, features from (select f.*, row_number() over (partition by source, subject, family order by pos) as k from f semi join best using (source, family, montage, length, combiner)) where k = 1)"""


def _pieces(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, rec = table(spark, sf_dir, "embeddings"), F.expr("vec_id div 20")
    out = None
    for k, source in enumerate(("background", "ips", "hv")):
        for j, family in enumerate(("cc", "dwt")):
            own = e.where((F.col("vec_id") % 20).isin(k + 2, k + 5) & (rec % 5 != k))
            one = own.select(F.lit(source).alias("source"), rec.cast("string").alias("subject"), (rec % 2).cast("int").alias("y"), F.lit(family).alias("family"), F.lit("CAR").alias("montage"), F.lit(1).alias("length"), F.explode(F.array(F.lit("mean"), F.lit("std"))).alias("combiner"), F.col("vec_id").alias("pos"), F.slice("embedding", k * 4 + 1, 3 + j).cast("array<double>").alias("features"))
            out = one if out is None else out.unionByName(one)
    rows = [("background", "cc", "mean"), ("background", "dwt", "std"), ("ips", "cc", "std"), ("ips", "dwt", "std"), ("hv", "cc", "mean"), ("hv", "dwt", "mean")]
    return out, spark.createDataFrame([(s, f, "CAR", 1, c) for s, f, c in rows], "source string, family string, montage string, length int, combiner string")


def _prepared(key: str, sources: list[str]):
    joins = " ".join(f"join own s{k} on s{k}.subject = s0.subject and s{k}.family = s0.family and s{k}.source = '{s}'" for k, s in enumerate(sources) if k)
    lists = "s0.features"
    for k in range(1, len(sources)):
        lists = f"list_concat({lists}, s{k}.features)"

    def f(spark, sf_dir):
        x = sweeps.prepare(*_pieces(spark, sf_dir), sources)
        return rounded(x.select("subject", "y", "family", F.posexplode("features").alias("k", "v")).withColumn("k", F.col("k").cast("long")), "v")

    f.__name__ = key
    query(f"with {_PIECES}, w as (select s0.subject, s0.y, s0.family, {lists} as l from own s0 {joins} where s0.source = '{sources[0]}') select subject, y, family, k - 1 as k, {r('l[k]')} as v from w, unnest(range(1, len(l) + 1)) as u(k)")(f)


_prepared("prepare_single_source", ["background"])
_prepared("prepare_dual_source", ["background", "ips"])
_prepared("prepare_triple_source", ["background", "ips", "hv"])


@query(f"with {_PIECES} select subject, y, {r('list_sum(features)')} as total from own where source = 'background' and family = 'dwt'")
def preloaded_features(spark, sf_dir):
    cache = sweeps.preload(sweeps.prepare(*_pieces(spark, sf_dir), ["background"]))
    return rounded(sweeps.fetch(cache, "dwt").select("subject", "y", F.aggregate("features", F.lit(0.0), lambda a, v: a + v).alias("total")), "total")


# Sweeps, on small grids of the real pipeline


def _name(k) -> F.Column:
    """A subject's name, of eight letters, for a number."""
    letter = lambda x: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (x % 26 + 1).cast("int"), F.lit(1))
    return F.concat(F.lit("aaaaa"), *(letter(F.floor(k / 26**p)) for p in (2, 1, 0)))


def _features(spark, sf_dir) -> DataFrame:
    """Of all recordings; the first ten subjects' names are aaaaajga to aaaaajgj, the last of which the preset leaves out."""
    grid = [("cc", "CAR", 0.25), ("dwt", "CAR", 0.25), ("cc", "Cz", 0.25)]
    f = shared.store(families.extract(emb_arrays(spark, sf_dir), grid, 64.0), "features")
    return f.select(_name(F.col("rec") + 6240).alias("subject"), (F.col("rec") % 2).cast("int").alias("y"), "family", "montage", F.lit(1).alias("seconds"), "combiner", "features", F.col("rec").alias("pos"))


_SMALL = BoostParams(trees=10, depth=2)


def _single(spark, sf_dir) -> DataFrame:
    e = replace(experiments.PRESETS["open_ss_ips_noieds"], montages=("CAR", "Cz"), families=("cc", "dwt"), seconds=(1,), runs=2, skip="family = 'dwt' and montage = 'Cz'", boost=_SMALL)
    return sweeps.single_sweep(_features(spark, sf_dir), e)


@query()
def single_sweep(spark, sf_dir):
    return rounded(_single(spark, sf_dir), "y_prob")


@query()
def single_sweep_summaries(spark, sf_dir):
    return rounded(sweeps.summaries(_single(spark, sf_dir)), *sweeps.METRICS)


def _ensemble(spark, sf_dir) -> DataFrame:
    """From features through preparation to predictions: each family's vector is that of its best montage and combiner."""
    e = replace(experiments.PRESETS["open_ensemble_ips_noieds"], families=("cc", "dwt"), least=1, below=3, runs=2, responders=1, boost=BoostParams(trees=10, depth=2, rate=0.3))
    yes = emb_signal(spark, sf_dir).select(_name(F.col("rec") + 6240).alias("subject"), F.when(F.col("rec") == 4, 0).otherwise(1).alias("hv_success")).distinct()
    params = spark.createDataFrame([("open_ips", "cc", "Cz", 1, "skew"), ("open_ips", "dwt", "CAR", 1, "std")], "source string, family string, montage string, length int, combiner string")
    features = _features(spark, sf_dir).withColumnRenamed("seconds", "length").withColumn("source", F.lit("open_ips"))
    return sweeps.ensemble_sweep(sweeps.prepare(features, params, ["open_ips"]), e, yes)


@query()
def ensemble_sweep(spark, sf_dir):
    return rounded(_ensemble(spark, sf_dir), "y_prob")


_SUBJECTS = """subjects as (select vec_id // 20 as rec, 'aaaaa' || chr((97 + (vec_id // 20 + 6240) // 676 % 26)::int) || chr((97 + (vec_id // 20 + 6240) // 26 % 26)::int) || chr((97 + (vec_id // 20 + 6240) % 26)::int) as subject from embeddings group by all),
kept as (select subject, (rec % 2)::int as y, dense_rank() over (order by subject) - 1 as fold_id from subjects where subject not in ('aaaaajgj', 'aaaaakcd') and rec <> 4)"""


@query(f"""with {_SUBJECTS}, sets as (select * from (values ('cc'), ('dwt'), ('cc+dwt')) s(feature_set))
select feature_set || '_run_' || run as run_name, fold_id::int as fold_id, subject as subject_id, y as y_true from kept, sets, range(2) r(run)""")
def ensemble_sweep_folds(spark, sf_dir):
    """Who is tested in which fold of which run, by text names, with the study's exclusions and responders."""
    return _ensemble(spark, sf_dir).select("run_name", "fold_id", "subject_id", "y_true")


# Reports over stored predictions: line items stand for tested recordings of 7 runs of 6 configurations.

_PREDS = """preds as (select case l_returnflag when 'A' then 'cc' when 'N' then 'dwt' else 'plv' end || case l_linestatus when 'F' then '+gcc' else '+gcc+utm' end as feature_set,
case l_returnflag when 'A' then 'cc' when 'N' then 'dwt' else 'plv' end as family, l_linestatus as montage, (1 + l_suppkey % 2)::int as seconds, 'mean' as combiner, l_linenumber::int as run,
(l_orderkey % 3 = 0)::int as y_true, ((l_partkey * 7 + l_orderkey % 3 * 11) % 101 >= 40)::int as y_pred, (l_partkey * 7 + l_orderkey % 3 * 11) % 101 / 100.0::double as y_prob from lineitem)"""


def _preds(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    family = F.when(F.col("l_returnflag") == "A", "cc").when(F.col("l_returnflag") == "N", "dwt").otherwise("plv")
    s = (F.col("l_partkey") * 7 + F.col("l_orderkey") % 3 * 11) % 101
    return li.select(F.concat(family, F.when(F.col("l_linestatus") == "F", "+gcc").otherwise("+gcc+utm")).alias("feature_set"), family.alias("family"), F.col("l_linestatus").alias("montage"), (1 + F.col("l_suppkey") % 2).cast("int").alias("seconds"), F.lit("mean").alias("combiner"), F.col("l_linenumber").cast("int").alias("run"), (F.col("l_orderkey") % 3 == 0).cast("int").alias("y_true"), (s >= 40).cast("int").alias("y_pred"), (s / 100.0).alias("y_prob"))


def _summary_sql(by: str) -> str:
    """Metrics of every group, as `summary`; its curves' points stay in `roc_`."""
    div = lambda a, b: f"coalesce(({a})::double / nullif({b}, 0), 0)"
    bac = f"({div('tp', 'tp + fn')} + {div('tn', 'tn + fp')}) / 2"
    on = "using (" + by + ")"
    return f"""flat_ as (select {by}, count(*) filter (where y_pred = 1 and y_true = 1) as tp, count(*) filter (where y_pred = 1 and y_true = 0) as fp, count(*) filter (where y_pred = 0 and y_true = 0) as tn, count(*) filter (where y_pred = 0 and y_true = 1) as fn from preds group by {by}),
per_ as (select {by}, y_prob as threshold, sum(y_true)::bigint as p, count(*) as n from preds group by all),
st_ as (select {by}, threshold, (sum(p) over w)::bigint as tps, (sum(n - p) over w)::bigint as fps, (sum(p) over (partition by {by}))::bigint as pos, (sum(n - p) over (partition by {by}))::bigint as neg, row_number() over w as k from per_ window w as (partition by {by} order by threshold desc)),
bend_ as (select *, lead(tps) over w - 2 * tps + coalesce(lag(tps) over w, 0) as bt, lead(fps) over w - 2 * fps + coalesce(lag(fps) over w, 0) as bf from st_ window w as (partition by {by} order by k)),
roc_ as (select {by}, k, threshold, fps::double / nullif(neg, 0) as fpr, tps::double / nullif(pos, 0) as tpr from bend_ where bt is null or bt <> 0 or bf <> 0 or k = 1 union all select distinct {by}, 0, 'infinity'::double, case when neg > 0 then 0 end, case when pos > 0 then 0 end from st_),
auc_ as (select {by}, sum(a) as auc from (select {by}, (fpr - lag(fpr) over w) * (tpr + lag(tpr) over w) / 2 as a from roc_ window w as (partition by {by} order by k)) group by {by}),
pr_ as (select {by}, sum(d * (p + q) / 2) as auprc, sum(d * p) as ap from (select {by}, rec - coalesce(lag(rec) over w, 0) as d, p, coalesce(lag(p) over w, 1.0) as q from (select *, tps::double / (tps + fps) as p, tps::double / nullif(pos, 0) as rec from st_) window w as (partition by {by} order by k)) group by {by}),
eighty_ as (select {by}, arg_min((tpr + 1 - fpr) / 2, k) as bac80 from roc_ where tpr >= 0.8 group by {by}),
summary as (select {by}, {div('tp + tn', 'tp + fp + tn + fn')} as accuracy, {bac} as bac, bac80, {div('2 * tp', '2 * tp + fp + fn')} as f1_score, {div('tp', 'tp + fp')} as precision, {div('tp', 'tp + fn')} as recall, auc, auprc, ap
from flat_ join auc_ {on} join pr_ {on} left join eighty_ {on})"""


_all = lambda f: ", ".join(f(m) for m in sweeps.METRICS)


@query(f"with {_PREDS}, {_summary_sql('feature_set, run')} select feature_set, run, {_all(lambda m: f'{r(m)} as {m}')} from summary")
def run_summaries(spark, sf_dir):
    return rounded(E.summary(_preds(spark, sf_dir), ["feature_set", "run"]), *sweeps.METRICS)


def _report_sql(of: str, group: str, score: str) -> str:
    return f"""with {_PREDS}, {_summary_sql(of + ', run')}, means as (select {of}, {group} as "group", {_all(lambda m: f'avg({m}) as {m}')} from summary group by {of}),
best as (select * from (select *, row_number() over (partition by "group" order by round({score}, 9) desc, {of}) as k_ from means) where k_ = 1),
std as (select {of}, {_all(lambda m: f'stddev_samp({m}) as {m}')} from summary semi join best using ({of}) group by {of}),
pts as (select {of}, run, fpr, max(tpr) as hi, min(tpr) as lo from roc_ semi join best using ({of}) where fpr is not null and tpr is not null group by all),
ask as (select g.*, i.run from (select distinct {of}, fpr from pts) g join (select distinct {of}, run from pts) i using ({of})),
near as (select ask.*, (select max(p.fpr) from pts p where {' and '.join(f'p.{c} = ask.{c}' for c in of.split(', '))} and p.run = ask.run and p.fpr <= ask.fpr) as a, (select min(p.fpr) from pts p where {' and '.join(f'p.{c} = ask.{c}' for c in of.split(', '))} and p.run = ask.run and p.fpr >= ask.fpr) as b from ask),
curve as (select {', '.join(f'near.{c}' for c in of.split(', '))}, near.fpr, avg(case when a = b then p.hi else p.hi + (q.lo - p.hi) * (near.fpr - a) / (b - a) end) as tpr from near
join pts p on {' and '.join(f'p.{c} = near.{c}' for c in of.split(', '))} and p.run = near.run and p.fpr = a join pts q on {' and '.join(f'q.{c} = near.{c}' for c in of.split(', '))} and q.run = near.run and q.fpr = b group by all)"""


def _reported(key: str, kind, which: str, of: str, sql: str, *columns: str):
    def f(spark, sf_dir):
        out = kind(_preds(spark, sf_dir))[which]
        return rounded(out, *columns)

    f.__name__ = key
    query(sql)(f)


_ENSEMBLE = _report_sql("feature_set", "len(string_split(feature_set, '+'))::int", "auc + auprc")
_SINGLE = _report_sql("family, montage, seconds, combiner", "family", "auc + bac80")
for _kind, _sql, _of, _f in (("ensemble", _ENSEMBLE, "feature_set", sweeps.ensemble_report), ("single", _SINGLE, "family, montage, seconds, combiner", sweeps.single_report)):
    _m = _all(lambda m: f"{r(m)} as {m}")
    _reported(f"{_kind}_report_means", _f, "means", _of, f'{_sql} select {_of}, "group", {_m} from means', *sweeps.METRICS)
    _reported(f"{_kind}_report_best", _f, "best", _of, f'{_sql} select {_of}, "group", {_m} from best', *sweeps.METRICS)
    _reported(f"{_kind}_report_std", _f, "std", _of, f'{_sql} select {_of}, best."group", {_all(lambda m: f"{r("std." + m)} as {m}")} from std join best using ({_of})', *sweeps.METRICS)
    _reported(f"{_kind}_report_roc", _f, "roc", _of, f"{_sql} select {_of}, {r('fpr')} as fpr, {r('tpr')} as tpr from curve", "fpr", "tpr")
    _reported(f"{_kind}_report_area", _f, "area", _of, f"{_sql}, t as (select {_of}, (fpr - lag(fpr) over w) * (tpr + lag(tpr) over w) / 2 as a from curve window w as (partition by {_of} order by fpr)) select {_of}, {r('sum(a)')} as area from t group by {_of}", "area")
    _reported(f"{_kind}_report_slope", _f, "slope", _of, f"{_sql}, p as (select {_of}, avg(y_true::double) as prior from preds semi join best using ({_of}) group by {_of}) select {_of}, {r('prior')} as prior, {r('0.6 * (1 - prior) / nullif(prior * 0.4, 0)')} as slope from p", "prior", "slope")


# Small operators of the experiment layer


@query("select doc_id as fold, (select count(*) from labels) - 1 as n_train from labels")
def loocv_splits(spark, sf_dir):
    return R.row_splits(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("select l_orderkey % 50 as config, array_to_string(list(l_linenumber || ':' || l_suppkey order by 3 - l_linenumber % 3, l_linenumber), ',') as v from (select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey from (select l_orderkey % 50 as l_orderkey, l_linenumber, l_suppkey from lineitem) group by all) group by all")
def combination_order(spark, sf_dir):
    """Results of parallel work, put back in the order of each combination: line numbers by their remainder, the largest first."""
    own = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 50).alias("config"), F.col("l_linenumber").alias("family")).agg(F.min("l_suppkey").alias("s"))
    results = own.select("config", "family", F.concat_ws(":", F.col("family").cast("string"), F.col("s").cast("string")).alias("v"))
    order = F.array_sort(F.collect_list(F.struct((3 - F.col("family") % 3).alias("a"), "family")))
    combos = own.groupBy("config").agg(F.transform(order, lambda x: x.family).alias("families"))
    return R.restore_order(results, combos, "family", "v").select("config", F.array_join("v", ",").alias("v"))


@query("select c_custkey, case when c_custkey % 3 = 0 then null else c_name end as a, c_acctbal from customer where c_custkey % 3 <> 0 and c_custkey % 4 <> 0")
def drop_any_null(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return R.drop_nulls(c.select("c_custkey", F.when(k % 3 != 0, F.col("c_name")).alias("a"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("c_acctbal")))


@query(f"select event_id, {r('cbrt(value - 50)')} as root from events")
def cube_root(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select("event_id", R.cube_root(F.col("value") - 50).alias("root")), "root")


_ANGLES = ", ".join(f"('{c}', {t}, {p})" for c, (t, p) in R.POSITIONS.items())


@query(f"select channel, {r('sin(radians(t)) * cos(radians(p))')} as x, {r('sin(radians(t)) * sin(radians(p))')} as y, {r('cos(radians(t))')} as z from (values {_ANGLES}) a(channel, t, p)")
def channel_positions(spark, sf_dir):
    return rounded(R.positions(spark), "x", "y", "z")


@query("""with d(event_type, ch) as (values ('view', 0), ('click', 1), ('purchase', 2)), w as (select rec from evt where ch in ('view', 'click', 'purchase') group by rec having count(distinct ch) = 3)
select rec, d.ch::bigint as ch, count(*) as n from evt join d on d.event_type = evt.ch semi join w using (rec) group by all""", "evt")
def pick_channels(spark, sf_dir):
    from ..sources.views import evt_signal

    e = evt_signal(spark, sf_dir).withColumnRenamed("ch", "channel")
    return R.pick_channels(e, ["view", "click", "purchase"]).groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"))


@query("select c_custkey, '/v3/' || case when c_custkey % 2 = 0 then 'train' else 'eval' end || case when c_custkey % 3 = 0 then '/abnormal/' else '/normal/' end || c_custkey || '.edf' as path, c_custkey % 2 = 0 as train, c_custkey % 3 = 0 as pathological from customer")
def abnormal_labels(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("/v3/"), F.when(k % 2 == 0, "train").otherwise("eval"), F.when(k % 3 == 0, "/abnormal/").otherwise("/normal/"), k.cast("string"), F.lit(".edf")).alias("path"))
    return p.select("c_custkey", "path").join(R.abnormal_labels(p), "path")


@query("select c_custkey, regexp_replace(c_mktsegment || '__' || c_name || '__' || c_nationkey, '[^A-Za-z0-9_.+-]', '_', 'g') as run_name, (('0x' || substr(md5(c_name), 1, 8))::bigint % 5000)::int as seed from customer")
def run_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", R.run_name(F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey").cast("string")).alias("run_name"), R.run_seed(F.col("c_name")).alias("seed"))


@query("select c_custkey, c_mktsegment from customer where c_nationkey in (select n_nationkey from nation where n_regionkey % 2 = 1)")
def responders_only(spark, sf_dir):
    """Customers whose nation is on the list with success 1."""
    listed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_regionkey") % 2).alias("hv_success"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return R.include_exclude(c, "c_nationkey", listed.where("hv_success = 1"), None).drop("c_nationkey")


@query(f"""with h as (select rec, ch, t, v from sig), w as (select rec, ch, i, list(v order by t) filter (where t >= i * 24 and t < i * 24 + 24) as s from h, range(0, 2) as r(i) group by all)
select rec, ch, i as i_window, {r('list_sum(list_transform(s, lambda v: v::float::double))', 5)} as total, len(s)::int as n from w""", "sig")
def window_slices(spark, sf_dir):
    """Windows of 24 samples cut out of recordings by their metadata, as floats."""
    a = emb_arrays(spark, sf_dir)
    w = R.windows_metadata(a.select("rec", "ch", F.size("samples").cast("long").alias("n")), 24).drop("n")
    s = R.window_slice(a, w, ["rec", "ch"])
    return rounded(s.select("rec", "ch", F.col("i_window").cast("long").alias("i_window"), F.aggregate("samples", F.lit(0.0), lambda x, v: x + v.cast("double")).alias("total"), F.size("samples").alias("n")), "total", digits=5)


@query(f"with h as (select event_id, value - 50 as re, user_id % 7 - 3.0 as im from events) select event_id, case when user_id % 5 = 0 then null else {r('sqrt(re * re + im * im)')} end as v from h join events using (event_id)")
def complex_magnitude(spark, sf_dir):
    im = F.when(F.col("user_id") % 5 == 0, float("nan")).otherwise(F.col("user_id") % 7 - 3.0)
    return rounded(table(spark, sf_dir, "events").select("event_id", R.magnitude(F.col("value") - 50, im).alias("v")), "v")
