"""Queries that write a table to the shared folder and read it back, so that sinks and scans are held against SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from ..operators import evaluation, relational as R, stats
from ..sources import shared, sinks
from ..sources.views import emb_arrays, emb_signal, run_log, scores, table
from .evaluation_queries import _AGG, _ROC, _effects, _limits
from .registry import query, r, rounded

_SOURCE = "case rec % 3 when 0 then 'background' when 1 then 'ips' else 'hv' end"


def _source(rec="rec"):
    return F.when(F.col(rec) % 3 == 0, "background").when(F.col(rec) % 3 == 1, "ips").otherwise("hv")


@query(f"select rec, ch, count(*) as n, {r('sum(v)')} as total from sig where {_SOURCE} = 'ips' group by all", "sig")
def stored_samples(spark: SparkSession, sf_dir: str):
    path = shared.folder(spark, "samples")
    sinks.write_samples(emb_arrays(spark, sf_dir).withColumn("source", _source()), path)
    back = sinks.read_samples(spark, path, "ips").select("rec", "ch", F.explode("samples").alias("v"))
    return rounded(back.groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total")


@query(f"""with b as (select rec, min(t) as f, max(t) as l from sig where ch = 19 and v > 0.2 group by rec)
select rec, case when t between f and l then 'stim' else 'rest' end as kind, count(*) as n, {r('sum(v)')} as total from sig join b using (rec) group by all""", "sig")
def stored_periods(spark, sf_dir):
    from ..operators import signal as S

    s, path = emb_signal(spark, sf_dir), shared.folder(spark, "periods")
    sinks.write_periods(S.stim_periods(s, S.stim_bounds(s, 0.2), 0), path)
    return rounded(spark.read.parquet(path).groupBy("rec", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")), "total")


@query("select case when c_custkey % 7 = 3 then 'new' else 'old' end as made, c_custkey + 100 as index, c_name from customer where c_custkey % 7 = 3 or c_custkey % 2 = 0")
def stored_dataset(spark, sf_dir):
    """Even customers are saved, then every seventh over them: those in both are replaced, the others stay."""
    path = shared.folder(spark, "dataset")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("index"), "c_custkey", "c_name")
    # A folder for each index is what the format asks for; here an index holds a tenth of the customers.
    sinks.save_dataset(c.where("c_custkey % 2 = 0 and c_custkey % 7 <> 3").withColumn("made", F.lit("old")), path, offset=100)
    sinks.save_dataset(c.where("c_custkey % 7 = 3").withColumn("made", F.lit("new")).withColumn("index", F.col("index") + 10), path, offset=100, overwrite=True)
    return spark.read.parquet(path).select("made", (F.col("c_custkey") + 100).alias("index"), "c_name")


@query("select family, montage, length::int as seconds, 'mean' as combiner, count(*) as n from runs where (family, montage, length) in (('A', 'F', 1), ('R', 'F', 7)) group by all", "runs")
def stored_features(spark, sf_dir):
    """Two partitions written one after the other, the second write skipping what is there."""
    rows, path = run_log(spark, sf_dir).withColumn("combiner", F.lit("mean")).withColumnRenamed("length", "seconds"), shared.folder(spark, "features")
    one, both = rows.where("family = 'A' and montage = 'F' and seconds = 1"), rows.where("(family, montage, seconds) in (('A', 'F', 1), ('R', 'F', 7))")
    sinks.write_features(one, path)
    sinks.write_features(both, path, skip_existing=True)
    a, b = (sinks.read_features(spark, path, f, "F", s, "mean") for f, s in (("A", 1), ("R", 7)))
    return a.union(b).groupBy("family", "montage", F.col("seconds").cast("int").alias("seconds"), "combiner").agg(F.count(F.lit(1)).alias("n"))


@query(f"select 'study' as project_name, 'run_' || length as run_name, 0 as run, count(*) as n, {r('avg(auc)')} as auc from runs group by length", "runs")
def stored_runs(spark, sf_dir):
    """Predictions appended run by run, key columns filled in; runs that are there are skipped the second time."""
    path = shared.folder(spark, "runs")
    rows = run_log(spark, sf_dir).withColumn("run_name", F.concat(F.lit("run_"), F.col("length").cast("string"))).select("run_name", "auc")
    for part in (rows.where("run_name < 'run_4'"), rows):
        done = sinks.finished_runs(spark, path, "study")
        sinks.append_run(R.skip_existing(part, done, ["run_name"]), path, project_name="study", run=0)
    back = spark.read.parquet(path).groupBy("project_name", "run_name", "run").agg(F.count(F.lit(1)).alias("n"), F.avg("auc").alias("auc"))
    return rounded(back, "auc")


@query(f"select family, count(*) as n, {r('sum(auc)', 4)} as auc from runs group by family", "runs")
def run_metrics_log(spark, sf_dir):
    path = shared.folder(spark, "log")
    for k in range(2):
        sinks.log_metrics(run_log(spark, sf_dir).where(F.col("run") % 2 == k), path)
    back = spark.read.parquet(path).where("logged_at is not null")
    return rounded(back.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.sum("auc").alias("auc")), "auc", digits=4)


@query(f"""with {_ROC}, p as (select lang, fpr, tpr, row_number() over (partition by lang order by k) as k from roc where fpr is not null and tpr is not null),
a as (select lang, (fpr - lag(fpr) over w) * (tpr + lag(tpr) over w) / 2 as a from p window w as (partition by lang order by k)), s as (select lang, sum(a) as area from a group by lang)
select lang as curve, {r('fpr')} as fpr, {r('tpr')} as tpr, {r('area')} as area from p join s using (lang)""", "scores")
def stored_roc(spark, sf_dir):
    path = shared.folder(spark, "roc")
    c = evaluation.roc_curve(scores(spark, sf_dir), ["lang"]).where("fpr is not null and tpr is not null").select(F.col("lang").alias("curve"), "fpr", "tpr")
    sinks.write_roc(c, evaluation.curve_area(c, ["curve"]), path)
    return rounded(spark.read.parquet(path).select("curve", "fpr", "tpr", "area"), "fpr", "tpr", "area")


@query(f"""{_AGG}, s as ({_limits('select feature, x, count(y) as n, sum(y * w) / sum(w) as mean, stddev_samp(y) as std from y group by all')})
select 'second' as result, feature, {r('x')} as x, n, {r('mean')} as mean, {r('low')} as low, (select count(distinct feature) from s) as features, (select count(*) from s) as points from s""", "sig")
def stored_effects(spark, sf_dir):
    """Two results stored under their names, listed, and one of them read."""
    path = shared.folder(spark, "effects")
    e = stats.aggregate_effects(_effects(spark, sf_dir), ["feature"], 20)
    sinks.write_effects(e.where("feature < 3"), path, "first")
    sinks.write_effects(e, path, "second")
    listed = sinks.list_effects(spark, path)
    back = sinks.read_effects(spark, path, "second").select("result", "feature", "x", "n", "mean", "low")
    return rounded(back.join(listed, "result"), "x", "mean", "low")


@query("""with v as (select vec_id // 20 as rec, vec_id % 20 as ch, k - 1 as t, round(embedding[k]::double * 10000) + 0.0 as v from embeddings, unnest(range(1, 65)) as u(k))
select rec, ch, (t // 16)::double as start, (t % 16)::bigint as k, v from v where ch in (3, 7, 19) and t >= 16 and t < 48""")
def edf_scan(spark, sf_dir):
    """All recordings as EDF files, of which three channels and the two seconds in the middle are read."""
    from ..sources import edf_source

    path = shared.folder(spark, "edf")
    channels = emb_arrays(spark, sf_dir).select("rec", "ch", F.transform("samples", lambda v: F.round(v * 10000)).alias("s"))
    files = channels.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("ch", "s"))).alias("c"))
    rows = files.select(F.concat(F.lit("rec"), F.col("rec").cast("string")).alias("name"), F.lit(16.0).alias("sfreq"), F.transform("c", lambda c: c.ch.cast("string")).alias("channels"), F.col("c.s").alias("samples"))
    edf_source.write(rows, path)
    got = edf_source.scan(spark, path, ["3", "7", "19"]).where("start >= 1 and start < 3")
    return got.select(F.regexp_extract("path", r"rec(\d+)\.edf$", 1).cast("long").alias("rec"), F.col("channel").cast("long").alias("ch"), "start", F.posexplode("samples").alias("k", "v")).withColumns({"k": F.col("k").cast("long"), "v": F.col("v") + 0.0})


@query("select c_mktsegment || c_custkey % 40 as subject, arg_min(c_nationkey % 2, c_custkey)::int as epilepsy from customer group by all")
def described_labels(spark, sf_dir):
    """Descriptions as CSV, read back: each subject's label is that of its first row."""
    from ..sources import edf

    path = shared.folder(spark, "descriptions")
    c = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("subject"), (F.col("c_nationkey") % 2).alias("epilepsy"), F.col("c_custkey").alias("session"))
    c.repartitionByRange(3, "session").sortWithinPartitions("session").write.option("header", True).csv(path)
    return edf.subject_labels(edf.descriptions(spark, path, "subject string, epilepsy int, session int"))
