"""Queries of what users add: an aggregate, a table function, transforms, and window targets out of misc channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extensions as X
from ..sources.views import emb_arrays, emb_signal
from .registry import query, r, rounded


@query(f"""select ch, {r('sqrt(avg(v * v))')} as rms, {r('max(v) - min(v)')} as vpp, {r('sum(abs(v)) / max(abs(v))')} as crest, {r('avg(abs(v))')} as mean_abs from sig group by ch""", "sig")
def registered_aggregates(spark, sf_dir):
    X.register_aggregate("crest", lambda x: F.sum(F.abs(x)) / F.max(F.abs(x)))
    X.register_aggregate("mean_abs", lambda x: F.avg(F.abs(x)))
    names = ["rms", "vpp", "crest", "mean_abs"]
    return rounded(X.aggregate(emb_signal(spark, sf_dir), ["ch"], "v", names), *names)


def bursts(samples, level):
    """start, stop (after the end) and peak of each run of samples whose magnitude is over `level`."""
    start, peak = None, 0.0
    for t, v in enumerate(samples or []):
        if v is not None and abs(v) > level:
            start, peak = (t if start is None else start), max(peak, abs(v))
        elif start is not None:
            yield start, t, peak
            start, peak = None, 0.0
    if start is not None:
        yield start, len(samples), peak


@query(f"""with o as (select rec, ch, t, v, t - row_number() over (partition by rec, ch order by t) as run from sig where abs(v) > 0.2)
select rec, ch, min(t) as start, max(t) + 1 as stop, {r('max(abs(v))')} as peak from o group by rec, ch, run""", "sig")
def lateral_bursts(spark, sf_dir):
    X.register_table_function(spark, "wavefold_bursts", bursts, "start long, stop long, peak double")
    found = spark.sql("select s.rec, s.ch, b.start, b.stop, b.peak from {signals} s, lateral wavefold_bursts(s.samples, 0.2D) b", signals=emb_arrays(spark, sf_dir))
    return rounded(found, "peak")


@query(f"""with p as (select rec, ch, t, v - avg(v) over (partition by rec, ch) as v from sig)
select rec, ch, t, {r('least(greatest(v, -0.25), 0.25)')} as v from p""", "sig")
def registered_transforms(spark, sf_dir):
    X.register_transform("centred", lambda x: F.transform(x, lambda v: v - F.aggregate(x, F.lit(0.0), lambda s, a: s + a) / F.size(x)))
    X.register_transform("clipped", lambda x: F.transform(x, lambda v: F.least(F.greatest(v, F.lit(-0.25)), F.lit(0.25))))
    done = X.transformed(emb_arrays(spark, sf_dir), "samples", ["centred", "clipped"])
    return rounded(done.select("rec", "ch", F.posexplode("samples").alias("t", "v")).withColumn("t", F.col("t").cast("long")), "v")


@query(f"""with w as (select rec, ch, t // 16 as seg, t % 16 as i, v::float as v from sig),
x as (select rec, seg, {r('sum(v::double * (ch + 1) * (i + 1))', 3)} as weighted, count(*) as n from w where ch < 18 group by rec, seg),
y as (select rec, seg, {r('max(v) filter (where ch = 18 and i = 15)::double')} as first_target, {r('max(v) filter (where ch = 19 and i = 15)::double')} as second_target from w group by rec, seg)
select * from x join y using (rec, seg)""", "sig")
def misc_targets(spark, sf_dir):
    """A recording that lacks a misc channel has no target of it; one without other channels has no rows."""
    w = X.window_targets(emb_arrays(spark, sf_dir), [18, 19], 16).where(F.size("samples") > 0)
    own = lambda ch: F.get("target", F.array_position("misc", ch).cast("int") - 1).cast("double")
    total = F.aggregate(F.flatten(F.transform("samples", lambda x, c: F.transform(x, lambda v, i: v.cast("double") * (c + 1) * (i + 1)))), F.lit(0.0), lambda s, v: s + v)
    out = w.select("rec", "seg", total.alias("weighted"), F.size(F.flatten("samples")).cast("long").alias("n"), own(18).alias("first_target"), own(19).alias("second_target"))
    return rounded(rounded(out, "weighted", digits=3), "first_target", "second_target")
