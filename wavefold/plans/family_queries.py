"""Queries of the Arrow-based families and graph measures, with SQL where it can say them; tests hold the others against
closed forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import families, signal as S
from ..sources.views import emb_arrays
from .registry import query, r, rounded
from .signal_queries import _EDGES, _edges, iir_sql

FS = 32.0


def _family(key: str, family: str, montage: str, seconds: float = 0.5, fs: float = FS, sql: str | None = None, *ctes: str):
    def f(spark, sf_dir):
        out = families.extract(emb_arrays(spark, sf_dir), [(family, montage, seconds)], fs)
        return rounded(out.select("rec", "family", "montage", "seconds", "combiner", F.posexplode("features").alias("k", "value")).withColumn("k", F.col("k").cast("long")), "value", digits=5)

    f.__name__ = key
    query(sql, *ctes)(f)


def _montage(name: str) -> str:
    """out_(rec, o, t, v): the signal in a montage."""
    rows = ", ".join(f"({o}, {i}, {w!r}::double)" for o, row in enumerate(S.weights(name)) for i, w in row.items())
    return f"dim_(o, ch, w) as (values {rows}), out_ as (select rec, o::bigint as o, t, sum(w * v) as v from sig join dim_ using (ch) group by all)"


def _combined(family: str, montage: str, seconds: float, bias: bool) -> str:
    """The five combiners of f_(rec, k, seg, x)."""
    skew = "g1" if bias else "g1 * sqrt(n * (n - 1)) / nullif(n - 2, 0)"
    parts = {"mean": "mean", "median": "median", "std": "std", "skew": skew, "kurt": "g2"}
    return " union all ".join(f"select rec, '{family}' as family, '{montage}' as montage, {seconds}::double as seconds, '{c}' as combiner, k::bigint as k, {r(x, 5)} as value from c_" for c, x in parts.items())


_SHAPES = """m_ as (select *, avg(x) over (partition by rec, k) as mu from f_),
c_ as (select rec, k, avg(x) as mean, median(x) as median, stddev_samp(x) as std, count(*)::double as n, avg(power(x - mu, 3)) / nullif(power(avg(power(x - mu, 2)), 1.5), 0) as g1, avg(power(x - mu, 4)) / nullif(power(avg(power(x - mu, 2)), 2), 0) as g2 from m_ group by rec, k)"""
_BAND = "case band " + " ".join(f"when '{b}' then {k}" for k, b in enumerate(numeric.BANDS)) + " end"
_SPECTRAL = f"""with recursive {_montage('CAR')}, parts_ as (select rec, o, t // 16 as seg, list(v order by t) as v from out_ group by all), {iir_sql('parts_', 'rec, o, seg', 'v', 16)},
f_ as (select rec, {_BAND} * 19 + o as k, seg, coalesce(energy / nullif(sum(energy) over (partition by rec, o, seg), 0), 0) as x from iir_), {_SHAPES} {_combined('spectral', 'CAR', 0.064, False)}"""
_LAGS = """e_ as (select rec, t // 16 as seg, o, sum(v * v) as e from out_ group by all),
l_ as (select a.rec, a.t // 16 as seg, a.o as i, b.o as j, a.t - b.t as lag, abs(sum(a.v * b.v)) as c from out_ a join out_ b on a.rec = b.rec and a.t // 16 = b.t // 16 and a.o > b.o group by all),
f_ as (select l_.rec, i * (i - 1) // 2 + j as k, l_.seg, max(c) / sqrt(max(p.e) * max(q.e)) as x from l_ join e_ p on p.rec = l_.rec and p.seg = l_.seg and p.o = i join e_ q on q.rec = l_.rec and q.seg = l_.seg and q.o = j group by all)"""
_CC = f"with {_montage('BipolarDB')}, {_LAGS}, {_SHAPES} {_combined('cc', 'BipolarDB', 0.5, True)}"

_KERNEL = ", ".join(f"({d}, {float(v)!r}::double)" for d, v in enumerate(numeric.analytic(np.eye(16)[0]).imag))
_PHASES = f"""y_ as (select rec, o, seg, band, k as t, b[1] * s[k + 1] + z[1] as v from fold_ where k < 16 union all select rec, o, t // 16, 'raw', t % 16, v from out_), ker_(d, g) as (values {_KERNEL}),
h_ as (select a.rec, a.o, a.seg, a.band, a.t, any_value(a.v) as re, sum(x.v * g) as im from y_ a join y_ x on x.rec = a.rec and x.o = a.o and x.seg = a.seg and x.band = a.band join ker_ on d = (a.t - x.t + 16) % 16 group by all),
u_ as (select rec, o, seg, band, t, coalesce(re / nullif(sqrt(re * re + im * im), 0), 1) as c, coalesce(im / nullif(sqrt(re * re + im * im), 0), 0) as s from h_),
f_ as (select a.rec, (case a.band when 'raw' then 0 else 1 + {_BAND.replace('case band', 'case a.band')} end) * 171 + a.o * (a.o - 1) // 2 + b.o as k, a.seg, sqrt(power(avg(a.c * b.c + a.s * b.s), 2) + power(avg(a.s * b.c - a.c * b.s), 2)) as x
from u_ a join u_ b on a.rec = b.rec and a.seg = b.seg and a.band = b.band and a.t = b.t and a.o > b.o group by a.rec, a.seg, a.band, a.o, b.o)"""
_PLV = f"""with recursive {_montage('CAR')}, parts_ as (select rec, o, t // 16 as seg, list(v order by t) as v from out_ group by all), {iir_sql('parts_', 'rec, o, seg', 'v', 16)}, {_PHASES}, {_SHAPES} {_combined('plv', 'CAR', 0.064, False)}"""

_family("spectral_relative_power", "spectral", "CAR", 0.064, 250.0, _SPECTRAL, "sig")
_family("cwt_energy", "cwt", "Cz", 0.5, 1.0)
_family("dwt_energy", "dwt", "BipolarDB")
_family("mst_features", "mst", "CAR", 1.0)
_family("sst_features", "sst", "CAR", 1.0)
_family("utm_full", "utm", "Laplacian")
_family("plv_bands", "plv", "CAR", 0.064, 250.0, _PLV, "sig")
_family("cc_features", "cc", "BipolarDB", 0.5, FS, _CC, "sig")
_family("gcc_features", "gcc", "CAR", 1.0)
_family("gplv_features", "gplv", "CAR", 1.0)


@query()
def preprocess_signal(spark, sf_dir):
    out = families.preprocess(emb_arrays(spark, sf_dir), 160.0, 250.0)
    return out.withColumn("samples", F.transform("samples", lambda x: F.round(x, 6)))


@query()
def graph_profile(spark, sf_dir):
    return families.connectivity_profiles(_edges(spark, sf_dir), ["rec"], 19)


@query()
def graph_node_measures(spark, sf_dir):
    return rounded(families.node_measures(_edges(spark, sf_dir), ["rec"], 19), "centrality", "betweenness", "path_length", "eccentricity")


def _shorter(k: int) -> str:
    """Paths of up to 2^k links out of paths of up to 2^(k - 1)."""
    return f"p{k} as (select a.rec, a.u, b.v, min(a.d + b.d) as d from p{k - 1} a join p{k - 1} b on a.rec = b.rec and a.v = b.u group by all)"


@query(f"""with {_EDGES}, p0 as (select rec, u, v, 1 / w as d from d union all select distinct rec, ch, ch, 0.0 from sig where ch < 19), {', '.join(map(_shorter, range(1, 6)))},
n as (select rec, u, avg(d) as path_length, max(d) as eccentricity from p5 where u <> v group by all)
select rec, {r('avg(path_length)')} as path_length, {r('min(eccentricity)')} as radius, {r('max(eccentricity)')} as diameter from n group by rec""", "sig")
def graph_shortest_path(spark, sf_dir):
    """Mean path lengths and eccentricities of whole graphs."""
    m = families.node_measures(_edges(spark, sf_dir), ["rec"], 19)
    return rounded(m.groupBy("rec").agg(F.avg("path_length").alias("path_length"), F.min("eccentricity").alias("radius"), F.max("eccentricity").alias("diameter")), "path_length", "radius", "diameter")
