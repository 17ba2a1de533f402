"""Array forms of the sample operators: short, empty and null arrays, and no shuffle in their plans."""

from pyspark.sql import functions as F

from wavefold.operators import signal as S


def arrays(spark):
    return spark.createDataFrame([(1, [1.0, -1.0, 1.0, 1.0]), (2, [5.0]), (3, []), (4, None), (5, [2.0, 2.0, 2.0])], "rec int, samples array<double>")


def by_rec(df, column):
    return {r.rec: r[column] for r in df.collect()}


def test_short_empty_and_null(spark):
    d = arrays(spark)
    crossings = by_rec(S.array_zero_crossings(d), "crossings")
    assert {k: crossings[k] for k in (1, 2, 3, 5)} == {1: 2, 2: 0, 3: 0, 5: 0}
    assert by_rec(S.array_moving_average(d, 3), "samples") == {1: [1 / 3, 1 / 3], 2: [], 3: [], 4: [], 5: [2.0]}
    assert {k: [tuple(p) for p in v] if v is not None else None for k, v in by_rec(S.array_peak_candidates(d, 0.0), "peaks").items()} == {1: [], 2: [], 3: [], 4: None, 5: []}
    nleo = by_rec(S.array_nleo(d, 0, 0, 1, -1), "nleo")
    assert nleo == {1: [0.0] * 4, 2: [0.0], 3: [], 4: None, 5: [0.0] * 3}


def test_against_the_long_form(spark):
    d = spark.range(6).select(F.col("id").alias("rec"), F.lit(0).alias("ch"), F.transform(F.sequence(F.lit(0), F.lit(40) + F.col("id").cast("int")), lambda t: F.sin(t * (F.col("id") + 2) * 0.7)).alias("samples"))
    long = d.select("rec", "ch", F.posexplode("samples").alias("t", "v")).withColumn("t", F.col("t").cast("long"))
    for lags in ((0, 0, 1, -1), (1, 2, 0, 3)):
        want = {(r.rec, r.t): round(r.nleo, 9) for r in S.nleo(long, ["rec", "ch"], *lags).collect()}
        got = {(r.rec, t): round(v, 9) for r in S.array_nleo(d, *lags).collect() for t, v in enumerate(r.nleo)}
        assert got == want
    want = {(r.rec, r.t) for r in S.peak_candidates(long, ["rec", "ch"], 0.2).collect()}
    assert {(r.rec, p.t) for r in S.array_peak_candidates(d, 0.2).collect() for p in r.peaks} == want


def test_no_shuffle(spark):
    for f in (S.array_zero_crossings, lambda x: S.array_nleo(x, 1, 2, 0, 3), lambda x: S.array_moving_average(x, 5), lambda x: S.array_peak_candidates(x, 0.1)):
        assert "Exchange" not in f(arrays(spark))._jdf.queryExecution().executedPlan().toString()
