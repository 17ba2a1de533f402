"""Edge cases of the DataFrame operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.functions.learn import BoostParams
from wavefold.operators import evaluation, families, graph, modelling, relational, signal, stats
from wavefold.sources import edf, sinks
from wavefold.streaming.segments import tumbling_energy


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_short_signal_falls_back_to_one_segment(spark):
    s = frame(spark, [(0, 0, t, 1.0) for t in range(5)] + [(1, 0, t, 1.0) for t in range(9)], "rec long, ch long, t long, v double")
    got = {(r.rec, r.seg): r.n for r in signal.segments(s, 8).groupBy("rec", "seg").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 0): 5, (1, 0): 8}
    assert {r.rec for r in signal.segments(s, 8, fallback=False).collect()} == {1}


def test_constant_and_single_segments_have_no_shape(spark):
    f = frame(spark, [("a", 2.0), ("a", 2.0), ("b", 1.0)], "k string, value double")
    got = {r.k: r for r in signal.combine(f, ["k"]).collect()}
    assert got["a"]["std"] == 0 and got["a"].skew is None and got["a"].kurt is None and got["b"]["std"] is None


def test_montages(spark):
    x = np.random.default_rng(0).normal(size=(20, 6))
    s = frame(spark, [(0, c, t, float(x[c, t])) for c in range(20) for t in range(6)], "rec long, ch long, t long, v double")
    for name in ("CAR", "Cz", "BipolarDB", "Laplacian"):
        want = families.montage_matrix(name) @ x[:19]
        got = np.zeros(want.shape)
        for r in signal.montage(s, name).collect():
            got[r.out_ch, r.t] = r.v
        assert np.allclose(got, want)
        arrays = frame(spark, [(0, c, x[c].tolist()) for c in range(20)] + [(1, 0, [1.0])], "rec long, ch long, samples array<double>")
        rows = signal.montage_arrays(arrays, name).collect()
        assert {r.rec for r in rows} == {0} and np.allclose([r.samples for r in sorted(rows, key=lambda r: r.out_ch)], want)
    assert np.allclose((families.montage_matrix("CAR") @ x[:19]).sum(axis=0), 0)
    with pytest.raises(ValueError):
        signal.weights("none")


def test_one_class_and_tied_scores(spark):
    p = frame(spark, [("one", 1, 0.3), ("one", 1, 0.9), ("tie", 0, 0.5), ("tie", 1, 0.5), ("best", 0, 0.1), ("best", 1, 0.8)], "g string, y_true int, y_prob double")
    auc = {r.g: r.auc for r in evaluation.roc_auc(p, ["g"]).collect()}
    assert auc == {"one": None, "tie": 0.5, "best": 1.0}
    c = {r.g: r for r in evaluation.confusion(p, ["g"], 0.95).collect()}
    assert c["one"].precision == 0 and c["one"].recall == 0


def test_rank_test_leaves_small_groups_out(spark):
    v = frame(spark, [("a", float(k), k % 2) for k in range(12)] + [("b", 1.0, 0)], "g string, v double, y int")
    assert [(r.g, r.n1, r.u) for r in stats.mann_whitney(v, ["g"]).collect()] == [("a", 6, 21.0)]


def test_align_takes_the_first_row_and_drops_single_source_subjects(spark):
    a = frame(spark, [(1, 10, 0), (2, 20, 1)], "subject int, x int, pos int")
    b = frame(spark, [(1, 5, 1), (1, 6, 0)], "subject int, x int, pos int")
    assert [tuple(r) for r in relational.align(a, b, key="subject").select("subject", "x", "x_2").collect()] == [(1, 10, 6)]
    relational.assert_aligned(a, a)
    with pytest.raises(ValueError):
        relational.assert_aligned(a, b)


def test_headers_and_paths(spark):
    h = frame(spark, [("  Age:35  F  x",), ("Age:0.0109 M F",), ("none",)], "header string")
    assert [(r.age, r.gender) for r in relational.age_gender(h).collect()] == [(35, "F"), (0, "M"), (-1, "X")]
    p = relational.path_description(frame(spark, [("x.edf",), ("/d/v2/00_epilepsy/s/s001_2015/m/a_t003.edf",)], "path string")).collect()
    assert p[0].epilepsy is None and (p[1].subject, p[1].session, p[1].year, p[1].segment, p[1].epilepsy) == ("s", 1, 2015, 3, 0)
    with pytest.raises(Exception, match="no label"):
        relational.require_label(relational.path_description(frame(spark, [("x.edf",)], "path string"))).collect()


def test_describe_guards_names(spark):
    a, b = frame(spark, [(1, 2)], "k int, x int"), frame(spark, [(1, 3)], "k int, x int")
    with pytest.raises(ValueError):
        relational.describe(a, b, ["k"])
    assert relational.describe(a, b, ["k"], overwrite=True).first().x == 3


def test_graph_of_one_link_and_identical_channels(spark):
    e = frame(spark, [(0, 1, 0, 0.5), (0, 2, 1, float("nan"))], "rec long, i long, j long, w double")
    n = graph.normalise(e, ["rec"])
    assert [(r.i, r.w) for r in n.collect()] == [(1, 1.0)]
    s = frame(spark, [(0, c, [0.0, 1.0, 2.0, 3.0, 9.0][: 5 - c]) for c in (0, 1)] + [(1, 0, [1.0])], "rec long, ch long, samples array<double>")
    for measure in signal.PAIR_MEASURES:
        assert [(r.rec, r.i, r.j, pytest.approx(r.w)) for r in signal.pair_measure(s, measure).collect()] == [(0, 1, 0, 1.0)]
        assert [r.seg for r in signal.pair_measure(s, measure, 2).collect()] == [0, 1]
    assert signal.pair_measure(s.where("false"), "locking").count() == 0


def test_families_have_their_widths(spark):
    x = np.random.default_rng(1).normal(size=(19, 64))
    r = frame(spark, [(0, c, x[c].tolist()) for c in range(19)] + [(1, 0, [1.0])], "rec long, ch long, samples array<double>")
    got = families.extract(r, [("spectral", "CAR", 0.5), ("plv", "Cz", 0.5), ("gcc", "BipolarDB", 1.0), ("utm", "CAR", 99.0), ("sr", "CAR", 1.0)], 32.0).collect()
    assert {q.rec for q in got} == {0}
    for q in got:
        assert len(q.features) == families.width(q.family, {"CAR": 19, "Cz": 18, "BipolarDB": 18}[q.montage])
    with pytest.raises(ValueError):
        families.extract(r, [("none", "CAR", 1.0)])


def test_fold_models(spark):
    rows = frame(spark, [(1, k, k % 2, [float(k % 2), float(k)]) for k in range(10)], "config long, subject long, y int, features array<double>")
    p = modelling.loso_boosting(rows, BoostParams(trees=5, depth=2), exclude=[9]).collect()
    assert sorted(r.subject for r in p) == list(range(9)) and {r.y_true for r in p} == {0, 1}
    f = frame(spark, [(k, k % 2, n, [float(k % 2), float(k * w)]) for k in range(12) for n, w in (("a", 1), ("b", 2))], "subject long, y int, family string, features array<double>")
    e = modelling.ensemble(f, spark.createDataFrame([(1, ["a", "b"])], "config long, families array<string>"), BoostParams(trees=5, depth=2, rate=0.3)).collect()
    assert len(e) == 12


def test_edf_round_trip(spark, tmp_path):
    folder = tmp_path / "v2/00_epilepsy/sub/s001_2010/m"
    folder.mkdir(parents=True)
    x = np.random.default_rng(2).normal(size=(2, 30)) * 50
    edf.write_edf(str(folder / "a_t000.edf"), ["EEG FP1-REF", "EEG F3-REF"], x, 10, "x Age:41  F  y")
    (folder / "a.txt").write_bytes("r\xe9sum\xe9".encode("latin-1"))
    r = edf.recordings(spark, str(tmp_path)).collect()
    assert len(r) == 1 and (r[0].age, r[0].gender, r[0].subject, r[0].epilepsy, r[0].report) == (41, "F", "sub", 0, "r\xe9sum\xe9")
    s = edf.signals(edf.discover(spark, str(tmp_path))).orderBy("name").collect()
    assert [q.name for q in s] == ["EEG F3-REF", "EEG FP1-REF"] and np.allclose(s[1].samples, x[0], atol=0.01) and s[0].sfreq == 10


def test_feature_sink_skips_what_is_there(spark, tmp_path):
    path = str(tmp_path / "f")
    one = frame(spark, [(0, "a", "CAR", 1.0, "mean", [1.0])], "rec long, family string, montage string, seconds double, combiner string, features array<double>")
    sinks.write_features(one, path, skip_existing=True)
    sinks.write_features(one, path, skip_existing=True)
    assert sinks.read_features(spark, path, "a", "CAR", 1.0, "mean").count() == 1


def test_stream_segments(spark, tmp_path):
    frame(spark, [("2020-01-01 00:00:01", "a", 2.0), ("2020-01-01 00:00:30", "a", 1.0), ("2020-01-01 00:01:05", "a", 3.0)], "ts string, ch string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, ch string, v double").parquet(str(tmp_path / "in"))
    q = tumbling_energy(s, "1 minute", "10 seconds", ["ch"]).writeStream.outputMode("complete").format("memory").queryName("seg_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.energy for r in spark.table("seg_test").collect()) == [5.0, 9.0]
