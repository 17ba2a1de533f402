"""Sweeps, preparation, reports and stores against direct computation."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.functions.learn import BoostParams, Booster
from wavefold.operators import evaluation, families, modelling, relational, stats, sweeps
from wavefold.plans.experiments import BEST, FAMILIES, PRESETS, Experiment
from wavefold.sources import edf, sinks

SMALL = BoostParams(trees=4, depth=2)
FEATURES = "subject long, y int, family string, montage string, seconds int, combiner string, features array<double>"


def test_twenty_studies(spark):
    assert len(PRESETS) == 20 and all(set(t) == set(FAMILIES) for t in BEST.values())
    runs = {n: sweeps.run_plan(spark, PRESETS[n]).count() for n in ("open_ss_bg_noieds", "open_ss_ips", "clinic_ensemble_hv_responders", "clinic_ss_background", "clinic_ss_hypervent")}
    assert runs == {"open_ss_bg_noieds": 6950, "open_ss_ips": 6000, "clinic_ensemble_hv_responders": 5060, "clinic_ss_background": 4 * 7 * 5 * 5, "clinic_ss_hypervent": 11 * 6 * 5 * 5}
    first = [r.feature_set for r in sweeps.run_plan(spark, PRESETS["open_ensemble_ips"]).where("run = 0").orderBy("run_no").limit(10).collect()]
    assert first == [f"cc+{f}" for f in FAMILIES[1:]] + ["cwt+dwt"]


def features(spark, n=9):
    r = np.random.default_rng(0)
    rows = [(k, k % 2, f, "CAR", 1, "mean", (r.normal(size=3) + k % 2).tolist()) for k in range(n) for f in ("a", "b")]
    return rows, spark.createDataFrame(rows, FEATURES)


def test_a_sweep_is_every_run_of_every_fold(spark):
    rows, df = features(spark)
    e = Experiment("s", ("x",), "single", montages=("CAR",), families=("a", "b"), seconds=(1,), combiners=("mean",), runs=2, exclude=("4",), boost=SMALL)
    got = {(r.run_name, r.subject_id): r for r in sweeps.single_sweep(df, e).collect()}
    assert len(got) == 2 * 2 * 8 and {r.fold_id for r in got.values()} == set(range(8))
    for (name, subject), r in got.items():
        own = [x for x in rows if x[2] == r.family and x[0] != 4]
        train = [x for x in own if x[0] != subject]
        b = Booster(BoostParams(trees=4, depth=2, seed=r.seed)).fit(np.array([x[6] for x in train]), np.array([x[1] for x in train]))
        assert r.y_prob == pytest.approx(b.predict(np.array([x[6] for x in own if x[0] == subject]))[0]) and name == f"{r.family}|CAR|1|mean_run_{r.run}"
    assert sweeps.summaries(sweeps.single_sweep(df, e)).count() == 4
    done = spark.createDataFrame([("a|CAR|1|mean_run_0",)], "run_name string")
    again = Experiment(**{**e.__dict__, "skip_existing": True})
    assert {r.run_name for r in sweeps.single_sweep(df, again, done=done, start="a|CAR|1|mean_run_0").collect()} == {"a|CAR|1|mean_run_1", "b|CAR|1|mean_run_0", "b|CAR|1|mean_run_1"}


def test_validation_is_the_tested_split(spark):
    subjects = spark.createDataFrame([(k, k % 3 % 2) for k in range(14)], "rec long, y long")
    want = {(r.fold, r.rec): r.role for r in relational.train_validation(subjects, "rec", "y", 0.3, 7).collect()}
    ids, y = list(range(14)), [k % 3 % 2 for k in range(14)]
    assert {(f, s): role for f in ids for s, role in zip(ids, modelling.validation_roles(ids, y, f, 0.3, 7), strict=True)} == want


def test_ensembles_need_their_responders(spark):
    _, df = features(spark, 16)
    e = Experiment("s", ("x",), "ensemble", families=("a", "b"), least=2, below=3, runs=1, responders=1, boost=SMALL)
    rows = df.select("subject", "y", "family", "features")
    with pytest.raises(ValueError):
        sweeps.ensemble_sweep(rows, e)
    listed = spark.createDataFrame([(str(k), int(k < 12)) for k in range(16)], "subject string, hv_success int")
    assert sorted(r.subject_id for r in sweeps.ensemble_sweep(rows, e, listed).collect()) == list(range(12))


def test_prepare_joins_sources_by_subject(spark):
    kinds = "source string, subject string, y int, family string, montage string, length int, combiner string, pos int, features array<double>"
    rows = [("b", "1", 0, "f", "CAR", 1, "mean", 1, [9.0]), ("b", "1", 0, "f", "CAR", 1, "mean", 0, [1.0]), ("b", "2", 1, "f", "CAR", 1, "mean", 0, [2.0]), ("i", "1", 0, "f", "Cz", 2, "std", 0, [3.0, 4.0]), ("i", "1", 0, "f", "CAR", 2, "std", 0, [5.0])]
    params = spark.createDataFrame([("b", "f", "CAR", 1, "mean"), ("i", "f", "Cz", 2, "std")], "source string, family string, montage string, length int, combiner string")
    df = spark.createDataFrame(rows, kinds)
    assert [tuple(r) for r in sweeps.prepare(df, params, ["b", "i"]).collect()] == [("1", 0, "f", [1.0, 3.0, 4.0])]
    assert sorted(r.subject for r in sweeps.prepare(df, params, ["b"]).collect()) == ["1", "2"]
    for sources in ([], ["b"] * 4):
        with pytest.raises(ValueError):
            sweeps.prepare(df, params, sources)
    with pytest.raises(Exception, match="differ"):
        sweeps.prepare(df.withColumn("y", F.when(F.col("source") == "i", 1).otherwise(F.col("y"))), params, ["b", "i"]).collect()


def test_averaged_curves_are_interpolated_ones(spark):
    r = np.random.default_rng(3)
    rows = [(g, c, int(r.integers(0, 2)), float(r.integers(0, 12)) / 12) for g in ("a", "b") for c in range(5) for _ in range(40)] + [("a", 9, 1, 0.5)]
    curves = evaluation.roc_curve(spark.createDataFrame(rows, "g string, c int, y_true int, y_prob double"), ["g", "c"])
    points = {}
    for p in curves.where("fpr is not null and tpr is not null").collect():
        points.setdefault((p.g, p.c), []).append((p.fpr, p.tpr))
    for p in evaluation.vertical_averages(curves, ["g"], "c").collect():
        at = []
        for (g, _), q in points.items():
            if g == p.g:
                exact = [t for f, t in q if f == p.fpr]
                xs = sorted({f for f, _ in q})
                left, right = max([x for x in xs if x <= p.fpr]), min([x for x in xs if x >= p.fpr])
                lo, hi = max(t for f, t in q if f == left), min(t for f, t in q if f == right)
                at.append(max(exact) if exact else lo + (hi - lo) * (p.fpr - left) / (right - left))
        assert p.tpr == pytest.approx(np.mean(at))


def test_p_values_are_those_of_the_normal_distribution(spark):
    from math import erfc

    z = [0.0, -0.3, 1.0, 1.96, 3.0, 4.2, 4.3, 6.0, 12.0, None]
    got = [r.p for r in spark.createDataFrame([(k, x) for k, x in enumerate(z)], "k int, z double").withColumn("p", stats.two_sided("z")).orderBy("k").collect()]
    assert got[:-1] == [pytest.approx(erfc(abs(x) / 2**0.5), rel=1e-9) for x in z[:-1]] and got[-1] is None


def test_effects_need_three_folds(spark):
    e = spark.createDataFrame([(f, k, float(x), float(x * k), 2) for f, folds in ((0, 3), (1, 2)) for k in range(folds) for x in range(4)], "feature int, fold int, x double, y double, n long")
    got = stats.aggregate_effects(e, ["feature"], 4).orderBy("x").collect()
    assert {r.feature for r in got} == {0} and [r["mean"] for r in got] == [0.0, 1.0, 2.0, 3.0] and all(r.n == 3 for r in got)


def test_saved_datasets_are_guarded(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0)], "index int, v double")
    assert sinks.save_dataset(rows, path, offset=5) == []
    with pytest.raises(FileExistsError):
        sinks.save_dataset(rows, path, offset=6)
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert sinks.save_dataset(rows.withColumn("v", F.lit(9.0)), path, offset=6, overwrite=True) == [5]
    assert any("5" in str(w.message) for w in seen)
    assert sorted((r["index"], r.v) for r in spark.read.parquet(path).collect()) == [(5, 1.0), (6, 9.0), (7, 9.0)]


def test_sources_without_rows(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_samples(spark.createDataFrame([("ips", 0, 0, [1.0])], "source string, rec long, ch long, samples array<double>"), path)
    assert sinks.read_samples(spark, path, "ips").count() == 1
    with pytest.raises(ValueError):
        sinks.read_samples(spark, path, "hv")
    assert sinks.finished_runs(spark, str(tmp_path / "none"), "p").count() == 0


def test_prediction_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "cc+dwt__run_0.csv").write_text("subject_id,y_true,y_pred,y_prob\na,1,0,0.25\n")
    r = sinks.read_predictions(spark, str(tmp_path)).collect()
    assert [(x.subject_id, x.y_prob, x.run_name, x.parts) for x in r] == [("a", 0.25, "cc+dwt__run_0", ["cc+dwt", "run_0"])]


def test_only_missing_features_are_extracted(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(19, 64))
    r = spark.createDataFrame([(0, c, x[c].tolist()) for c in range(19)], "rec long, ch long, samples array<double>")
    path, grid = str(tmp_path / "f"), [("cc", "CAR", 0.5), ("dwt", "Cz", 0.5)]
    assert sinks.extract_missing(r, grid[:1], path, 32.0) == grid[:1] and sinks.extract_missing(r, grid, path, 32.0) == grid[1:]
    assert sinks.read_features(spark, path, "cc", "CAR", 0.5, "mean").count() == 1 and spark.read.parquet(path).count() == 10


def test_families_can_be_added(spark):
    families.register_family("sums", lambda x, fs, whole: x.sum(axis=2))
    try:
        r = spark.createDataFrame([(0, c, [1.0, 2.0, 3.0, 4.0]) for c in range(19)], "rec long, ch long, samples array<double>")
        got = {q.combiner: q.features for q in families.extract(r, [("sums", "CAR", 0.5)], 4.0).collect()}
        assert got["mean"] == pytest.approx([0.0] * 19, abs=1e-9) and set(got) == set(families.COMBINERS)
    finally:
        del families.FAMILIES["sums"]


def test_only_the_head_of_a_file_is_read(spark, tmp_path):
    folder = tmp_path / "v2/01_no_epilepsy/sub/s002_2011/m"
    folder.mkdir(parents=True)
    (folder / "cut_t001.edf").write_bytes(b"0       X  Age:52  M  y".ljust(88) + b"no valid rest")
    for k in (2, 1):
        (folder / f"r{k}.txt").write_text(f"report {k}")
    (folder / "d.json").write_text('{"date": "2011-05-06"}')
    r = edf.recordings(spark, str(tmp_path)).collect()
    assert [(x.age, x.gender, x.epilepsy, x.report) for x in r] == [(52, "M", 1, "report 1\nreport 2")]
    d = edf.dates(spark, str(tmp_path)).collect()
    assert [str(x.date) for x in d] == ["2011-05-06"] and d[0].folder.endswith("/m")
    assert edf.fake_recording(spark, 3, 10, 2).groupBy("ch").count().count() == 3
