"""Sweeps over subjects with text names, complete ensembles, lost folds, the stacker's prior, the run log, curves of several studies."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.functions.learn import BoostParams, simplex_stacker
from wavefold.operators import modelling, sweeps
from wavefold.plans import experiments
from wavefold.sources import sinks

SMALL = BoostParams(trees=3, depth=2, rate=0.3)
NAMES = ["aaaaajgj", "aaaaakcd", *(f"aaaaab{a}{b}" for a in "abc" for b in "xyz")]


def rows(spark, families=("cc", "utm"), skip=(), y=lambda k: k % 2):
    r = np.random.default_rng(0)
    data = [(s, y(k), f, r.normal(size=4).tolist()) for k, s in enumerate(NAMES) for f in families if (s, f) not in skip]
    return spark.createDataFrame(data, "subject string, y int, family string, features array<double>")


def study(**more):
    return replace(experiments.PRESETS["open_ensemble_ips_noieds"], families=("cc", "utm"), least=1, below=3, runs=1, boost=SMALL, **more)


def test_sweep_from_preparation_to_predictions(spark):
    e = study()
    raw = rows(spark).select(F.lit("open_ips").alias("source"), "subject", "y", "family", F.lit("CAR").alias("montage"), F.lit(1).alias("length"), F.lit("mean").alias("combiner"), "features", F.lit(0).alias("pos"))
    params = spark.createDataFrame([("open_ips", f, "CAR", 1, "mean") for f in e.families], "source string, family string, montage string, length int, combiner string")
    got = sweeps.ensemble_sweep(sweeps.prepare(raw, params, ["open_ips"]), e)
    want = sorted(set(NAMES) - set(experiments.WITH_DISCHARGES))
    seen = got.select("run_name", "subject_id", "fold_id").collect()
    assert sorted(map(tuple, seen)) == sorted((f"{c}_run_0", s, k) for c in ("cc", "utm", "cc+utm") for k, s in enumerate(want))
    assert got.where("y_prob is null").count() == 0
    assert sweeps.summaries(got).select("lost_folds").distinct().collect()[0][0] == 0


def test_single_sets_on_names(spark):
    e = replace(experiments.PRESETS["open_ss_ips_noieds"], montages=("CAR",), families=("cc",), seconds=(1,), combiners=("mean",), runs=2, boost=SMALL)
    f = rows(spark, ("cc",)).withColumns({"montage": F.lit("CAR"), "seconds": F.lit(1), "combiner": F.lit("mean")})
    got = sweeps.single_sweep(f, e)
    assert got.count() == 2 * 9 and {r.subject_id for r in got.collect()} == set(NAMES) - set(experiments.WITH_DISCHARGES)


def test_an_absent_family_is_an_error(spark):
    with pytest.raises(ValueError, match="no features of utm"):
        sweeps.ensemble_sweep(rows(spark, ("cc",)), study())
    twice = rows(spark).union(rows(spark).where(F.col("subject") == NAMES[-1]))
    with pytest.raises(Exception, match="has several rows of"):
        sweeps.ensemble_sweep(twice, study()).collect()


def test_folds_that_cannot_learn_have_rows(spark):
    got = sweeps.ensemble_sweep(rows(spark, y=lambda k: int(k == 5)), study())
    assert got.count() == 27 and got.where("y_prob is null and y_pred is null").count() == 27
    s = {r.run_name: (r.lost_folds, r.auc) for r in sweeps.summaries(got).collect()}
    assert set(s.values()) == {(9, None)} and len(s) == 3
    lacking = sweeps.ensemble_sweep(rows(spark, skip={(NAMES[-1], "utm")}), study())
    lost = {(r.run_name, r.subject_id) for r in lacking.where("y_prob is null").collect()}
    assert lost == {("cc+utm_run_0", NAMES[-1])}
    assert {r.run_name: r.lost_folds for r in sweeps.summaries(lacking).collect()} == {"cc_run_0": 0, "utm_run_0": 0, "cc+utm_run_0": 1}


def test_shapley_values_and_effects_on_names(spark):
    own = rows(spark, ("cc",)).select(F.lit(1).cast("long").alias("config"), "subject", "y", "features")
    assert {r.subject for r in modelling.loso_shap(own, SMALL).collect()} == set(NAMES)
    assert {r.fold for r in modelling.loso_ale(own, [0], SMALL, 3).collect()} == set(NAMES)
    few = own.where(F.col("subject").isin(NAMES[:3])).union(own.limit(1).withColumn("subject", F.lit(None).cast("string")))
    assert sorted(r.subject for r in modelling.loso_boosting(few, SMALL).collect()) == sorted(NAMES[:3])


def test_the_stacker_s_weights_are_at_the_optimum_of_its_prior():
    r = np.random.default_rng(1)
    z, y = r.normal(size=(60, 3)), r.integers(0, 2, 60)
    z[:, 0] += 2 * y - 1

    def loss(w, alpha):
        return np.logaddexp(0, -np.where(y == 1, 1, -1) * (z @ w)).sum() - (alpha - 1) * np.log(w).sum()

    assert experiments.Experiment("e", ("s",), "ensemble").prior == 1.05
    found = {}
    for alpha in (1.05, 3.0):
        w = simplex_stacker(z, y, alpha)
        assert w.sum() == pytest.approx(1) and (w > 0).all()
        for a in range(3):
            for b in range(3):
                for step in (1e-3, 1e-2):
                    other = w.copy()
                    step = min(step, other[b] / 2)
                    other[a], other[b] = other[a] + step, other[b] - step
                    assert loss(other, alpha) >= loss(w, alpha) - 1e-6
        found[alpha] = w
    assert np.allclose(simplex_stacker(z, y), found[1.05]) and np.abs(found[3.0] - 1 / 3).max() < np.abs(found[1.05] - 1 / 3).max()


def test_runs_in_the_log_are_left_out_where_the_study_says_so(spark, tmp_path):
    assert {n for n, e in experiments.PRESETS.items() if e.check_log} == {"open_ensemble_ips", "open_ensemble_ips_noieds", "clinic_ensemble_hv_all", "clinic_ensemble_ips_bg", "clinic_ensemble_ips_bg_hv"}
    e = study()
    log = str(tmp_path / "log")
    sinks.log_metrics(spark.createDataFrame([(e.name, "cc_run_0", 0.5), ("another", "utm_run_0", 0.5)], "project_name string, run_name string, auc double"), log)
    names = sinks.finished_runs(spark, log, e.name)
    plan = lambda e: {r.run_name for r in sweeps.run_plan(spark, e, logged=names).collect()}
    assert plan(e) == {"utm_run_0", "cc+utm_run_0"}
    assert plan(replace(e, check_log=False)) == {"cc_run_0", "utm_run_0", "cc+utm_run_0"}


def test_curves_of_other_studies_stay(spark, tmp_path):
    path = str(tmp_path / "roc")
    for name, tpr in (("a", 0.1), ("b", 0.2), ("a", 0.3)):
        sinks.write_roc(spark.createDataFrame([(name, 0.0, tpr)], "curve string, fpr double, tpr double"), spark.createDataFrame([(name, 0.5)], "curve string, area double"), path)
    assert sorted((r.curve, r.tpr) for r in spark.read.parquet(path).collect()) == [("a", 0.3), ("b", 0.2)]
