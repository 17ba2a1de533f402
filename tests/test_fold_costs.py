"""What a fold costs: every fold is fitted once, in tasks that aren't put together by size, and a split's temporaries stay small."""

import tracemalloc

import numpy as np
import pytest

from wavefold.functions.learn import Booster, BoostParams
from wavefold.operators import modelling, stats
from wavefold.plans import experiment_queries, model_queries, registry

registry.load()
DATA = "/root/testdata/sf0.001"
TINY = BoostParams(trees=1, depth=1)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_a_splits_temporaries_are_small():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(400, 300)), r.integers(0, 2, 400)
    tracemalloc.start()
    Booster(BoostParams(trees=2, depth=3)).fit(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * x.nbytes


def best_cut(x, g, h, p):
    """Feature, cut and side of missing values of the best split of all rows, one after the other; of equals the first."""
    best, gs, hs = None, g.sum(), h.sum()
    for f in range(x.shape[1]):
        v = x[:, f]
        gone, places = np.isnan(v), np.unique(v[~np.isnan(v)])
        for side in (True, False) if gone.any() else (False,):
            for a, b in zip(places[:-1], places[1:]):
                left = np.where(gone, side, v <= (a + b) / 2)
                gl, hl = g[left].sum(), h[left].sum()
                if hl >= p.least_weight and hs - hl >= p.least_weight:
                    gain = gl**2 / (hl + p.ridge) + (gs - gl) ** 2 / (hs - hl + p.ridge)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, f, (a + b) / 2, side
    return best and best[1:]


@pytest.mark.parametrize("seed", range(12))
def test_first_cut_is_the_best_whatever_the_features_kinds(seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(60, 7))
    x[:, 1:3], x[:, 3], x[:, 5] = np.round(x[:, 1:3]), np.nan, 1.0
    x[r.random(60) < 0.3, 2], x[r.random(60) < 0.2, 4] = np.nan, np.nan
    x = x[:, r.permutation(7)]
    y = (np.nan_to_num(x).sum(axis=1) + r.normal(size=60) > 0.5).astype(int)
    p = BoostParams(trees=1, depth=1, subsample=1.0, gamma=0.0, balance=False)
    (feature, cut, _, _, left, *_), want = Booster(p).fit(x, y).trees[0], best_cut(x, 0.5 - y, np.full(60, 0.25), p)
    assert (int(feature[0]), bool(left[0])) == (want[0], want[2]) and np.isclose(cut[0], want[1])


def test_folds_are_dealt_to_counted_tasks(spark):
    rows = spark.createDataFrame([(1, s, s % 2, [float(s)]) for s in range(20)], "config long, subject int, y int, features array<double>")
    assert f"], {modelling.TASKS * modelling.PARTS}\n" in plan(modelling.loso_boosting(rows, TINY))


def test_effects_are_stored(spark):
    rows = spark.createDataFrame([(1, s, s % 2, [float(s), s * s / 7]) for s in range(8)], "config long, subject int, y int, features array<double>")
    effects = modelling.loso_ale(rows, None, TINY, 3)
    made = stats.aggregate_effects(effects, ["config", "feature"], 5)
    assert "FlatMapGroupsInPandas" in plan(effects) and "FlatMapGroupsInPandas" not in plan(made) and made.count()


def test_predictions_of_metrics_are_stored(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "_SMALL", TINY)
    assert "FlatMapGroupsInPandas" not in plan(registry.QUERIES["loso_metrics"](spark, DATA))


def test_predictions_of_summaries_are_stored(spark, monkeypatch):
    monkeypatch.setattr(experiment_queries, "_SMALL", TINY)
    assert "FlatMapGroupsInPandas" not in plan(registry.QUERIES["single_sweep_summaries"](spark, DATA))


def test_effects_of_moved_features_are_those_of_the_whole_prediction():
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 4))
    x[r.random(50) < 0.2, 1] = np.nan
    model = Booster(BoostParams(trees=6, depth=3)).fit(x, (x[:, 0] > 0).astype(int))
    moved = model.moved(x)
    for f in range(4):
        rows = np.flatnonzero(~np.isnan(x[:, f]))
        other = x[rows].copy()
        other[:, f] = values = r.normal(size=len(rows))
        assert np.array_equal(moved(f, rows, values), model.predict(other))
