"""Boosting over many tasks gives the trees of the fit in one."""

import numpy as np
import pytest

from wavefold.functions.learn import Booster, BoostParams
from wavefold.operators import boosting

R = np.random.default_rng(4)
X = np.round(R.normal(size=(150, 5)), 2)
X[R.random(X.shape) < 0.1] = np.nan
X[:, 4] = R.integers(0, 3, 150)
Y = (np.nan_to_num(X[:, 0]) + 0.5 * X[:, 4] + R.normal(size=150) * 0.3 > 0.5).astype(int)


def table(spark, x=X, y=Y, parts=5):
    rows = [(f"r{k}", int(b), [None if np.isnan(v) else float(v) for v in a]) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id string, y int, features array<double>").repartition(parts)


def test_trees_are_those_of_one_fit(spark, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)
    p = BoostParams(trees=5, depth=3, subsample=1.0, rate=0.3)
    own, one = boosting.fit(table(spark), p), Booster(p).fit(X, Y)
    assert len(own.trees) == 5 and np.allclose(own.predict(X), one.predict(X))
    for a, b in zip(own.trees, one.trees, strict=True):
        assert sorted(a[0][a[0] >= 0]) == sorted(b[0][b[0] >= 0]) and np.allclose(np.sort(a[6]), np.sort(b[6]))
    got = {r.id: r.y_prob for r in boosting.predict(table(spark), own).collect()}
    assert [got[f"r{k}"] for k in range(150)] == pytest.approx(one.predict(X).tolist())


def test_few_bins_and_drawn_rows_still_learn(spark):
    model = boosting.fit(table(spark), BoostParams(trees=8, depth=2, subsample=0.7, rate=0.3), bins=8)
    p = model.predict(X)
    assert p[Y == 1].mean() - p[Y == 0].mean() > 0.3
    again = boosting.fit(table(spark, parts=2), BoostParams(trees=8, depth=2, subsample=0.7, rate=0.3), bins=8)
    assert np.allclose(again.predict(X), p)


def test_odd_rows(spark):
    assert boosting.fit(table(spark).limit(0)).trees == []
    p = BoostParams(trees=2, depth=2)
    same = boosting.fit(table(spark, y=np.ones(150, int)), p)
    assert np.allclose(same.predict(X), Booster(p).fit(X, np.ones(150)).predict(X))
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 0, [1.0]), ("c", None, [1.0]), ("d", 1, None), ("e", 0, [])], "id string, y int, features array<double>")
    model = boosting.fit(rows, p)
    assert len(model.trees) == 2 and boosting.predict(rows, model).count() == 5
