"""The modelling queries take whole feature vectors."""

from pyspark.sql import functions as F

from wavefold.functions.learn import BoostParams
from wavefold.plans import model_queries as q, registry

DATA = "/root/testdata/sf0.001"
#: One channel's measures, or bands, times output channels.
LENGTHS = {1: 95, 3: 432}


def test_models_see_every_feature(spark, monkeypatch):
    monkeypatch.setattr(q, "_SMALL", BoostParams(trees=1, depth=1))  # which features are there doesn't hang on the trees
    got = {}
    for r in registry.QUERIES["shap_mean_abs"](spark, DATA).select("config", "feature").collect():
        got.setdefault(r.config, set()).add(r.feature)
    assert {c: len(got[c]) for c in LENGTHS} == LENGTHS and len(got[2]) > 12
    assert all(f == set(range(len(f))) for f in got.values())


def test_configurations_are_numbered_combiner_by_combiner(spark):
    size = {r.config: r.n for r in q._configs(spark, DATA).groupBy("config").agg(F.max(F.size("features")).alias("n")).collect()}
    assert sorted(size) == list(range(1, 16)) and all(size[k] == size[(k - 1) % 3 + 1] for k in size)
    assert {c: size[c] for c in LENGTHS} == LENGTHS and size[2] > 12
