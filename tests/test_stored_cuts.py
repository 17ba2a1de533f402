"""A result rests on one reading of the approximate quantiles."""

from wavefold.operators import ranges
from wavefold.plans import registry

registry.load()


def test_cuts_are_read_and_not_made_again(spark):
    rows = spark.range(1000).selectExpr("id % 3 as g", "double(id) as v")
    parted = ranges.cut(rows, ["g"], "v", size=50)
    assert "percentile_approx" not in parted._jdf.queryExecution().toString()
    assert parted.groupBy("g", "_part").count().count() == 21


def test_roc_by_ranges_makes_no_cuts_when_it_runs(spark):
    made = registry.QUERIES["roc_by_ranges"](spark, "/root/testdata/sf0.001")
    assert "percentile_approx" not in made._jdf.queryExecution().toString()
