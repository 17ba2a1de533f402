"""Pairs of folds and subjects aren't shuffled."""

from wavefold.operators import relational


def test_no_pair_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(relational, "PAIRS", 100)
    subjects = spark.createDataFrame([(k, k % 3 if k % 5 else None) for k in range(40)], "rec long, y long")
    split = relational.train_validation(subjects, "rec", "y", 0.3, 1)
    plan = split._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin")
    assert len(plan) == 2 and "Exchange" not in plan[0]
    rows = split.collect()
    assert len(rows) == len({(r.fold, r.rec) for r in rows}) == 1600
    for f in range(40):
        for y in (None, 0, 1, 2):
            own = [r.role for r in rows if r.fold == f and r.y == y and r.rec != f]
            assert own.count("validation") == int(len(own) * 0.3 + 0.5) and own.count("train") == len(own) - own.count("validation")
