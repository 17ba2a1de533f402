"""Experiments: the runs that a configuration asks for, the data they are trained on, and the tables they leave.

A sweep is one job: its runs are rows of a plan, each run's feature rows are joined to it by configuration, and every fold
of every run is a piece of work that Spark deals out. What a sweep returns are the predictions, one row for each tested
recording; summaries and reports are aggregates over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.experiments import Experiment
from ..sources import shared
from . import evaluation, modelling, relational

RUN = ["project_name", "mode", "run", "seed", "run_name", "feature_set"]
PARAMETERS = ["montage", "family", "seconds", "combiner"]


def run_plan(spark: SparkSession, e: Experiment, done: DataFrame | None = None, start: str | None = None, logged: DataFrame | None = None) -> DataFrame:
    """Every run of an experiment in its order: run_no, project_name, mode, run, seed, run_name, feature_set, and the
    parameters of a single set or the families of an ensemble.

    Runs come configuration by configuration. Those before the run called `start` are skipped, and so are, if the
    experiment says so, runs whose name is in `done` or in `logged` (run_name): finished outputs (`skip_existing`) and the
    project's log of runs (`check_log`). A run's seed follows from its name.
    """
    if e.mode == "single":
        grid = relational.config_grid(spark, montage=list(e.montages), family=list(e.families), seconds=list(e.seconds), combiner=list(e.combiners))
        if e.skip:
            grid = grid.where(f"not ({e.skip})")
        what, own = F.concat_ws("|", "family", "montage", F.col("seconds").cast("string"), "combiner"), [*PARAMETERS]
    else:
        grid = relational.ordered_combinations(spark, list(e.families), e.least, e.below)
        what, own = F.concat_ws("+", "families"), ["families"]
    runs = grid.withColumn("feature_set", what).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(e.runs - 1))))
    named = runs.withColumn("run_name", F.concat("feature_set", F.lit("_run_"), F.col("run").cast("string"))).withColumn("run_no", F.col("config") * e.runs + F.col("run"))
    plan = named.select("run_no", F.lit(e.name).alias("project_name"), F.lit(e.mode).alias("mode"), "run", relational.run_seed(F.col("run_name")).alias("seed"), "run_name", "feature_set", *own)
    if start is not None:
        first = plan.where(F.col("run_name") == start).agg(F.min("run_no").alias("_first"))  # one number
        plan = plan.crossJoin(F.broadcast(first)).where("run_no >= _first").drop("_first")
    for wanted, names in ((e.skip_existing, done), (e.check_log, logged)):
        if wanted and names is not None:
            plan = relational.skip_existing(plan, names, ["run_name"])
    return plan


def prepare(features: DataFrame, params: DataFrame, sources: list[str]) -> DataFrame:
    """features (source, subject, y, family, montage, length, combiner, features), params (source, family, montage, length,
    combiner) -> subject, y, family, features: what is best for each family in each source, the sources' vectors one after
    the other for subjects that all of them have.

    A source's rows are its first for a subject. One to three sources; subjects whose label differs between them are an error.
    """
    if not 1 <= len(sources) <= 3:
        raise ValueError(f"one, two or three sources, not {len(sources)}")
    keys = ["source", "family", "montage", "length", "combiner"]
    chosen = features.where(F.col("source").isin(sources)).join(F.broadcast(params.select(*keys).distinct()), keys, "left_semi")
    first = chosen.groupBy("subject", "family", "source").agg(F.min_by(F.struct("y", "features"), "pos").alias("r"))
    row = lambda s: F.max(F.when(F.col("source") == s, F.col("r"))).alias(f"_{sources.index(s)}")
    wide = first.groupBy("subject", "family").agg(*map(row, sources))
    parts = [F.col(f"_{k}") for k in range(len(sources))]
    both = wide.where(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]))
    same = reduce(lambda a, b: a & b, [parts[0].y == p.y for p in parts], F.lit(True))
    y = F.when(same, parts[0].y).otherwise(F.raise_error(F.concat(F.lit("labels of subject "), F.col("subject").cast("string"), F.lit(" differ"))).cast("int"))
    return both.select("subject", y.alias("y"), "family", F.concat(*(p.features for p in parts)).alias("features"))


def preload(rows: DataFrame) -> DataFrame:
    """Prepared rows, kept in the shared folder by family, so that every sweep after reads them instead of preparing again."""
    path = shared.folder(rows.sparkSession, "prepared")
    rows.write.partitionBy("family").parquet(path)
    return rows.sparkSession.read.parquet(path)


def fetch(preloaded: DataFrame, family: str) -> DataFrame:
    """One family's rows; the others' files aren't read."""
    return preloaded.where(F.col("family") == family)


def _subjects(rows: DataFrame, e: Experiment, responders: DataFrame | None) -> DataFrame:
    """Keeps the subjects of an experiment; responders (subject, hv_success) are asked for where it names them."""
    include = None
    if e.responders is not None:
        if responders is None:
            raise ValueError(f"{e.name} needs the list of responders")
        include = responders.where(F.col("hv_success") == e.responders).select("subject")
    exclude = rows.sparkSession.createDataFrame([(s,) for s in e.exclude], "subject string") if e.exclude else None
    return relational.include_exclude(rows, "subject", include, exclude)


def _predictions(made: DataFrame, plan: DataFrame) -> DataFrame:
    """The standard columns; fold_id numbers subjects in their order."""
    fold = F.dense_rank().over(Window.partitionBy("config").orderBy("subject")) - 1
    return made.withColumn("fold_id", fold).join(F.broadcast(plan), made["config"] == plan["run_no"]).select(*RUN, *(c for c in PARAMETERS if c in plan.columns), "fold_id", F.col("subject").alias("subject_id"), "y_true", "y_pred", "y_prob")


def single_sweep(features: DataFrame, e: Experiment, responders: DataFrame | None = None, done: DataFrame | None = None, start: str | None = None, logged: DataFrame | None = None) -> DataFrame:
    """features (subject, y, family, montage, seconds, combiner, features): predictions of every run of every configuration,
    each subject's by trees that learned from the others."""
    plan = run_plan(features.sparkSession, e, done, start, logged)
    rows = _subjects(features, e, responders).join(F.broadcast(plan), PARAMETERS)  # a plan is a few thousand rows
    made = modelling.loso_boosting(rows.select(F.col("run_no").alias("config"), "subject", "y", "features", "seed"), e.boost)
    return _predictions(made, plan)


def ensemble_sweep(rows: DataFrame, e: Experiment, responders: DataFrame | None = None, done: DataFrame | None = None, start: str | None = None, logged: DataFrame | None = None) -> DataFrame:
    """rows of prepare(): predictions of every run of every combination of families by two-stage ensembles."""
    plan = run_plan(rows.sparkSession, e, done, start, logged)
    made = modelling.ensemble(_subjects(rows, e, responders), plan.select(F.col("run_no").alias("config"), "families", "seed"), e.boost, e.validation, e.prior)
    return _predictions(made, plan)


def summaries(predictions: DataFrame) -> DataFrame:
    """One row for each run: its keys and metrics, and in lost_folds how many subjects it couldn't predict, which metrics leave
    out; a run that lost all has no metrics. Predictions are stored, as they are read several times."""
    predictions = shared.store(predictions, "predictions")
    keys = [c for c in [*RUN, *PARAMETERS] if c in predictions.columns]
    lost = predictions.groupBy(*keys).agg(F.count_if(F.col("y_prob").isNull()).alias("lost_folds"))
    return lost.join(evaluation.summary(predictions.where("y_prob is not null"), keys), keys, "left")


METRICS = ["accuracy", "bac", "bac80", "f1_score", "precision", "recall", "auc", "auprc", "ap"]


def report(predictions: DataFrame, of: list[str], within: Column, score: Column, threshold: float = 0.6) -> dict[str, DataFrame]:
    """Tables of a report over runs of configurations `of`: "summary" (every run), "means", "best" (the configuration of the
    best mean score in each group `within`, ties to the least name), "std" (over the best ones' runs), "roc" (their runs'
    curves averaged at every FPR), "area" (under those), and "slope" of the line on which a positive is right with
    `threshold`."""
    each = evaluation.summary(predictions, [*of, "run"])
    stats = evaluation.mean_std(each, of, METRICS)
    means = stats.select(*of, *(F.col(f"{m}_mean").alias(m) for m in METRICS)).withColumn("group", within)
    best = evaluation.best_of(means, ["group"], F.round(score, 9), of)
    std = stats.join(best.select(*of, "group"), of).select(*of, "group", *(F.col(f"{m}_std").alias(m) for m in METRICS))
    chosen = predictions.join(best.select(*of), of, "left_semi")
    curves = evaluation.roc_curve(chosen, [*of, "run"])
    roc = evaluation.vertical_averages(curves, of, "run")
    return {"summary": each, "means": means, "best": best, "std": std, "roc": roc, "area": evaluation.curve_area(roc, of), "slope": evaluation.posterior_slope(chosen, of, threshold)}


def ensemble_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Combinations (feature_set): the best of each number of families by AUC and area under precision and recall."""
    return report(predictions, ["feature_set"], F.size(F.split("feature_set", r"\+")), F.col("auc") + F.col("auprc"))


def single_report(predictions: DataFrame) -> dict[str, DataFrame]:
    """Configurations of single sets: the best of each family by AUC and balanced accuracy at a sensitivity of 0.8."""
    return report(predictions, ["family", "montage", "seconds", "combiner"], F.col("family"), F.col("auc") + F.col("bac80"))
