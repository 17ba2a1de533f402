"""Sinks: Parquet tables partitioned by what later reads prune on, and the scans that go with them."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

FEATURE_KEYS = ["family", "montage", "seconds", "combiner"]


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or none where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# Signals


def write_samples(samples: DataFrame, path: str) -> None:
    """Prepared recordings (source, rec, ch, samples, ...), one folder for each source; only those written are replaced."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_samples(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One source's recordings; an error where it has none."""
    rows = spark.read.parquet(path).where(F.col("source") == source)
    if not rows.limit(1).count():
        raise ValueError(f"no samples of source {source!r}")
    return rows


def write_periods(periods: DataFrame, path: str, overwrite: bool = False) -> None:
    """Periods with and without stimulus, one folder for each kind."""
    periods.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("kind").parquet(path)


def save_dataset(rows: DataFrame, path: str, offset: int = 0, overwrite: bool = False) -> list[int]:
    """Recordings (index, ...), one folder for each index + offset. Without `overwrite` an index that is there is an error;
    with it those written are replaced; how many others stay is warned of, and the first ten are returned."""
    own = rows.withColumn("index", F.col("index") + offset)
    before = _there(rows.sparkSession, path)
    old = before.select("index").distinct() if before is not None else None
    if old is not None and not overwrite and (clash := old.join(own.select("index"), "index", "left_semi").limit(1).collect()):
        raise FileExistsError(f"recording {clash[0][0]} is there already")
    others = None if old is None else old.join(own.select("index"), "index", "left_anti")
    count, left = (0, []) if others is None else (others.count(), [r[0] for r in others.orderBy("index").limit(10).collect()])
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index").parquet(path)
    if count:
        warnings.warn(f"{path} also holds {count} recordings that were not written now: {left}{' ...' if count > 10 else ''}", stacklevel=2)
    return left


# Features


def write_features(features: DataFrame, path: str, skip_existing: bool = False) -> None:
    """One folder for each family, montage, length and combiner; only those written are replaced. `skip_existing` leaves
    partitions that are there as they are."""
    if skip_existing and (old := _there(features.sparkSession, path)) is not None:
        features = features.join(old.select(*FEATURE_KEYS).distinct(), FEATURE_KEYS, "left_anti")
    features.write.mode("append" if skip_existing else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FEATURE_KEYS).parquet(path)


def read_features(spark: SparkSession, path: str, family: str, montage: str, seconds: float, combiner: str) -> DataFrame:
    """The partition alone is read."""
    return spark.read.parquet(path).where((F.col("family") == family) & (F.col("montage") == montage) & (F.col("seconds") == seconds) & (F.col("combiner") == combiner))


def extract_missing(recordings: DataFrame, grid: list[tuple[str, str, float]], path: str, fs: float) -> list[tuple[str, str, float]]:
    """Extracts what of a grid (family, montage, seconds) the table at a path lacks and adds it; returns what was added."""
    from ..operators import families

    old = _there(recordings.sparkSession, path)
    done = set() if old is None else {(r[0], r[1], float(r[2])) for r in old.select("family", "montage", "seconds").distinct().collect()}  # a grid's points
    missing = [g for g in grid if (families.ALIASES.get(g[0], g[0]), g[1], float(g[2])) not in done]
    if missing:
        write_features(families.extract(recordings, missing, fs), path, skip_existing=True)
    return missing


# Runs


def append_run(rows: DataFrame, path: str, **keys: str | int) -> None:
    """Predictions or summaries of runs; key columns that are missing are filled in. One folder for each project and run."""
    for name, value in keys.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    rows.write.mode("append").partitionBy(*[k for k in ("project_name", "run_name") if k in rows.columns]).parquet(path)


def finished_runs(spark: SparkSession, path: str, project: str) -> DataFrame:
    """run_name of a project's runs that are there, in a table of outputs or in the run log; none where there is no table."""
    rows = _there(spark, path)
    return spark.createDataFrame([], "run_name string") if rows is None else rows.where(F.col("project_name") == project).select("run_name").distinct()


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Appends to the run log, the place of an external tracking service."""
    metrics.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """CSV predictions of a folder, with the file's name split into its parts."""
    rows = spark.read.option("header", True).csv(root, schema="subject_id string, y_true int, y_pred int, y_prob double")
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return rows.select("*", name.alias("run_name"), F.split(name, "__").alias("parts"))


# Curves and effects


def write_roc(curves: DataFrame, areas: DataFrame, path: str) -> None:
    """Averaged curves (curve, fpr, tpr) with their areas (curve, area); curves of other names stay."""
    curves.join(areas, "curve").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("curve").parquet(path)


def write_effects(effects: DataFrame, path: str, name: str) -> None:
    """Effects over folds under a name; others' stay."""
    effects.withColumn("result", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("result").parquet(path)


def list_effects(spark: SparkSession, path: str) -> DataFrame:
    """result, features, points of every stored result."""
    return spark.read.parquet(path).groupBy("result").agg(F.countDistinct("feature").alias("features"), F.count(F.lit(1)).alias("points"))


def read_effects(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("result") == name)
