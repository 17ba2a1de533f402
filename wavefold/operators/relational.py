"""Metadata, selection, alignment and experiment-grid operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .signal import CHANNELS

#: Labels by directory.
LABEL_TOKENS = {"00_epilepsy": 0, "01_no_epilepsy": 1}


def path_description(paths: DataFrame, path: str = "path", keep: tuple[str, ...] = ()) -> DataFrame:
    """version, subject, session, segment, year and label out of .../version/label/subject/sNNN_YYYY/montage/name_tNNN.edf;
    parts that aren't there are null. Columns in `keep` stay."""
    tok = F.split(path, "/")
    last = F.try_element_at(tok, F.lit(-1))
    session = F.try_element_at(tok, F.lit(-3))
    number = lambda c, p: F.try_to_number(F.nullif(F.regexp_extract(c, p, 1), F.lit("")), F.lit("9999999")).cast("int")
    label = F.when(F.array_contains(tok, "00_epilepsy"), 0).when(F.array_contains(tok, "01_no_epilepsy"), 1)
    return paths.select(
        path, F.try_element_at(tok, F.lit(-6)).alias("version"), F.try_element_at(tok, F.lit(-4)).alias("subject"), number(session, r"^s(\d{1,7})").alias("session"),
        number(last, r"_t(\d{1,7})").alias("segment"), number(session, r"_(\d{4})").alias("year"), label.alias("epilepsy"), *keep,
    )


def require_label(described: DataFrame) -> DataFrame:
    """Fails on a row whose directory names no class."""
    return described.withColumn("epilepsy", F.when(F.col("epilepsy").isNull(), F.raise_error(F.concat(F.lit("no label in path "), F.col("path"))).cast("int")).otherwise(F.col("epilepsy")))


def abnormal_labels(paths: DataFrame, path: str = "path") -> DataFrame:
    tok = F.split(path, "/")
    return paths.select(path, F.array_contains(tok, "train").alias("train"), F.array_contains(tok, "abnormal").alias("pathological"))


def age_gender(headers: DataFrame, header: str = "header") -> DataFrame:
    """age from the only Age:digits, else -1; gender from the only F, M or | between white space, else X."""
    age, sex = F.regexp_extract_all(header, F.lit(r"Age:(\d+)"), 1), F.regexp_extract_all(header, F.lit(r"\s([F|M])\s"), 1)
    return headers.select("*", F.when(F.size(age) == 1, age[0].cast("int")).otherwise(-1).alias("age"), F.when(F.size(sex) == 1, sex[0]).otherwise("X").alias("gender"))


def canonical_channel(name: Column) -> Column:
    """EEG FP1-REF -> FP1."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(name, r"-(REF|LE)$", ""), r"^EEG ", "")))


def rename_channels(rows: DataFrame, name: str = "name") -> DataFrame:
    """Adds channel, its row (null outside the canonical set) and kind (eeg, stim or misc)."""
    dim = rows.sparkSession.createDataFrame([(c, k) for k, c in enumerate(CHANNELS)], "channel string, row int")
    x = rows.withColumn("channel", canonical_channel(F.col(name))).join(F.broadcast(dim), "channel", "left")
    return x.withColumn("kind", F.when(F.col("row") == 19, "stim").when(F.col("row").isNotNull(), "eeg").otherwise("misc"))


def sanitise(x: Column) -> Column:
    """NaN and infinities are missing."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def drop_nulls(rows: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return rows.dropna("any")


def cube_root(x: Column) -> Column:
    """Of any sign."""
    return F.cbrt(x)


#: Angles of the channels on the head in degrees, from the top and around it.
POSITIONS = {
    "FP1": (-92, -72), "F3": (-60, -51), "C3": (-46, 0), "P3": (-60, 51), "F7": (-92, -36), "T3": (-92, 0), "T5": (-92, 36), "O1": (-92, 72), "FZ": (46, 90), "CZ": (0, 0),
    "PZ": (46, -90), "FP2": (92, 72), "F4": (60, 51), "C4": (46, 0), "P4": (60, -51), "F8": (92, 36), "T4": (92, 0), "T6": (92, -36), "O2": (92, -72),
}


def positions(spark: SparkSession) -> DataFrame:
    """channel, x, y, z on the unit sphere: x to the right ear, y to the nose, z upwards."""
    a = spark.createDataFrame([(c, float(t), float(p)) for c, (t, p) in POSITIONS.items()], "channel string, theta double, phi double")
    t, p = F.radians("theta"), F.radians("phi")
    return a.select("channel", (F.sin(t) * F.cos(p)).alias("x"), (F.sin(t) * F.sin(p)).alias("y"), F.cos(t).alias("z"))


def pick_channels(rows: DataFrame, wanted: list[str], name: str = "channel") -> DataFrame:
    """Keeps the wanted channels and numbers them in the order of the list; recordings (rec) without all of them go."""
    dim = rows.sparkSession.createDataFrame([(c, k) for k, c in enumerate(wanted)], f"{name} string, ch long")
    own = rows.drop("ch").join(F.broadcast(dim), name)
    whole = own.groupBy("rec").agg(F.countDistinct("ch").alias("_c")).where(F.col("_c") == len(wanted)).select("rec")
    return own.join(whole, "rec", "left_semi")


def magnitude(re: Column, im: Column) -> Column:
    return sanitise(F.hypot(re, im))


def describe(rows: DataFrame, values: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Adds description columns; a name that is there already is an error unless `overwrite`."""
    new = [c for c in values.columns if c not in keys]
    clash = [c for c in new if c in rows.columns]
    if clash and not overwrite:
        raise ValueError(f"columns exist: {clash}")
    return rows.drop(*clash).join(values, keys, "left")


def discard(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(listed, keys, "left_anti")


def include_exclude(rows: DataFrame, key: str, include: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    """Keeps what is included (all without a list), then drops what is excluded; keys are trimmed."""
    out = rows.withColumn("_k", F.trim(F.col(key).cast("string")))
    for other, how in ((include, "left_semi"), (exclude, "left_anti")):
        if other is not None:
            out = out.join(other.select(F.trim(F.col(key).cast("string")).alias("_k")).distinct(), "_k", how)
    return out.drop("_k")


def first_label(rows: DataFrame, key: str, label: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(label, position).alias(label))


def align(left: DataFrame, *others: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Inner join on key with each other source's first row; the left order stays in `position`."""
    out = left
    for k, other in enumerate(others, 2):
        w = Window.partitionBy(key).orderBy(position)
        first = other.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", position)
        out = out.join(first.select(key, *(F.col(c).alias(f"{c}_{k}") for c in first.columns if c != key)), key)
    return out


def assert_aligned(a: DataFrame, b: DataFrame) -> None:
    """Raises ValueError unless both hold the same rows."""
    if a.exceptAll(b).unionAll(b.exceptAll(a)).limit(1).count():
        raise ValueError("subjects or labels differ")


def best_params(features: DataFrame, params: DataFrame) -> DataFrame:
    """Features of the chosen (family, montage, length, combiner); the parameter table is a few rows."""
    return features.join(F.broadcast(params), ["family", "montage", "length", "combiner"], "left_semi")


def config_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of configuration values (a driver-side table), numbered in order of the axes."""
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"_{name} int, {name} {'string' if isinstance(values[0], str) else 'int'}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    size, index = 1, F.lit(0).cast("long")
    for name, values in reversed(axes.items()):
        index = index + F.col(f"_{name}") * size
        size *= len(values)
    return out.select(index.alias("config"), *axes)


def resume_from(grid: DataFrame, config: int | None) -> DataFrame:
    """Skips what comes before a named configuration, then runs it."""
    return grid if config is None else grid.where(F.col("config") >= config)


def skip_existing(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def combinations(spark: SparkSession, families: list[str], least: int, below: int | None = None) -> DataFrame:
    """combo, size, feature_set: the sets of least .. below - 1 families, as bit masks."""
    n = len(families)
    names = F.array(*map(F.lit, families))
    masks = spark.range(1, 1 << n).select(F.col("id").alias("combo"))
    member = F.filter(F.transform(names, lambda x, k: F.when(F.call_function("bit_get", F.col("combo"), k) == 1, x)), lambda x: x.isNotNull())
    return masks.withColumn("size", F.bit_count("combo").cast("long")).where((F.col("size") >= least) & (F.col("size") < (below or n))).withColumn("feature_set", F.concat_ws("+", member))


def ordered_combinations(spark: SparkSession, families: list[str], least: int, below: int | None = None) -> DataFrame:
    """config, families: the sets of least .. below - 1 families, the smaller first and then in the order of the list."""
    n = len(families)
    names = F.array(*map(F.lit, families))
    member = F.filter(F.transform(names, lambda x, k: F.when(F.call_function("bit_get", F.col("mask"), k) == 1, x)), lambda x: x.isNotNull())
    # Sets of a size in the list's order: those with an earlier family first, so the mask's bits are compared from the list's start.
    rank = F.concat(*(F.lit(1) - F.call_function("bit_get", F.col("mask"), F.lit(k)) for k in range(n)))
    sets = spark.range(1, 1 << n).toDF("mask").withColumn("size", F.bit_count("mask")).where((F.col("size") >= least) & (F.col("size") < (below or n)))
    return sets.select((F.row_number().over(Window.orderBy("size", rank)) - 1).cast("long").alias("config"), member.alias("families"))


def restore_order(results: DataFrame, combos: DataFrame, family: str, value: str) -> DataFrame:
    """results (config, family, value) of parallel work: for each combination (config, families) its values in the order
    of its families."""
    asked = combos.select("config", F.posexplode("families").alias("_pos", family))
    return asked.join(results, ["config", family], "left").groupBy("config").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("v")))), lambda x: x.v).alias(value))


def row_splits(rows: DataFrame, key: str) -> DataFrame:
    """Leave one row out: fold, named by the key of the row held out, and how many train, which are all others."""
    n = rows.agg((F.count(F.lit(1)) - 1).alias("n_train"))  # one row
    return rows.select(F.col(key).alias("fold")).crossJoin(F.broadcast(n))


def loso_splits(rows: DataFrame, subject: str, key: str) -> DataFrame:
    """fold (the subject held out), key, role."""
    subjects = rows.select(F.col(subject).alias("fold")).distinct()
    return rows.select(key, subject).crossJoin(F.broadcast(subjects)).select("fold", key, F.when(F.col(subject) == F.col("fold"), "test").otherwise("train").alias("role"))


#: Pairs of a fold and a subject that a task puts in order.
PAIRS = 1_000_000


def train_validation(subjects: DataFrame, subject: str, label: str, share: float = 0.3, seed: int = 0) -> DataFrame:
    """fold, subject, role: the others of a held-out subject are split by label into training and `share` validation, in
    the order of a seeded digest. All subjects meet a fold where it is, and tasks have some PAIRS of both, so the pairs are
    ordered without a shuffle."""
    folds = subjects.select(F.col(subject).alias("fold")).distinct()
    tasks = max(1, -(-folds.count() * subjects.count() // PAIRS))
    x = folds.repartition(tasks, "fold").crossJoin(F.broadcast(subjects.select(subject, label))).where(F.col(subject) != F.col("fold"))
    order = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("fold").cast("string"), F.col(subject).cast("string")))
    w = Window.partitionBy("fold", label)
    k, n = F.row_number().over(w.orderBy(order, subject)), F.count(F.lit(1)).over(w)
    role = F.when(k <= F.round(n * F.lit(share)), "validation").otherwise("train")
    return x.select("fold", subject, label, role.alias("role")).unionByName(subjects.select(F.col(subject).alias("fold"), subject, label, F.lit("test").alias("role")))


def run_seed(name: Column) -> Column:
    """A seed below 5000 out of a run's name."""
    return F.pmod(F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(5000)).cast("int")


def run_name(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("__", *parts), r"[^A-Za-z0-9_.+-]", "_")


def pair_of(index: Column) -> tuple[Column, Column]:
    """(j, k) of the index-th pair j > k in row-major order."""
    j = F.floor((1 + F.sqrt(1 + 8 * index.cast("double"))) / 2).cast("long")
    return j, index - (j * (j - 1) / 2).cast("long")


def plv_name(spark: SparkSession, channels: int = 19) -> DataFrame:
    """idx, name of every phase-locking feature: bands, then pairs."""
    bands, n = F.array(*map(F.lit, ("raw", "delta", "theta", "alpha", "beta", "gamma"))), channels * (channels - 1) // 2
    names = F.array(*map(F.lit, CHANNELS))
    j, k = pair_of(F.col("idx") % n)
    return spark.range(6 * n).select(F.col("id").alias("idx")).withColumn("_j", j).withColumn("_k", k).select("idx", F.concat_ws("_", F.element_at(bands, (F.expr(f"idx div {n}") + 1).cast("int")), F.element_at(names, (F.col("_j") + 1).cast("int")), F.element_at(names, (F.col("_k") + 1).cast("int"))).alias("name"))


def utm_name(spark: SparkSession, channels: int = 19) -> DataFrame:
    metrics = ("mean", "median", "std", "skewness", "kurtosis", "zero_crossings", "nleo_env_diff", "nleo_teager", "energy_time", "energy_freq", "shannon_entropy", "vpp", "npeaks")
    m, names = F.array(*map(F.lit, metrics)), F.array(*map(F.lit, CHANNELS))
    return spark.range(13 * channels).select(F.col("id").alias("idx"), F.concat_ws("_", F.element_at(names, (F.expr("id div 13") + 1).cast("int")), F.element_at(m, (F.col("id") % 13 + 1).cast("int"))).alias("name"))


def spectral_name(spark: SparkSession, channels: int = 19) -> DataFrame:
    m, names = F.array(*map(F.lit, ("delta", "theta", "alpha", "beta", "gamma"))), F.array(*map(F.lit, CHANNELS))
    return spark.range(5 * channels).select(F.col("id").alias("idx"), F.concat_ws("_", F.element_at(m, (F.expr(f"id div {channels}") + 1).cast("int")), F.element_at(names, (F.col("id") % channels + 1).cast("int"))).alias("name"))


def chronological(rows: DataFrame, first: int | None = None) -> DataFrame:
    out = rows.orderBy("year", "month", "day", "subject", "session", "segment")
    return out if first is None else out.limit(first)


def groups_to_ids(rows: DataFrame, by: str, key: str) -> DataFrame:
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def windows_metadata(signal_sizes: DataFrame, length: int) -> DataFrame:
    """i_window, i_start, i_stop of each tumbling window of a recording of n samples."""
    return signal_sizes.withColumn("i_window", F.explode(F.expr(f"case when n >= {length} then sequence(0, n div {length} - 1) else array() end"))).withColumn("i_start", F.col("i_window") * length).withColumn("i_stop", (F.col("i_window") + 1) * length)


def window_slice(arrays: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    return arrays.join(windows, keys).withColumn("samples", F.slice("samples", F.col("i_start").cast("int") + 1, (F.col("i_stop") - F.col("i_start")).cast("int")).cast("array<float>"))


def sampling_frequency(source: Column, sfreq: Column) -> Column:
    return F.when(source == "ips", sfreq).otherwise(250.0)
