"""What a user adds to the engine: aggregates, table functions and transforms under names, used like the built-in ones.

Feature families are added by `families.register_family`. An aggregate is an expression of built-in ones, so Spark sums it up
before the shuffle and a hot group stays small; a table function is a generator over the columns of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "energy": lambda x: F.sum(x * x),
    "rms": lambda x: F.sqrt(F.avg(x * x)),
    "vpp": lambda x: F.max(x) - F.min(x),
}
TRANSFORMS: dict[str, Callable[[Column], Column]] = {}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    """Adds an aggregate: build(column) is an aggregate expression of it."""
    _add(AGGREGATES, "aggregate", name, build)


def register_transform(name: str, build: Callable[[Column], Column]) -> None:
    """Adds a transform of an array of samples (or of a target): build(column) is an expression of it."""
    _add(TRANSFORMS, "transform", name, build)


def _add(known: dict, kind: str, name: str, build: Callable) -> None:
    if not name or not callable(build):
        raise ValueError(f"a registered {kind} needs a name and a function")
    known[name] = build


def _get(known: dict, kind: str, name: str) -> Callable[[Column], Column]:
    if name not in known:
        raise KeyError(f"no {kind} {name!r}; there are {', '.join(sorted(known)) or 'none'}")
    return known[name]


def aggregate(df: DataFrame, keys: list[str], value: str, names: list[str]) -> DataFrame:
    """keys and a column for each named aggregate of `value`, in one pass. Without rows of a group there is none; nulls are
    handled as the built-in aggregates do."""
    return df.groupBy(*keys).agg(*(_get(AGGREGATES, "aggregate", n)(F.col(value)).alias(n) for n in names))


def transformed(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """`column` after the named transforms, from left to right."""
    return df.withColumn(column, reduce(lambda x, n: _get(TRANSFORMS, "transform", n)(x), names, F.col(column)))


def register_table_function(spark: SparkSession, name: str, generate: Callable[..., Iterator[tuple]], schema: StructType | str) -> None:
    """Adds a table function for SQL: generate(column values of a row ...) yields that row's output rows, as in
    `select * from t, lateral name(t.x)`. It must be picklable and see one row alone."""

    class Table:
        def eval(self, *values):
            yield from generate(*values)

    spark.udtf.register(name, F.udtf(Table, returnType=schema))


def window_targets(arrays: DataFrame, misc: list[int], length: int, last_only: bool = True, by: str = "rec") -> DataFrame:
    """arrays (rec, ch, samples) -> rec, seg, samples (channels that aren't misc, in order of ch), target, misc (whose target each is).

    Windows of `length` samples without the incomplete last one, as float. target has, of each misc channel in order of ch, the
    window's last value, or with last_only=False the array of all its values. Channels are cut to the shortest of their
    recording; a recording without misc channels has an empty target and misc, one without other channels empty samples, one
    shorter than a window no rows.
    """
    one = arrays.where(F.col("samples").isNotNull() & F.col("ch").isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ch", F.col("samples").cast("array<float>").alias("samples")))).alias("_c"))
    size = F.array_min(F.transform("_c", lambda c: F.size(c.samples)))
    # as many windows as fit: none when the sequence would run backwards
    starts = F.when(size >= length, F.sequence(F.lit(0), F.floor(size / length).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    cut = one.select(by, "_c", F.explode(starts).alias("seg"))
    kind = lambda c: c.ch.isin(misc) if misc else F.lit(False)
    part = lambda c: F.slice(c.samples, F.col("seg") * length + 1, F.lit(length))
    target = F.transform(F.filter("_c", kind), (lambda c: part(c)[length - 1]) if last_only else part)
    return cut.select(by, F.col("seg").cast("long").alias("seg"), F.transform(F.filter("_c", lambda c: ~kind(c)), part).alias("samples"), target.alias("target"), F.transform(F.filter("_c", kind), lambda c: c.ch).alias("misc"))


def check_targets(names: str | list[str] | tuple[str, ...] | None, columns: list[str]) -> tuple[list[str], list[str]]:
    """The target names as a list, and those among them that `columns` (of a description) lacks; epilepsy, which paths
    tell, is never lacking. Anything but a name, names or none is an error."""
    if names is None:
        return [], []
    if not isinstance(names, (str, tuple, list)):
        raise ValueError("target names must be none, a name or several names")
    wanted = [names] if isinstance(names, str) else list(names)
    return wanted, [n for n in wanted if n != "epilepsy" and n not in columns]
