"""Sharding by sampled splitters: shards of near-equal bytes over the order of a hashed text key.

Rows are ordered by a key whose upper bits hash the text and whose lower bits hash a number of the row, so equal texts lie
together and a group of copies, however large and whatever its doc_ids, can still be cut. Keys are sampled with a chance in proportion to a row's size;
quantiles of the sample bound many small ranges and exact sizes are then counted for every range. Groups of equal texts that the
sample shows to hold some `whole_group` of a shard's bytes or more are measured exactly and placed first, the largest
first, each in the fullest shard that still has room for it; the rest of the ranges fills what room is left, in order of keys, and a
range that straddles the edge of a shard is subdivided by its running sum of bytes. So a group is cut only if no
shard has room for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ._common import Stored, ship, table

LOW_BITS = 20


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    h, low = F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), (1 << LOW_BITS) - 1
    return table(docs).select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.shiftright(h, LOW_BITS).alias("_group"), F.shiftleft(F.shiftright(h, LOW_BITS), LOW_BITS).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(low))).alias("_key"),
    )


def _homes(groups: list[tuple[int, int]], shards: int, target: float) -> tuple[dict[int, int], np.ndarray]:
    """(group, bytes) -> the shard of each group (-1: none has room) and the room that is left, by best fit, largest first."""
    room, homes = np.full(shards, target), {}
    for size, group in sorted(((n, g) for g, n in groups), key=lambda x: (-x[0], x[1])):
        fits = np.flatnonzero(room >= size)
        homes[group] = int(fits[np.argmin(room[fits])]) if len(fits) else -1
        if len(fits):
            room[homes[group]] -= size
    return homes, room


def shard(docs: DataFrame, shards: int = 16, ranges_per_shard: int = 64, samples_per_range: int = 32, whole_group: float = 0.01) -> DataFrame:
    """doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes and 1; a null text counts 1. Rows with null or repeated doc_id are placed like all
    others, an empty table gives no rows, other columns aren't looked at. `ranges_per_shard` grows with the number of
    shuffle partitions; the sample is about shards * ranges * samples_per_range keys, whatever the corpus, and at most some
    2 * shards / whole_group groups are placed by themselves. Shards differ by a group that isn't, or by a row.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = Stored(_keyed(docs), "keyed").df  # a row's key stays as it was written, and texts are read once
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(shards * ranges_per_shard, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rate, target = float(ranges * samples_per_range) / max(total, 1), max(total / shards, 1e-9)
    drawn = rows.where(F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < F.col("size") * F.lit(rate)).select("_key", "size")
    sample = sorted((r[0], max(1.0, r[1] * rate)) for r in drawn.collect())
    keys, weight = np.array([k for k, _ in sample], np.int64), np.array([w for _, w in sample], float)
    edges = np.unique(keys[np.searchsorted(np.cumsum(weight), np.linspace(0, weight.sum(), ranges + 1)[1:-1])]) if len(keys) else keys
    seen, own = np.unique(keys >> LOW_BITS, return_inverse=True)
    large = seen[np.bincount(own, weight, len(seen)) >= whole_group * rate * target / 2] if len(keys) else seen
    # A range ends between groups of equal texts, but for those that are placed by themselves.
    edges = np.unique(np.where(np.isin(edges >> LOW_BITS, large), edges, edges >> LOW_BITS << LOW_BITS))

    @F.pandas_udf("boolean")
    def is_large(group: pd.Series) -> pd.Series:
        return pd.Series(np.isin(group.to_numpy(), large))

    exact = rows.where(is_large("_group")).groupBy("_group").agg(F.sum("size").alias("n")) if len(large) else None
    homes, room = _homes([(r[0], r[1]) for r in exact.collect()] if exact is not None else [], shards, target)
    placed_groups = np.array(sorted(homes), np.int64)
    placed_at, ends = np.array([homes[g] for g in sorted(homes)], np.int32), np.cumsum(room)[:-1]

    @F.pandas_udf("range int, home int")
    def range_of(key: pd.Series) -> pd.DataFrame:
        k = key.to_numpy()
        home, g = np.full(len(k), -2, np.int32), k >> LOW_BITS
        if len(placed_groups):
            at = np.minimum(np.searchsorted(placed_groups, g), len(placed_groups) - 1)
            home = np.where(placed_groups[at] == g, placed_at[at], home)
        return pd.DataFrame({"range": np.searchsorted(edges, k, side="right").astype(np.int32), "home": home.astype(np.int32)})

    @F.pandas_udf("int")
    def shard_at(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, at.to_numpy(), side="right").astype(np.int32))

    ranged = rows.withColumn("_r", range_of("_key")).select("*", F.col("_r.range").alias("_range"), F.col("_r.home").alias("_home")).drop("_r")
    ranged = ranged.withColumn("_fill", F.when(F.col("_home") < 0, F.col("size")).otherwise(F.lit(0)))
    sizes = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.sum("_fill")).collect()}  # one number for each range
    starts, at = [], 0
    for k in range(len(edges) + 1):
        starts.append((k, at))
        at += sizes.get(k, 0)
    start = spark.createDataFrame(starts, "_range int, _start long")
    order = Window.partitionBy("_range").orderBy("_key", "doc_id", "text_crc32", "size")
    position = F.col("_start") + F.sum("_fill").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_fill")
    first = F.min("_at").over(Window.partitionBy("_range", "_group"))
    placed = (
        ranged.join(F.broadcast(start), "_range").withColumn("_at", position)
        .withColumn("_at", F.when(F.col("_home") == -2, first).otherwise(F.col("_at")))
        .withColumn("shard", F.when(F.col("_home") >= 0, F.col("_home")).otherwise(shard_at("_at")))
        .select("doc_id", "size", "text_crc32", "shard", "_range", "_key", F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "doc_id", "text_crc32", "size")).alias("_rank"))
    )
    kept = Stored(placed, "shards").df
    counts = kept.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))  # at most ranges + shards rows
    before = counts.select("shard", "_range", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_range")) - F.col("_n")).alias("_before"))
    return kept.join(F.broadcast(before), ["shard", "_range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_before") + F.col("_rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
