"""Operators on recordings too long for one task: filters that go on from block to block, and peaks with a least distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import numeric
from ..sources import shared
from . import ranges


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def _after(a: np.ndarray, order: int, n: int) -> np.ndarray:
    """What n samples without input make of each state, column by column, with more digits than a double has."""
    return numeric.lfilter_from(np.zeros(order + 1), a, np.zeros((order, n), np.longdouble), np.eye(order, dtype=np.longdouble))[1].T


def _pair(z: np.ndarray) -> np.ndarray:
    """Numbers of more digits than a double has as two doubles, one after the other."""
    high = z.astype(float)
    return np.concatenate([high, (z - high).astype(float)], axis=-1)


def iir_blocks(blocks: DataFrame, keys: list[str], filters: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """blocks (keys, block, samples) -> keys, block, band, samples: each recording, whose blocks follow each other in the order
    of `block`, through each filter (b, a) from rest, block by block.

    A block changes the filter's state in a linear way that its length alone gives, and adds what it would leave from rest.
    So blocks are first filtered from rest for what they leave, the states between blocks are put together in order
    (one short row a block), and then each block is filtered from its own state. All of it is done with more digits than a
    double has, as a narrow band's state asks for; still, an eighth-order band of 4 to 8 Hz at 250 Hz keeps but five digits
    (measured over 1,000 samples: 1e-5, where one pass has 3e-8), wider ones and those of lower order nine and more. Empty blocks have empty samples, null ones
    are taken as empty, null samples as 0.
    """
    made = {n: (np.asarray(b, float), np.asarray(a, float), max(len(a), len(b)) - 1) for n, (b, a) in filters.items()}
    names = [*keys, "block"]
    rows = shared.store(blocks.select(*names, F.transform(F.coalesce("samples", F.array()), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("samples")), "blocks")
    schema = _kinds(rows, names)

    def by_length(batch):
        col = batch.column("samples")
        offsets, flat = np.asarray(col.offsets), np.asarray(col.values, float)
        sizes = np.diff(offsets)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            yield n, own, flat[offsets[own][:, None] + np.arange(n)]

    def leave(batches):
        for batch in batches:
            for n, own, x in by_length(batch):
                at = pa.array(own)
                for name, (b, a, order) in made.items():
                    z = _pair(numeric.lfilter_from(b, a, x.astype(np.longdouble))[1]) if n else np.zeros((len(own), 2 * order))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array([name] * len(own)), pa.array([n] * len(own)), pa.array(list(z), pa.list_(pa.float64()))], [*names, "band", "n", "left"])

    def put_together(table: pa.Table) -> pa.Table:
        """One recording's blocks in one band: the state before each."""
        table = table.sort_by("block")
        _, a, order = made[table["band"][0].as_py()]
        power: dict[int, np.ndarray] = {}
        z, out = np.zeros(order, np.longdouble), []
        for n, left in zip(table["n"].to_pylist(), table["left"].to_pylist(), strict=True):
            out.append(z)
            if n not in power:
                power[n] = _after(a, order, n)
            z = power[n] @ z + np.array(left[:order], np.longdouble) + np.array(left[order:], np.longdouble)
        return pa.table([table[c] for c in [*names, "band"]] + [pa.array([_pair(x).tolist() for x in out], pa.list_(pa.float64()))], [*names, "band", "z"])

    def go_on(batches):
        for batch in batches:
            z, bands = batch.column("z"), np.array(batch.column("band").to_pylist())
            for n, own, x in by_length(batch):
                for name in np.unique(bands[own]).tolist():
                    some = bands[own] == name
                    at, (b, a, order) = pa.array(own[some]), made[name]
                    state = np.asarray(z.take(at).flatten(), float).reshape(len(at), 2 * order).astype(np.longdouble)
                    y = numeric.lfilter_from(b, a, x[some].astype(np.longdouble), state[:, :order] + state[:, order:])[0].astype(float) if n else x[some]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in [*names, "band"]), pa.array(list(y), pa.list_(pa.float64()))], [*names, "band", "samples"])

    left = rows.mapInArrow(leave, f"{schema}, band string, n long, left array<double>")
    states = left.groupBy(*keys, "band").applyInArrow(put_together, f"{schema}, band string, z array<double>")
    return rows.join(states, names).mapInArrow(go_on, f"{schema}, band string, samples array<double>")


def peaks(signal: DataFrame, keys: list[str], height: float, distance: int, size: int | None = None) -> DataFrame:
    """signal (keys, t, v; t counts samples) -> keys, t, v: local maxima (the middle of flat ones) of at least `height`, of
    which two nearer than `distance` are thinned, the highest first and the later one of equals.

    Neighbours and chains are found range by range (see `ranges`). Candidates nearer than `distance` to the one before them
    are a chain, and a choice in one chain means nothing to others, so chains are worked on apart. Samples without a
    value don't count: their neighbours are neighbours.
    """
    rows = signal.where("v is not null").select(*keys, F.col("t").cast("long").alias("t"), F.col("v").cast("double").alias("v"))
    order = [F.asc("t")]
    x = ranges.running(ranges.cut(rows, keys, "t", size=size), keys, order, {}, behind={"_b": "v"})
    # One row for each run of equal values, from its start.
    runs = ranges.running(x.where("_b is null or _b <> v"), keys, order, {}, ahead={"_a": "v", "_ta": "t"})
    top = runs.where((F.col("_b") < F.col("v")) & (F.col("_a") < F.col("v")) & (F.col("v") >= height))
    found = top.select(*keys, F.floor((F.col("t") + F.col("_ta") - 1) / 2).alias("t"), "v")
    near = ranges.running(ranges.cut(found, keys, "t", size=size), keys, order, {}, behind={"_before": "t"})
    begins = F.when(F.col("t") - F.col("_before") < distance, F.lit(0)).otherwise(F.lit(1)).cast("long")
    chains = ranges.running(near, keys, order, {"_chain": begins})

    def thin(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        at, v = np.asarray(table["t"]), np.asarray(table["v"])
        keep, open_ = np.zeros(len(at), bool), np.ones(len(at), bool)
        low, high = np.searchsorted(at, at - distance, side="right"), np.searchsorted(at, at + distance, side="left")
        for k in np.lexsort((at, v))[::-1].tolist():
            if open_[k]:
                keep[k] = True
                open_[low[k] : high[k]] = False
        return table.select([*keys, "t", "v"]).filter(pa.array(keep))

    alone = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_chain")) == 1
    marked = chains.select(*keys, "_chain", "t", "v").withColumn("_alone", alone)
    return marked.where("_alone").select(*keys, "t", "v").unionByName(marked.where("not _alone").groupBy(*keys, "_chain").applyInArrow(thin, f"{_kinds(rows, keys)}, t long, v double"))
