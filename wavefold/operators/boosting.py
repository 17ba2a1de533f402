"""Boosted trees over rows that no single task could hold.

Features are cut into bins at their quantiles once. A tree grows level by level: every task adds up the gradients of its rows by
node, feature and bin, the sums of a node and feature meet in one small group that finds their best cut, and the driver gets one
cut for each node. The model is the one that a fold's own fit gives (`functions.learn.Booster`), so all that
is done with those can be done with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.learn import Booster, BoostParams, Tree
from ..sources import shared

#: Trees whose margins are made anew in each pass before the rows are written with them.
KEEP = 8
MISSING = 0


def edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Of each feature the values that end its bins, at most `bins`: approximate quantiles, all values where there are few."""
    at = F.array(*(F.lit((k + 1) / bins) for k in range(bins)))
    long = rows.select(F.posexplode("features").alias("f", "v")).where("v is not null and not isnan(v)")
    found = {r[0]: np.unique(np.array(r[1], float)) for r in long.groupBy("f").agg(F.percentile_approx("v", at, F.lit(100 * bins))).collect()}  # bins numbers a feature
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    return [found.get(f, np.empty(0)) for f in range(width)]


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """id, y, bins (0: missing, then 1 and the number of edges below the value, two bytes a feature), z (0)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = np.array([v + [None] * (len(cuts) - len(v)) for v in b.column("features").to_pylist()], float).reshape(b.num_rows, len(cuts))
            out = np.empty(x.shape, "<u2")
            for f, e in enumerate(cuts):
                out[:, f] = np.where(np.isnan(x[:, f]), MISSING, 1 + np.minimum(np.searchsorted(e, x[:, f]), max(len(e) - 1, 0)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array([r.tobytes() for r in out], pa.binary()), pa.array(np.zeros(b.num_rows))], ["id", "y", "bins", "z"])

    return rows.select("id", F.col("y").cast("int").alias("y"), "features").mapInArrow(run, f"id {kind}, y int, bins binary, z double")


class _Growing:
    """A tree whose cuts are bins: nodes (feature, bin, left, right, missing left, value, cover)."""

    def __init__(self):
        self.nodes: list[list] = []

    def add(self, value: float, cover: float) -> int:
        self.nodes.append([-1, 0, -1, -1, False, value, cover])
        return len(self.nodes) - 1

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row has come to."""
        feature, cut, left, right, missing = (np.array([n[k] for n in self.nodes]) for k in range(5))
        at = np.zeros(len(bins), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            n = at[rows]
            v = bins[rows, feature[n]]
            at[rows] = np.where(np.where(v == MISSING, missing[n], v <= cut[n]), left[n], right[n])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array([n[5] for n in self.nodes])[self.leaves(bins)]

    def tree(self, cuts: list[np.ndarray]) -> Tree:
        rows = [[f, float(cuts[f][b - 1]) if f >= 0 else 0.0, *rest] for f, b, *rest in self.nodes]
        return tuple(np.array(c, t) for c, t in zip(zip(*rows, strict=True), (int, float, int, int, bool, float, float), strict=True))


def fit(rows: DataFrame, params: BoostParams = BoostParams(), bins: int = 256) -> Booster:
    """rows (id, y, features): id is of any type and only decides, by a hash, which trees a row is drawn for; missing features
    are null or NaN, and shorter arrays end in missing ones. Rows without y or features don't count; no rows give no trees."""
    rows = rows.where("y is not null and features is not null")
    pos, n = rows.agg(F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)), F.count(F.lit(1))).first()
    model = Booster(params)
    if not n:
        return model
    cuts = edges(rows, bins)
    data, fresh = shared.store(_binned(rows, cuts), "binned"), []
    weight = (n - pos) / pos if params.balance and pos else 1.0
    for t in range(params.trees):
        grown = _tree(data, fresh, params, t, weight, cuts)
        model.trees.append(grown.tree(cuts))
        fresh.append(grown)
        if len(fresh) == KEEP and t + 1 < params.trees:
            data, fresh = shared.store(_moved(data, fresh, len(cuts)), "binned"), []
    return model


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u2").reshape(len(col), width)


def _moved(data: DataFrame, fresh: list[_Growing], width: int) -> DataFrame:
    """The rows with the margins of some trees more."""

    def run(batches):
        for b in batches:
            bins = _matrix(b.column("bins"), width)
            z = np.asarray(b.column("z")) + sum((t.values(bins) for t in fresh), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z)], b.schema.names)

    return data.mapInArrow(run, data.schema)


def _tree(data: DataFrame, fresh: list[_Growing], p: BoostParams, number: int, weight: float, cuts: list[np.ndarray]) -> _Growing:
    width, most = len(cuts), 2 + max((len(e) for e in cuts), default=0)
    luck = F.pmod(F.xxhash64("id", F.lit(p.seed), F.lit(number)), F.lit(1 << 30)) / float(1 << 30)
    drawn = data if p.subsample >= 1 else data.where(luck < p.subsample)
    own, open_ = _Growing(), [0]
    sums = _sums(drawn, fresh, own, [0], weight, width, most, p)
    g, h = sums[0][:2] if 0 in sums else (0.0, 0.0)
    own.add(-p.rate * g / (h + p.ridge), h)
    for depth in range(p.depth):
        if depth:
            sums = _sums(drawn, fresh, own, open_, weight, width, most, p)
        after = []
        for node in open_:
            if node not in sums or sums[node][2] is None:
                continue
            g, h, (feature, bin_, side, gl, hl) = sums[node]
            left, right = own.add(-p.rate * gl / (hl + p.ridge), hl), own.add(-p.rate * (g - gl) / (h - hl + p.ridge), h - hl)
            own.nodes[node][:5] = [feature, bin_, left, right, side]
            after += [left, right]
        open_ = after
        if not open_:
            break
    return own


def _sums(drawn: DataFrame, fresh: list[_Growing], own: _Growing, open_: list[int], weight: float, width: int, most: int, p: BoostParams) -> dict:
    """Of each open node: sums of gradients and of their derivatives, and its best cut (feature, bin, whether missing values
    go left, and the left side's sums), or none."""

    def add_up(batches):
        place = {n: k for k, n in enumerate(open_)}
        total = np.zeros((2, len(open_), max(width, 1), most))
        seen = False
        for b in batches:
            bins = _matrix(b.column("bins"), width)
            if not len(bins):
                continue
            z, y = np.asarray(b.column("z")) + sum((t.values(bins) for t in fresh), np.zeros(len(bins))), np.asarray(b.column("y"))
            q, w = 1 / (1 + np.exp(-z)), np.where(y == 1, weight, 1.0)
            at = np.array([place.get(k, -1) for k in own.leaves(bins).tolist()]) if own.nodes else np.zeros(len(bins), int)
            keep = at >= 0
            seen = seen or bool(keep.any())
            for f in range(width):
                key = at[keep] * most + bins[keep, f]
                for k, v in enumerate((w * (q - y), w * q * (1 - q))):
                    total[k, :, f] += np.bincount(key, v[keep], len(open_) * most).reshape(len(open_), most)
        if seen and width:
            node = np.repeat(np.array(open_), width)
            feature = np.tile(np.arange(width), len(open_)).astype(np.int32)
            arrays = [pa.array(list(total[k].reshape(-1, most)), pa.list_(pa.float64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(feature), *arrays], ["node", "feature", "g", "h"])

    def best(table: pa.Table) -> pa.Table:
        g, h = (np.array(table[c].to_pylist()).sum(axis=0) for c in ("g", "h"))
        gs, hs, gl, hl = g.sum(), h.sum(), np.cumsum(g[1:])[:-1], np.cumsum(h[1:])[:-1]
        # Missing values to the left, then to the right; a cut where no row is on one side is none.
        a, c = np.stack([gl + g[0], gl]), np.stack([hl + h[0], hl])
        ok = (c >= p.least_weight) & (hs - c >= p.least_weight) & (hl > 0) & (h[1:].sum() - hl > 0)
        ok[0] &= h[0] > 0
        with np.errstate(all="ignore"):
            gain = np.where(ok, (a * a / (c + p.ridge) + (gs - a) ** 2 / (hs - c + p.ridge) - gs * gs / (hs + p.ridge)) / 2 - p.gamma, -np.inf)
        side, k = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
        found = gain[side, k] if gain.size else -np.inf
        row = {"node": table["node"][0].as_py(), "feature": table["feature"][0].as_py(), "gain": float(found), "bin": int(k) + 1, "side": bool(side == 0), "gl": float(a[side, k]) if gain.size else 0.0, "hl": float(c[side, k]) if gain.size else 0.0, "gs": float(gs), "hs": float(hs)}
        return pa.Table.from_pylist([row], schema=pa.schema([("node", pa.int64()), ("feature", pa.int32()), ("gain", pa.float64()), ("bin", pa.int32()), ("side", pa.bool_()), ("gl", pa.float64()), ("hl", pa.float64()), ("gs", pa.float64()), ("hs", pa.float64())]))

    sums = drawn.mapInArrow(add_up, "node long, feature int, g array<double>, h array<double>")
    cuts = sums.groupBy("node", "feature").applyInArrow(best, "node long, feature int, gain double, bin int, side boolean, gl double, hl double, gs double, hs double")
    top = cuts.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "side", "gl", "hl", "gain", "gs", "hs"), F.struct("gain", (-F.col("feature")).alias("m"))).alias("s"))
    return {r[0]: (r[1].gs, r[1].hs, (r[1].feature, r[1].bin, r[1].side, r[1].gl, r[1].hl) if r[1].gain > 1e-12 else None) for r in top.collect()}  # a row for each open node


def predict(rows: DataFrame, model: Booster, name: str = "y_prob") -> DataFrame:
    """rows with the model's probability for their features."""
    shared.ship(rows.sparkSession)
    width = 1 + max(model.features(), default=0)
    names = rows.columns

    def run(batches):
        for b in batches:
            x = np.array([((v or []) + [None] * width)[: max(width, len(v or []))] for v in b.column("features").to_pylist()], float).reshape(b.num_rows, -1) if b.num_rows else np.empty((0, width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.predict(x))], [*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
