"""Nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced partitions, a small network learns to tell a vector's
partition, and the index gives every vector the partition it finds most probable. A query is sent to the several most
probable partitions, and the vectors there are ranked by the exact inner product. How many partitions that takes is
measured: some held-out vectors are searched exactly in the whole table, and the fewest are taken that hold the recall
asked for. Partitions are dealt out in salted cells of bounded size, so that one filled by copies of a vector is split;
each cell keeps a query's best k, and these are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._common import Stored, ship

RESULT = "query_id long, rank int, vec_id long, score double"


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: without nulls or non-finite parts, not all zero."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("vec_id is not null and embedding is not null").where(finite & F.exists("embedding", lambda x: x != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Partition of the neighbour graph: every vertex goes where most of its neighbours are, while no part may pass its
    share by more than a twentieth."""
    r = np.random.default_rng(seed)
    n, most = len(x), int(np.ceil(len(x) / parts * 1.05))
    score = x @ x[r.choice(n, parts, replace=False)].T
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    for v in np.argsort(-score.max(axis=1)):
        for p in np.argsort(-score[v]):
            if size[p] < most:
                part[v], size[p] = p, size[p] + 1
                break
    for _ in range(rounds):
        moved = 0
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(part, near.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        for v in np.argsort(-gain)[: int((gain > 0).sum())]:
            best = int(votes[v].argmax())
            if best != part[v] and size[best] < most:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer; probabilities of the partitions."""

    def __init__(self, dim: int, parts: int, hidden: int = 64, seed: int = 0):
        r = np.random.default_rng(seed)
        self.w1, self.b1 = r.normal(0, (2 / dim) ** 0.5, (dim, hidden)).astype(np.float32), np.zeros(hidden, np.float32)
        self.w2, self.b2 = r.normal(0, hidden**-0.5, (hidden, parts)).astype(np.float32), np.zeros(parts, np.float32)
        self.probes = parts

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def fit(self, x: np.ndarray, part: np.ndarray, near: np.ndarray, epochs: int = 30, seed: int = 0) -> None:
        """Adam on the cross-entropy with the share of a vector's neighbours in each partition."""
        r = np.random.default_rng(seed)
        aim = np.zeros((len(x), len(self.b2)), np.float32)
        np.add.at(aim, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
        aim[np.arange(len(x)), part] += 0.5
        m, v, t = [np.zeros_like(a) for a in self._p()], [np.zeros_like(a) for a in self._p()], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 256):
                some = order[i : i + 256]
                h = np.maximum(x[some] @ self.w1 + self.b1, 0)
                z = h @ self.w2 + self.b2
                z = np.exp(z - z.max(axis=1, keepdims=True))
                d = (z / z.sum(axis=1, keepdims=True) - aim[some]) / len(some)
                back = (d @ self.w2.T) * (h > 0)
                t += 1
                for k, g in enumerate((x[some].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                    self._p()[k][...] -= 0.005 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)

    def _p(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]


def partitions(rows: int) -> int:
    """16 up to 65,536 rows, then with the square root of the rows, up to 512."""
    return int(min(512, max(16, rows**0.5 / 16)))


def build(vectors: DataFrame, total: int, sample: int = 8000, parts: int | None = None, neighbours: int = 10, held: int = 200, seed: int = 0) -> tuple[Router, np.ndarray] | None:
    """Learns the partitions on about `sample` of `total` vectors (or 50 a partition, if more), drawn by a hash; None where
    there are none. Also up to `held` vectors of the sample that took no part in the fit."""
    parts = parts or partitions(total)
    luck = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    rows = sorted((r[0], r[1]) for r in vectors.where(luck < max(sample, 50 * parts) / max(total, 1)).collect())
    if not rows and not (rows := [tuple(r) for r in vectors.limit(1).collect()]):
        return None
    lengths = [len(r[1]) for r in rows]
    dim = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([r[1] for r in rows if len(r[1]) == dim])
    if len(x) < 4 * parts:
        parts = 1
    out = np.arange(len(x)) % 10 == 9
    net = Router(x.shape[1], parts, seed=seed)
    if parts > 1:
        fit = _unit(x[~out])
        near = _graph(fit, min(neighbours, len(fit) - 1))
        net.fit(fit, balanced_partition(fit, near, parts, seed=seed), near, seed=seed)
    return net, x[out][:held]


def _probes(placed: DataFrame, net: Router, queries: np.ndarray, k: int, recall: float) -> tuple[int, list[float]]:
    """The fewest partitions that hold `recall` of the queries' true k nearest in the whole table, and the recall of each
    number of partitions. The queries are in the table, so each one's best, itself, doesn't count."""
    parts = len(net.b2)
    if parts == 1 or not len(queries):
        return parts, [1.0] * parts

    def run(batches):
        for b in batches:
            col = b.column("embedding")
            fits = np.flatnonzero(np.diff(np.asarray(col.offsets)) == queries.shape[1])
            if len(fits):
                s = queries @ np.asarray(col.take(pa.array(fits)).flatten()).reshape(-1, queries.shape[1]).T
                top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1]
                q = np.repeat(np.arange(len(s)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.asarray(b.column("part"))[fits][top.ravel()]), pa.array(s[q, top.ravel()])], ["q", "part", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "part")
    got = placed.mapInArrow(run, "q long, part int, score double").withColumn("r", F.row_number().over(best)).where(F.col("r").between(2, k + 1)).select("q", "part").collect()  # k numbers a query
    order = np.argsort(-net.logits(_unit(queries)), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = np.array([place[r[0], r[1]] for r in got])
    curve = [float((at < p).mean()) for p in range(1, parts + 1)]
    return next(p for p, c in enumerate(curve, 1) if c >= min(recall, curve[-1])), curve


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, cell: int = 4000, block: int = 8000, recall: float = 0.95, **fit) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of each vector whose vec_id is divisible by `every`.

    Nearest first, ties to the smaller vec_id, all where there are fewer; never the query's own row. Vectors that are
    null, zero, or hold null or non-finite parts take no part; of vectors with different lengths only those as long as
    the query's are compared, all of them where that isn't the commonest length. A query whose partitions hold fewer than k
    is sent to all. Rows that repeat a vec_id count once. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = Stored(valid(vectors).dropDuplicates(["vec_id"]), "vectors")
    made = build(rows.df, rows.df.count(), **fit)
    if made is None:
        return spark.createDataFrame([], RESULT)
    net, held = made
    shared = spark.sparkContext.broadcast(net)  # a fixed size
    dim, parts = net.w1.shape[0], len(net.b2)

    def route(probes):
        """The probable partitions of each vector; those of another length than most are in one of their own, `parts`."""

        def run(batches):
            n = shared.value
            for b in batches:
                col = b.column("embedding")
                fits = np.diff(np.asarray(col.offsets)) == dim
                at = [np.flatnonzero(~fits)]
                top = [np.full(len(at[0]), parts)]
                if fits.any():
                    own = np.flatnonzero(fits)
                    v = np.asarray(col.take(pa.array(own)).flatten()).reshape(-1, dim)
                    at.append(np.repeat(own, probes))
                    top.append(np.argsort(-n.logits(_unit(v)), axis=1, kind="stable")[:, :probes].ravel())
                at_ = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at_), col.take(at_), pa.array(np.concatenate(top).astype(np.int32))], ["vec_id", "embedding", "part"])

        return run

    schema = "vec_id long, embedding array<double>, part int"
    placed = Stored(rows.df.mapInArrow(route(1), schema), "placed").df
    rows.drop()
    net.probes, net.curve = _probes(placed, net, held, k, recall)
    sizes = {r[0]: r[1] for r in placed.groupBy("part").agg(F.count(F.lit(1))).collect()}  # one number for each partition
    cells = {p: max(1, -(-n // cell)) for p, n in sizes.items()}
    number = F.element_at(F.create_map(*[F.lit(x) for p in range(parts + 1) for x in (p, cells.get(p, 1))]), F.col("part"))

    def search(asked: DataFrame, probes: int) -> DataFrame:
        blocks = max(1, -(-asked.count() // block))  # a task has one cell of vectors and one block of queries
        a = asked.mapInArrow(route(probes), schema).withColumn("cell", F.explode(F.sequence(F.lit(0), number - 1))).select("part", "cell", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("is_query"), "vec_id", "embedding")
        b = placed.select("part", F.pmod(F.xxhash64("vec_id"), number).cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("is_query"), "vec_id", "embedding")
        found = a.unionByName(b).groupBy("part", "cell", "block").applyInArrow(_ranker(k), "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    found = Stored(search(asked, net.probes), "found").df
    full = found.where(F.col("rank") == k).select("query_id")
    short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    if net.probes == parts or not short.where(F.size("embedding") == dim).limit(1).count():
        return found
    return found.join(full, "query_id", "left_semi").unionByName(search(short, parts)).select(*(x.split()[0] for x in RESULT.split(", ")))


def _ranker(k: int):
    """Of a cell's vectors the k nearest of each query that came there."""

    def rank(table: pa.Table) -> pa.Table:
        q, c = table.filter(table.column("is_query")), table.filter(pc.invert(table.column("is_query")))
        out = [[], [], []]
        if q.num_rows and c.num_rows:
            for size in np.unique(np.asarray(pc.list_value_length(q.column("embedding")))).tolist():
                qs, cs = (t.filter(pc.equal(pc.list_value_length(t.column("embedding")), size)) for t in (q, c))
                if not cs.num_rows:
                    continue
                x, y = (np.asarray(t.column("embedding").combine_chunks().flatten()).reshape(-1, size) for t in (qs, cs))
                order = np.argsort(np.asarray(cs.column("vec_id")))
                y, ids = y[order], np.asarray(cs.column("vec_id"))[order]
                qid = np.asarray(qs.column("vec_id"))
                hair = 1e-12 * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()  # of rounding
                for i in range(0, len(x), 512):
                    s = x[i : i + 512] @ y.T
                    s[qid[i : i + 512, None] == ids[None, :]] = -np.inf
                    edge = -np.partition(-s, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                    for r in range(len(s)):
                        # all above the k-th product, then those equal to it by vec_id
                        best = np.flatnonzero((s[r] >= edge[r] - hair[i + r]) & (s[r] > -np.inf))
                        exact = np.array([float(np.dot(x[i + r], y[j])) for j in best]) if len(best) <= 4 * k else (y[best] * x[i + r]).sum(axis=1)
                        top = np.lexsort((ids[best], -exact))[:k]
                        out[0] += [qid[i + r]] * len(top)
                        out[1] += ids[best][top].tolist()
                        out[2] += exact[top].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return rank
