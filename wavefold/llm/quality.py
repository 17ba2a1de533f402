"""Quality classifier: a byte-level convolutional network in NumPy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned byte vectors go through learned filters,
each filter's largest response in a chunk is kept (max-pooling), a dense layer turns these into the chunk's logit, and
a logistic layer combines the mean, the largest and the smallest chunk logit and the text's length to one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import ship, slices

CHUNK, STRIDE, WIDTH, HOP = 256, 192, 6, 2
RESULT = "doc_id long, score double, predicted int"
_PER_STEP = 64


def chunks(text: str | None) -> np.ndarray:
    """Overlapping chunks of the bytes, padded with 0; one chunk of padding for an empty text."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = 1 + max(0, -(-(len(raw) - CHUNK) // STRIDE))
    padded = np.zeros((n - 1) * STRIDE + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


class Network:
    def __init__(self, dims: int = 8, filters: int = 24, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {
            "emb": r.normal(0, 0.5, (256, dims)), "conv": r.normal(0, (2 / (WIDTH * dims)) ** 0.5, (WIDTH * dims, filters)), "bias": np.zeros(filters),
            "dense": r.normal(0, filters**-0.5, filters), "base": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.top = np.array([0.0, 1.0, 0.0, 0.0, 0.0])  # bias, mean, max, min, log of the number of chunks
        self.mid, self.scale = np.zeros(4), np.ones(4)

    def _responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        e = p["emb"][x]  # chunk, byte, dim
        w = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::HOP]  # chunk, place, dim, byte
        cols = np.ascontiguousarray(w.transpose(0, 1, 3, 2)).reshape(len(x), w.shape[1], -1)
        return cols, cols @ p["conv"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        p, out = self.p, np.empty(len(x), np.float32)
        for i in range(0, len(x), _PER_STEP):
            _, r = self._responses(x[i : i + _PER_STEP])
            out[i : i + _PER_STEP] = np.maximum(r.max(axis=1) + p["bias"], 0) @ p["dense"] + p["base"]
        return out

    def fit(self, texts: list[str], labels: list[int], epochs: int = 4, per_text: int = 6, rate: float = 0.01, seed: int = 0) -> None:
        """Adam on the log-loss of up to `per_text` chunks of each text an epoch, then the combining layer by Newton's method."""
        r = np.random.default_rng(seed)
        y = np.array(labels, np.float32)
        cut = [chunks(t) for t in texts]
        mean = float(np.clip(y.mean(), 0.01, 0.99))
        self.p["base"][:] = np.log(mean / (1 - mean))
        m, v, step = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            x = np.concatenate([c[r.choice(len(c), min(per_text, len(c)), replace=False)] for c in cut])
            t = np.repeat(y, [min(per_text, len(c)) for c in cut])
            order = r.permutation(len(x))
            for i in range(0, len(x), _PER_STEP):
                some = order[i : i + _PER_STEP]
                step += 1
                for k, g in self._gradients(x[some], t[some]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        f = np.array([self._features(c) for c in cut])
        self.mid, self.scale = f.mean(axis=0), f.std(axis=0) + 1e-6
        a, w = np.column_stack([np.ones(len(f)), (f - self.mid) / self.scale]), np.zeros(5)
        for _ in range(25):
            q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a + 0.1 * np.eye(5), a.T @ (y - q) - 0.1 * w)
        self.top = w

    def _gradients(self, x: np.ndarray, t: np.ndarray) -> dict[str, np.ndarray]:
        p, (cols, r) = self.p, self._responses(x)
        at = r.argmax(axis=1)
        pooled = np.take_along_axis(r, at[:, None], axis=1)[:, 0] + p["bias"]
        act = np.maximum(pooled, 0)
        d = (1 / (1 + np.exp(-np.clip(act @ p["dense"] + p["base"], -30, 30))) - t) / len(x)
        back = d[:, None] * p["dense"] * (pooled > 0)
        chosen = cols[np.arange(len(x))[:, None], at]  # chunk, filter, byte * dim
        g = {"dense": act.T @ d, "base": d.sum(keepdims=True), "bias": back.sum(axis=0), "conv": np.einsum("cfw,cf->wf", chosen, back)}
        into = (back[:, :, None] * p["conv"].T).reshape(len(x), len(p["bias"]), WIDTH, -1)
        bytes_ = x[np.arange(len(x))[:, None, None], at[:, :, None] * HOP + np.arange(WIDTH)]
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], bytes_.ravel(), into.reshape(-1, into.shape[-1]))
        return g

    def _features(self, x: np.ndarray) -> tuple[float, float, float, float]:
        z = self.logits(x)
        return float(z.mean()), float(z.max()), float(z.min()), float(np.log(len(z)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        f = np.array([self._features(chunks(t)) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(f)), (f - self.mid) / self.scale]) @ self.top, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 700, seed: int = 0, longest: int = 1_000_000) -> Network:
    """Fits on a bounded sample: about `per_class` rows of each value of labels.quality, drawn by a hash of doc_id, and of
    texts of at most `longest` bytes.

    The rarer class is weighted back to its share of all labels by the combining layer's intercept. Null labels and
    texts don't count; no rows: every score is 0.5.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_y")).where("doc_id is not null and _y in (0, 1)").dropDuplicates(["doc_id"])
    counts = {r[0]: r[1] for r in marked.groupBy("_y").agg(F.count(F.lit(1))).collect()}
    net = Network(seed=seed)
    if not counts:
        return net
    luck = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) / float(1 << 20)
    drawn = marked.where(luck < F.when(F.col("_y") == 1, per_class / counts.get(1, 1)).otherwise(per_class / counts.get(0, 1))).collect()
    sample = spark.createDataFrame([(r[0], r[1]) for r in drawn], "doc_id long, _y int")  # about 2 * per_class rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").where(F.octet_length("text") <= longest).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y").collect()
    rows = sorted(((r[0], r[1], r[2]) for r in rows))
    if not rows:
        return net
    net.fit([r[1] for r in rows], [r[2] for r in rows], seed=seed)
    got = max(sum(r[2] for r in rows), 1), max(sum(1 - r[2] for r in rows), 1)
    if len(counts) == 2:
        net.top[0] += np.log(counts[1] / counts[0]) - np.log(got[0] / got[1])
    return net


def classify(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row, from its whole text alone. Null counts as empty; null and repeated
    doc_ids are judged row by row; other columns aren't looked at."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # a fixed size

    def run(batches):
        for b in slices(batches):
            s = shared.value.score(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)
