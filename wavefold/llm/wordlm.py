"""Language-model scoring by cross-entropy difference of word models, whose statistics grow with the corpus.

Target and background are bigram models over one vocabulary, the distinct words of all texts and the end. Both are smoothed
alike: p(b | a) = (c(ab) + PRIOR * p(b)) / (c(a) + PRIOR), p(b) = (c(b) + 1) / (N + V + 1). The models are matched: where the
background is larger, each of its counts is brought down to the target's size by a binomial draw that the key's hash
decides, so that it is as sparse as a sample of that size though every text has been counted. A text's own words are taken
out of both models before it is scored.

Rows are dealt by doc_id and text to blocks of about BLOCK_BYTES of text; a target's doc_id goes to the blocks that hold it. A block adds up its own words and word pairs and deals the
sorted keys out by range, totals are made in each range over all blocks, and each block gets the totals of its keys back in
their order. The driver gets two numbers, the words of the vocabulary and the bytes of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import SPACED, mix, ship, signed, slices

RESULT = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
BLOCK_BYTES = 3_000_000
#: A range of keys holds about those of so many blocks.
RANGE_BLOCKS = 4
PRIOR = 20.0
#: Of the words' hashes, which decide the binomial draws too.
SEED = 1
_U = np.uint64
_M, _END, _TOTAL = _U(0x9E3779B97F4A7C15), _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, each text's followed by the end's, and where texts begin."""
    h, first = SPACED.hashes(texts, SEED)
    return np.insert(h, first[1:], _END), first[:-1] + np.arange(len(texts))


def vocabulary(docs: DataFrame) -> DataFrame:
    """The distinct words' hashes of all texts."""

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.unique(SPACED.hashes(b.column("text").to_pylist(), SEED)[0])))], ["word"])

    return docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(run, "word long").distinct()


def _pack(x: np.ndarray) -> bytes:
    """Eight bytes a number, all first bytes before all second ones, which the shuffle's codec shortens."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


class _Block:
    """The keys of a block's words and word pairs, and how often its target and all its texts hold them."""

    def __init__(self, rows: pa.Table):
        label = np.asarray(rows["label"].combine_chunks().to_numpy(zero_copy_only=False), bool)
        wanted = set(rows["doc_id"].filter(pa.array(label)).to_pylist())
        self.docs = rows.filter(pa.array(~label))
        self.ids, texts = self.docs["doc_id"].to_pylist(), self.docs["text"].to_pylist()
        tok, self.first = tokens(texts)
        self.size = np.diff(np.append(self.first, len(tok)))
        prev = np.concatenate([np.full(min(len(tok), 1), _END, _U), tok[:-1]])
        self.keys, at = np.unique(np.concatenate([tok, mix((prev * _M + tok) ^ _U(2)), np.array([_END, _TOTAL])]), return_inverse=True)
        n, self.total = len(tok), at[-1]
        self.word, self.pair, self.prev = at[:n], at[n : 2 * n], np.concatenate([at[-2:-1], at[:n]])[:n]
        full = np.repeat(np.array([t is not None for t in texts], bool), self.size)
        own = np.repeat(np.array([t is not None and i in wanted for i, t in zip(self.ids, texts, strict=True)], bool), self.size)
        self.counted = own, full
        self.counts = [np.bincount(self.word, w, len(self.keys)) + np.bincount(self.pair, w, len(self.keys)) for w in (own, full)]
        for c, w in zip(self.counts, (own, full), strict=True):
            c[self.total] = w.sum()

    def ranges(self, bits: int) -> list[slice]:
        """Where the keys of each range lie, by their first bits."""
        ends = np.searchsorted(self.keys, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.empty(0, np.int64)
        ends = [0, *ends.tolist(), len(self.keys)]
        return [slice(x, y) for x, y in zip(ends, ends[1:])]

    def losses(self, side: int, words: int, scale: float = 1.0) -> np.ndarray:
        """Of every token, by the counts of a side without the text's own, brought down to `scale`."""
        count, counted = self.counts[side], self.counted[side]
        less = lambda at, own: count[at] - own * counted
        word, pair, before = less(self.word, self.own_word), less(self.pair, self.own_pair), less(self.prev, self.own_prev) * scale
        total = (count[self.total] - np.repeat(self.size, self.size) * counted) * scale
        if scale < 1:
            word, pair = thin(word, scale, self.keys[self.word]), thin(pair, scale, self.keys[self.pair])
        return -np.log((pair + PRIOR * (word + 1) / (total + words + 1)) / (before + PRIOR))

    def _own(self) -> None:
        """How often a token's word, its pair and the word before it are in its own text."""
        doc = np.repeat(np.arange(len(self.first)), self.size) * len(self.keys)
        self.own_word, self.own_pair = (np.unique(doc + x, return_inverse=True, return_counts=True) for x in (self.word, self.pair))
        self.own_word, self.own_pair = (n[at] for _, at, n in (self.own_word, self.own_pair))
        self.own_prev = np.concatenate([[1], self.own_word])[: len(self.own_word)]
        self.own_prev[self.first] = 1  # the end, once a text


def thin(count: np.ndarray, scale: float, keys: np.ndarray) -> np.ndarray:
    """How many of `count` would be left if each stayed with the chance `scale`: the binomial numbers' quantiles at the keys'
    hashes; where more than 30 are expected, these, rounded up or down by the hash."""
    u = (mix(keys ^ _U(0xD1B54A32D192ED03)) >> _U(11)).astype(np.float64) * 2.0**-53
    out = np.floor(count * scale + u)
    at = np.flatnonzero(count * scale <= 30)
    n, u, k = count[at].astype(np.float64), u[at], 0
    chance = (1 - scale) ** n
    below = chance.copy()
    while len(at):
        done = (u < below) | (n <= k)
        out[at[done]] = k
        at, n, u, chance, below = (x[~done] for x in (at, n, u, chance, below))
        chance = chance * (n - k) / (k + 1) * (scale / (1 - scale))
        k += 1
        below = below + chance
    return out


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words and the end), target_loss, background_loss, score for every row of `docs`, from its whole text.

    The models are those of `docs`: texts whose doc_id is in `target` count for the target, all for the background, but for
    the scored text itself (other rows with the same text count). Words are runs of anything but ASCII white space. Null isn't counted and is
    scored as empty: one token, the end. Null and repeated doc_ids are scored row by row; only rows that
    agree in doc_id and text are bound to one block. Other columns aren't looked at.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = vocabulary(texts).count()
    blocks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    dealt = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    held = dealt.select("block", "doc_id").join(ids, "doc_id", "left_semi").distinct()
    labels = held.select("doc_id", F.lit(None).cast("string").alias("text"), "block", F.lit(True).alias("label"))
    both = dealt.withColumn("label", F.lit(False)).unionByName(labels)
    rows = both.select("block", "doc_id", "text", "label").repartition("block")

    bits = int(blocks // RANGE_BLOCKS).bit_length()

    def ask(table: pa.Table) -> pa.Table:
        b, block = _Block(table), table["block"][0].as_py()
        out = []
        for k, r in enumerate(b.ranges(bits)):
            if r.start < r.stop:
                out.append((block, k, _pack(np.diff(b.keys[r], prepend=_U(0))), *(_pack(c[r]) for c in b.counts)))
        return pa.table(dict(zip(("block", "range", "keys", "n_target", "n_background"), map(list, zip(*out)), strict=True)))

    def add_up(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(x), dtype=_U) for x in table["keys"].to_pylist()]
        ends, at = np.cumsum([len(k) for k in keys])[:-1], np.unique(np.concatenate(keys), return_inverse=True)[1]
        out = {"block": table["block"], "range": table["range"]}
        for c in ("n_target", "n_background"):
            total = np.bincount(at, np.concatenate([_unpack(x) for x in table[c].to_pylist()]))
            out[c] = pa.array([_pack(x) for x in np.split(total[at], ends)], pa.binary())
        return pa.table(out)

    def answer(table: pa.Table, totals: pa.Table) -> pa.Table:
        b, ranges = _Block(table), totals["range"].to_pylist()
        places = b.ranges(bits)
        for count, c in zip(b.counts, ("n_target", "n_background"), strict=True):
            for k, x in zip(ranges, totals[c].to_pylist(), strict=True):
                count[places[k]] = _unpack(x)
        n_target, n_background = (c[b.total] for c in b.counts)
        b._own()
        out = [b.losses(0, words), b.losses(1, words, min(1.0, n_target / max(n_background, 1)) if n_target else 1.0)]
        t, g = (np.add.reduceat(x, b.first) / b.size if len(b.first) else np.empty(0) for x in out)
        return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_tokens": b.size.astype(np.int64), "target_loss": t, "background_loss": g, "score": t - g})

    asked = rows.groupBy("block").applyInArrow(ask, "block long, range long, keys binary, n_target binary, n_background binary")
    totals = asked.groupBy("range").applyInArrow(add_up, "block long, range long, n_target binary, n_background binary")
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(answer, RESULT)
