"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased; letters and combining marks stay, each run of other characters becomes one space. A text is read
some characters at a time, so that its length doesn't matter to a worker's memory. Each order has
one sorted array of the hashes of all n-grams seen in any language and beside it a matrix with the log-probability of
the n-gram's last character in every language, already interpolated down to the uniform distribution. A document gets
the language of least mean cross-entropy per character; it is accepted unless that is above a bound calibrated on
training documents that were held out of the counts (with more room for short texts, whose means vary more).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import mix, ship, slices

ORDER = 4
UNKNOWN = "und"
RESULT = "doc_id long, lang_pred string, score double, cross_entropy double, accepted boolean"
_U = np.uint64
_MARK = 1 << 30
_known = np.zeros(0x110000, np.uint32)  # code point -> 1 + its letter, lower-cased (_MARK more for a mark); 0 not looked up yet, 1 neither
#: Characters of a text that are looked at together.
BLOCK = 100_000


def _letters(text: str) -> np.ndarray:
    """Each character's letter or mark, as _known says, less 1: 0 for others."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    got = _known[raw]
    if not got.all():
        for c in np.unique(raw[got == 0]).tolist():
            low = chr(c).lower()[0]
            mark = unicodedata.category(low)[0] == "M"
            _known[c] = 1 + (ord(low) if low.isalpha() or mark else 0) + (_MARK if mark else 0)
        got = _known[raw]
    return got - np.uint32(1)


def blocks(text: str | None) -> Iterator[np.ndarray]:
    """A text's symbols, block by block: lower-case letters' code points, 32 between and around. There are none where no
    character is a letter, and what comes before the first letter counts as space, marks too."""
    last = None
    for i in range(0, len(text or ""), BLOCK):
        got = _letters(text[i : i + BLOCK])
        if last is None:
            letter = (got > 0) & (got < _MARK)
            if not letter.any():
                continue
            got = np.concatenate([np.zeros(1, np.uint32), got[int(letter.argmax()) :]])
        got = got & np.uint32(_MARK - 1)
        got[got == 0] = 32
        keep = np.ones(len(got), bool)
        keep[1:] = (got[1:] != 32) | (got[:-1] != 32)
        keep[0] = got[0] != 32 or last != 32
        if (own := got[keep]).size:
            last = int(own[-1])
            yield own
    if last is not None and last != 32:
        yield np.array([32], np.uint32)


def symbols(text: str | None) -> np.ndarray:
    """All of a text's symbols."""
    return np.concatenate([np.empty(0, np.uint32), *blocks(text)])


def grams(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each position from n - 1 on."""
    k = len(s) - n + 1
    if k <= 0:
        return np.empty(0, _U)
    out = s[:k].astype(_U)
    for j in range(1, n):
        out = out * _U(0x1FFFFF7) + s[j : j + k]
    return mix(out * _U(8) + _U(n))


class Model:
    """counts[lang][n]: hash of each n-gram's context, of itself, of its suffix, and its count."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, discount: float = 0.75):
        letters = {lang: [s for s in map(symbols, texts[lang]) if len(s)] for lang in sorted(texts)}
        self.langs, self.order = [lang for lang, s in letters.items() if s], order
        size = len(self.langs)
        seen: list[list[tuple[np.ndarray, ...]]] = []
        for lang in self.langs:
            syms = letters[lang]
            per = []
            for n in range(1, order + 1):
                parts = [(grams(s, n), grams(s[:-1], n - 1) if n > 1 else np.zeros(len(s), _U), grams(s[1:], n - 1) if n > 1 else np.zeros(len(s), _U)) for s in syms if len(s) >= n]
                g, c, x = (np.concatenate([p[i] for p in parts]) if parts else np.empty(0, _U) for i in range(3))
                keys, first, count = np.unique(g, return_index=True, return_counts=True)
                per.append((keys, c[first], x[first], count))
            seen.append(per)
        alphabet = np.unique(np.concatenate([p[0][0] for p in seen])) if seen else np.empty(0, _U)
        self.floor = -np.log(max(len(alphabet), 1) + 1.0)
        self.keys, self.logp, self.contexts, self.back = [], [], [], []
        for n in range(1, order + 1):
            union = np.unique(np.concatenate([p[n - 1][0] for p in seen])) if seen else np.empty(0, _U)
            prob = np.zeros((len(union), size))
            ctx = np.unique(np.concatenate([p[n - 1][1] for p in seen])) if seen else np.empty(0, _U)
            back = np.ones((len(ctx), size))
            for k, per in enumerate(seen):
                keys, context, suffix, count = per[n - 1]
                if n < order:  # continuation counts: how many n-grams one longer end in this one
                    up = per[n][2]
                    have, number = np.unique(up, return_counts=True)
                    count = np.maximum(_pick(have, number, keys), 0)
                at = np.searchsorted(ctx, context)
                total, kinds = np.bincount(at, count, len(ctx)), np.bincount(at, count > 0, len(ctx))
                ok = total > 0
                back[ok, k] = discount * kinds[ok] / total[ok]
                own = np.searchsorted(union, keys)
                prob[own, k] = np.maximum(count - discount, 0) / np.maximum(total[at], 1)
            # every n-gram of any language needs its context and its suffix
            first: dict[str, np.ndarray] = {}
            for per in seen:
                keys, context, suffix, _ = per[n - 1]
                for name, v in (("context", context), ("suffix", suffix)):
                    first.setdefault(name, np.zeros(len(union), _U))[np.searchsorted(union, keys)] = v
            if len(union):
                lower = np.exp(self._lookup(n - 1, first["suffix"])) if n > 1 else np.full((len(union), size), np.exp(self.floor))
                prob += back[np.searchsorted(ctx, first["context"])] * lower
            self.keys.append(union)
            self.logp.append(np.log(prob).astype(np.float32))
            self.contexts.append(ctx)
            self.back.append(np.log(back).astype(np.float32))
        self.bound = np.full(size, np.inf)

    def _lookup(self, n: int, h: np.ndarray) -> np.ndarray:
        keys = self.keys[n - 1]
        if not len(keys):
            return np.full((len(h), len(self.langs)), self.floor)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = self.logp[n - 1][at].astype(np.float64)
        out[keys[at] != h] = self.floor
        return out

    def _sums(self, s: np.ndarray, skip: int) -> np.ndarray:
        """Sum of the log-probabilities of the symbols from `skip` on, in every language."""
        size, m = len(self.langs), len(s)
        out = np.zeros((m, size), np.float32)
        open_, extra = np.arange(m), np.zeros((m, size), np.float32)
        for n in range(self.order, 0, -1):
            keys = self.keys[n - 1]
            if not len(keys):  # no text that was learned from is that long
                continue
            ready = open_[open_ >= n - 1]
            h = grams(s, n)[ready - n + 1]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[ready[hit]] = self.logp[n - 1][at[hit]] + extra[ready[hit]]
            miss = ready[~hit]
            if len(miss):
                c = grams(s[:-1], n - 1)[miss - n + 1] if n > 1 else np.zeros(len(miss), _U)
                ctx = self.contexts[n - 1]
                at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                ok = ctx[at] == c
                extra[miss[ok]] += self.back[n - 1][at[ok]]
            open_ = np.union1d(open_[open_ < n - 1], miss)
        out[open_] = self.floor + extra[open_]
        return out[skip:].sum(axis=0, dtype=np.float64)

    def losses(self, s: np.ndarray) -> np.ndarray:
        """Mean negative log-probability per symbol in every language."""
        return -self._sums(s, 0) / len(s)

    def measure(self, text: str | None) -> tuple[np.ndarray, int]:
        """The losses of a text and how many symbols it has; blocks overlap by what a symbol's probability looks at."""
        total, count, before = np.zeros(len(self.langs)), 0, np.empty(0, np.uint32)
        for own in blocks(text):
            total += self._sums(np.concatenate([before, own]), len(before))
            count += len(own)
            before = np.concatenate([before, own])[1 - self.order :] if self.order > 1 else before
        return -total / max(count, 1), count

    def calibrate(self, texts: dict[str, list[str]], share: float, margin: float) -> None:
        """Bound of each language: the `share` quantile of the losses of its own held-out texts, and a margin."""
        for k, lang in enumerate(self.langs):
            own = [loss[k] for loss, n in map(self.measure, texts.get(lang, [])) if n]
            if own:
                self.bound[k] = np.quantile(own, share) + margin

    def judge(self, text: str | None) -> tuple[str, float, float | None, bool]:
        loss, size = self.measure(text) if self.langs else (None, 0)
        if not size:
            return UNKNOWN, 0.0, None, False
        best = int(np.argmin(loss))
        odds = np.exp(-(loss - loss[best]) * min(size, 50))
        return self.langs[best], float(1 / odds.sum()), float(loss[best]), bool(loss[best] <= self.bound[best] + 3 / np.sqrt(size))


def _pick(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def train(docs: DataFrame, per_language: int = 300, share: float = 0.99, margin: float = 0.5, order: int = ORDER, longest: int = 1_000_000) -> Model:
    """Fits on a bounded sample of labelled rows: about `per_language` of each language, of at most `longest` bytes each,
    drawn by a hash of doc_id (of the text where it is null); a fifth of them calibrate. Rows whose text or language is null don't count, nor
    does a language without a letter. No rows: everything is unknown."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(F.octet_length("text") <= longest)
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count(F.lit(1))).collect()}  # one number for each language
    chance = F.lit(0.0)
    for lang, n in counts.items():
        chance = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(chance)
    luck = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit(11))).otherwise(F.xxhash64("doc_id", F.lit(11))), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.where(luck < chance).select("lang", "text", "doc_id").collect() if counts else []
    fit: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for k, r in enumerate(sorted(drawn, key=lambda r: (r[0], r[2] is None, r[2] or 0, r[1]))):
        (held if k % 5 == 4 else fit).setdefault(r[0], []).append(r[1])
    model = Model(fit, order)
    model.calibrate(held, share, margin)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted for every row, from its whole text alone.

    A text that is null or has no letter is `und` with score 0 and isn't accepted. Ties go to the language that sorts
    first. Null and repeated doc_ids are judged row by row; other columns aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # n-grams of the bounded sample

    def run(batches):
        m = shared.value
        for b in slices(batches):
            got = [m.judge(t) for t in b.column("text").to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([g[k] for g in got], t) for k, t in enumerate(kinds))], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text is accepted; a filter in place, nothing is shuffled."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array([shared.value.judge(t)[3] for t in b.column(b.schema.get_field_index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
