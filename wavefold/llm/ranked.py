"""Ranked lexical search by NRA: sequential reads of impact-sorted lists with bounds on every score.

Documents are counted once (number, lengths, document frequencies of the searched terms) and kept as rows of their searched
terms. Tasks then index them segment by segment: a segment holds a bounded number of postings, its lists are sorted by
impact, and each item reads its lists from the top, level by level. What has been read is a document's lower bound, that
and the next impacts of the lists it hasn't been met in its upper bound. Once no unmet document can enter the best k, only
the candidates' postings count; reading goes on until no document whose upper bound reaches the k-th score has an open
list, so that membership, ties and scores are exact. Scores are made of the whole table's statistics, so the best of the
segments' best are the best of all; hot terms are in every segment and never in one task.

Items are searched in blocks of a bounded number of terms, which go to every worker. Terms are known by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import LETTERS, Filter, Stored, lists, ship, signed, slices

#: Postings of a segment, about 40 bytes each, and terms (with repeats by item) of a block of items.
SEGMENT, BLOCK = 1_000_000, 200_000
_U = np.uint64


def _items(bench: DataFrame) -> Stored:
    """item_id (as it is), item (a number), terms, times; items without a term aren't there."""

    def run(batches):
        for b in slices(batches):
            h, first = LETTERS.hashes(b.column("text").to_pylist())
            got = [np.unique(h[x:y], return_counts=True) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            sizes = [len(g[0]) for g in got]
            flat = [np.concatenate([g[k] for g in got]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), lists(signed(flat[0]), sizes, pa.int64()), lists(flat[1].astype(np.int64), sizes, pa.int64())], ["item_id", "terms", "times"])

    kind = bench.schema["item_id"].dataType.simpleString()
    rows = bench.where("item_id is not null").select("item_id", F.col("text").cast("string").alias("text")).distinct()
    return Stored(rows.mapInArrow(run, f"item_id {kind}, terms array<long>, times array<long>").where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items")


def _postings(docs: DataFrame, wanted: Filter) -> DataFrame:
    """doc_id, n (terms with repeats), terms, tf: of every row's terms those that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # 64 MB at most

    def run(batches):
        for b in slices(batches):
            h, first = LETTERS.hashes(b.column("text").to_pylist())
            doc = np.repeat(np.arange(b.num_rows), np.diff(first))
            keep = shared.value.may_hold(signed(h))
            h, doc = h[keep], doc[keep]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
            tf = np.diff(np.append(start, len(h))).astype(np.int32)
            sizes = np.bincount(doc[start], minlength=b.num_rows).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(first)), lists(signed(h[start]), sizes, pa.int64()), lists(tf, sizes, pa.int32())], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<long>, tf array<int>")


def _frequencies(postings: DataFrame) -> DataFrame:
    """term, df: each batch's terms are added up before they move."""

    def run(batches):
        for b in batches:
            t, n = np.unique(np.asarray(b.column("terms").flatten()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n)], ["term", "n"])

    return postings.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class _Block:
    """Items as numbers of terms; the terms' hashes, sorted, and weights."""

    def __init__(self, items: list, df: dict[int, int], total: int, words: int):
        self.total, self.words = total, words
        self.terms = np.array(sorted(df), np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in self.terms.tolist()], np.int64)
        self.items, at = [], {t: k for k, t in enumerate(self.terms.tolist())}
        for item, terms, times in items:
            own = [(at[t], q) for t, q in zip(terms, times, strict=True) if t in at]
            self.items.append((item, np.array([x[0] for x in own], np.int64), np.array([x[1] for x in own], np.int64)))

    def segment(self, doc_ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> Segment:
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        keep = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        doc, at, tf = doc[keep], at[keep], tf[keep].astype(np.int64)
        m = 100 - 75 + (75 * n * self.total) // self.words if self.words else n
        return Segment(doc_ids, doc, at, self.weight[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])), len(self.terms))


class Segment:
    """Lists of documents and impacts, the greatest first."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        doc, term, impact = (x[impact > 0] for x in (doc, term, impact))
        order = np.lexsort((-impact, term))
        self.doc, self.impact, self.doc_ids = doc[order], impact[order], doc_ids
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))

    def best(self, terms: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of greatest score above 0, ties by the place in doc_ids, and their scores."""
        ends, at = self.begin[terms + 1], self.begin[terms].copy()
        some = np.flatnonzero(at < ends)
        at, ends, times = at[some], ends[some], times[some]
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs = len(self.doc_ids)
        low, met = np.zeros(docs, np.int64), np.zeros((len(some), docs), bool)
        bound = self.impact[at] * times
        alive, level = None, int(bound.max())
        while True:
            level //= 2
            for t in np.flatnonzero(bound > level).tolist():
                # One level further down the list: impacts descend.
                part = self.impact[at[t] : ends[t]]
                to = at[t] + int(np.searchsorted(-part, -(level // times[t]), side="left"))
                d, v = self.doc[at[t] : to], self.impact[at[t] : to] * times[t]
                if alive is not None:
                    d, v = d[alive[d]], v[alive[d]]
                low[d] += v
                met[t, d] = True
                at[t] = to
                bound[t] = self.impact[to] * times[t] if to < ends[t] else 0
            last = int(np.partition(low, docs - k)[docs - k]) if docs >= k else 0
            unmet = int(bound.sum())
            if unmet and unmet >= last:
                continue
            # No unmet document can be among the best; of those met, some may.
            near = np.flatnonzero((low > 0) & (low + unmet >= last))
            open_ = (~met[:, near] * bound[:, None]).sum(axis=0)
            near = near[low[near] + open_ >= last]
            if not unmet or not (~met[:, near] & (bound > 0)[:, None]).any():
                top = near[np.lexsort((near, -low[near]))[:k]]
                return top, low[top]
            alive = np.zeros(docs, bool)
            alive[near] = True


def _search(postings: DataFrame, block: _Block, k: int) -> DataFrame:
    shared = postings.sparkSession.sparkContext.broadcast(block)  # of BLOCK terms

    def found(rows: list[pa.RecordBatch], b: _Block):
        t = pa.Table.from_batches(rows)
        ids = t["doc_id"].combine_chunks()
        place = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))
        t = t.take(pa.array(place))
        terms = t["terms"].combine_chunks()
        ids, sizes = t["doc_id"].combine_chunks(), np.diff(np.asarray(terms.offsets))
        s = b.segment(place, np.asarray(t["n"].combine_chunks()), np.repeat(np.arange(len(place)), sizes), np.asarray(terms.flatten()), np.asarray(t["tf"].combine_chunks().flatten()))
        got = [(item, *s.best(at, times, k)) for item, at, times in b.items]
        numbers = np.repeat(np.array([g[0] for g in got], np.int64), [len(g[1]) for g in got])
        docs, scores = (np.concatenate([g[x] for g in got]).astype(np.int64) for x in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array(numbers), ids.take(pa.array(docs)), pa.array(scores)], ["item", "doc_id", "score"])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            at = np.asarray(batch.column("terms").offsets)
            begin = 0
            while begin < batch.num_rows:
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + SEGMENT - held, side="right")) - 1)
                rows.append(batch.slice(begin, end - begin))
                held += int(at[end] - at[begin])
                begin = end
                if held >= SEGMENT or begin < batch.num_rows:
                    yield found(rows, shared.value)
                    rows, held = [], 0
        if rows:
            yield found(rows, shared.value)

    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return postings.mapInArrow(run, "item long, doc_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, bench: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of greatest score above 0 for each item (all, if fewer), equal scores
    by ascending doc_id.

    Terms are runs of digits, ASCII letters (small) and all beyond ASCII, of whole texts; null has none. Items without a term
    or without a match have no rows, nor have those without an item_id; equal rows are one item, rows that share an item_id
    but not their text are items of their own, ranked apart. Rows of documents are documents: repeated doc_ids are ranked
    row by row, null ones come last among equal scores. Empty tables give no rows; other columns aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    items = _items(bench)
    terms = items.df.select(F.explode("terms").alias("term"))
    size = terms.count()
    kind = bench.schema["item_id"].dataType.simpleString()
    if not size:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    postings = Stored(_postings(docs, Filter(terms, size)), "postings")
    total, words = postings.df.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = Stored(_frequencies(postings.df).join(terms.distinct(), "term", "left_semi"), "frequencies")
    blocks = -(-size // BLOCK)
    own = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for k_ in range(blocks):
        part = items.df.where(own == k_)
        held = [tuple(r) for r in part.select("item", "terms", "times").orderBy("item").collect()]
        if not held:
            continue
        df = {r[0]: r[1] for r in frequencies.df.join(part.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").collect()}
        found = Stored(_search(postings.df, _Block(held, df, total, words), k), "ranked").df
        out = found if out is None else out.unionByName(found)
    postings.drop()
    frequencies.drop()
    return out.join(items.df.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
