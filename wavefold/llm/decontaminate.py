"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed k-grams; of every w consecutive k-grams the one with the smallest hash is
kept (k + w - 1 = the window of 10 words), so each shared run of a window's length keeps one fingerprint on both sides.
Items shorter than a window are one window of their own length, whose hash is their fingerprint. The benchmark's
fingerprints go to every worker as a Bloom filter of bounded size; each match is extended to the whole windows around it,
and only these windows are joined with the benchmark's, by two independent hashes of 64 bits. No text moves, and one plan
serves every size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import LETTERS, Filter, Stored, ngram_hashes, ship, signed, slices, sliding_min_choice, sliding_min_places, table, whole

WINDOW, K = 10, 5


def each(texts: list[str | None], seed: int = 0) -> list[np.ndarray]:
    """Word hashes of every text."""
    h, first = LETTERS.hashes(texts, seed)
    return [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def benchmark_windows(bench: DataFrame) -> DataFrame:
    """len, hash, other (a second hash), item_id (as text) of every window, without repeats; items without words have none."""

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            for item, h, g in zip(b.column("item_id").to_pylist(), each(texts), each(texts, 1), strict=True):
                n = min(len(h), WINDOW)
                w = ngram_hashes(h, n)
                yield pa.RecordBatch.from_arrays([pa.array([n] * len(w), pa.int32()), pa.array(signed(w)), pa.array(signed(ngram_hashes(g, n))), pa.array([item] * len(w), pa.string())], ["len", "hash", "other", "item_id"])

    return bench.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").mapInArrow(run, "len int, hash long, other long, item_id string").distinct()


def benchmark_fingerprints(bench: DataFrame) -> DataFrame:
    """The hashes that winnowing keeps of items as long as a window, and those of shorter items."""

    def run(batches):
        for b in slices(batches):
            for h in each(b.column("text").to_pylist()):
                grams = ngram_hashes(h, min(len(h), K if len(h) >= WINDOW else WINDOW))
                if len(h) >= WINDOW:
                    grams = grams[sliding_min_choice(grams, WINDOW - K + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams))], ["fp"])

    return bench.where(F.col("item_id").isNotNull()).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "fp long").distinct()


def _maybe(h: np.ndarray, first: np.ndarray, fps: Filter, lengths: list[int]) -> tuple[np.ndarray, ...]:
    """Of texts whose words follow each other in h: where windows begin that a fingerprint speaks for, their lengths and hashes."""
    found = []
    for n in lengths:
        ok = whole(first, n, len(h))
        if n == WINDOW:
            grams = ngram_hashes(h, K)
            kept = np.unique(sliding_min_places(grams, WINDOW - K + 1)[ok])
            kept = kept[fps.may_hold(signed(grams[kept]))]
            at = np.unique((kept[:, None] - np.arange(WINDOW - K + 1)).ravel())
            at = at[(at >= 0) & (at < len(ok))]
            at = at[ok[at]]  # a match is extended to each window that holds it
            own = ngram_hashes(h, n)[at] if len(at) else np.empty(0, np.uint64)
        else:
            at, own = np.flatnonzero(ok), ngram_hashes(h, n)[ok]
            held = fps.may_hold(signed(own))
            at, own = at[held], own[held]
        found.append((at, np.full(len(at), n, np.int32), own))
    at, n, own = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64))
    order = np.argsort(at, kind="stable")
    return at[order], n[order], own[order]


def _others(texts: list[str | None], first: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The second hash of the windows of n words that begin at words `at`; only their texts are looked at."""
    doc = np.searchsorted(first, at, side="right") - 1
    some, place = np.unique(doc, return_inverse=True)
    h, begin = LETTERS.hashes([texts[k] for k in some.tolist()], 1)
    own, out = at - first[doc] + begin[place], np.zeros(len(at), np.uint64)
    for k in np.unique(n).tolist():
        out[n == k] = ngram_hashes(h, k)[own[n == k]]
    return out


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and text_hash (xxhash64 of the text) for every row of docs.

    A null or empty text has no words; a null item_id is no item; item_ids may be of any type and are sorted as strings;
    repeated items count once by their id; repeated or null doc_ids are judged row by row; empty tables give no rows, or
    rows without hits; other columns aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = Stored(benchmark_windows(bench), "bench-windows").df
    fps = Stored(benchmark_fingerprints(bench), "bench-fps")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most ten numbers
    shared = spark.sparkContext.broadcast(Filter(fps.df, fps.df.count()))  # 64 MB at most
    fps.drop()

    def run(batches):
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            h, first = LETTERS.hashes(texts)
            at, n, own = _maybe(h, first, shared.value, lengths)
            ends = np.searchsorted(at, first).astype(np.int32)
            doc = np.searchsorted(first, at, side="right") - 1
            pieces = pa.StructArray.from_arrays([pa.array((at - first[doc]).astype(np.int32)), pa.array(n), pa.array(signed(own)), pa.array(signed(_others(texts, first, at, n)))], ["pos", "len", "hash", "other"])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends), pieces)], ["doc_id", "text_hash", "n_words", "maybe"])

    read = table(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, text_hash long, n_words long, maybe array<struct<pos:int,len:int,hash:long,other:long>>")
    rows = Stored(read.withColumn("row", F.monotonically_increasing_id()), "read").df
    met = rows.where(F.size("maybe") > 0).select("row", F.inline("maybe")).join(windows, ["len", "hash", "other"])
    hits = met.groupBy("row").agg(F.collect_set(F.struct("pos", "len")).alias("spans"), F.collect_set("item_id").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s.pos, s.pos + s.len - 1)))))
    found = hits.select("row", covered.cast("long").alias("hit"), F.size("items").cast("long").alias("n"), F.array_join(F.array_sort("items"), ",").alias("ids"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return rows.drop("maybe").join(found, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "text_hash"
    )
