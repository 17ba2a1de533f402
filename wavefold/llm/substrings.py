"""Removal of repeated word windows, found level by level with doubling lengths.

Windows of a quarter's length that occur only once can't lie in a longer window that repeats, so only what is repeated
at one length is extended to twice that length: 5, 10, 20 words, or until no candidate survives. The two lower levels
are thinned by winnowing, at no loss: each whole window is counted by the smallest hash of a shorter window in it, a
choice that depends on its words alone, so two equal whole windows are counted by equal ones at the same place. Windows
are carried as 64-bit hashes, at the last level with 32 bits of a second, independent hash of the words.

Hot windows (a passage in a third of all rows) stay harmless: counts and first places are partial aggregates, and the
joins back are plain equi-joins that adaptive execution splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ._common import SPACED, Stored, mix, ngram_hashes, ship, signed, slices, sliding_min_places, table, whole

WINDOW = 20
_U = np.uint64
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _doubled(h: np.ndarray, length: int, start: int) -> np.ndarray:
    """Hashes of the windows of `length` words: a window's from those of its halves."""
    g, n = ngram_hashes(h, start), start
    while n < length and len(g) > n:
        g = mix(g[:-n] * _U(0x9E3779B97F4A7C15) + g[n:])
        n *= 2
    return g if n == length else g[:0]


def _level(h: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes at a level, and for each whole window the place of the one it is counted by (itself at the last level)."""
    g = _doubled(h, length, window // 4)
    return g, sliding_min_places(g, window - length + 1)


def _emit(keys: list[str], length: int, below: int | None, window: int):
    """Rows keys, pos, h of a level, and at the last one more bits of the hash in g; where there is a level below, only for
    windows whose place there is in `places`."""

    def run(batches):
        for b in slices(batches):
            h, first = SPACED.hashes(b.column("text").to_pylist())
            ok = whole(first, window, len(h))
            if below is not None:
                counts = np.asarray(pc.fill_null(pc.list_value_length(b.column("places")), 0))
                kept = np.zeros(len(h) + 1, bool)
                flat = np.asarray(b.column("places").flatten(), np.int64) + np.repeat(first[:-1], counts)
                kept[flat[flat < len(h)]] = True
                ok &= kept[_level(h, below, window)[1]]
            g, at = _level(h, length, window)
            at = np.unique(at[ok])
            doc = pa.array(np.searchsorted(first, at, side="right") - 1)
            cols = [*(b.column(k).take(doc) for k in keys), pa.array((at - first[np.asarray(doc)]).astype(np.int32)), pa.array(signed(g[at]))]
            names = [*keys, "pos", "h"]
            if length == window:
                other = SPACED.hashes(b.column("text").to_pylist(), 1)[0]
                cols.append(pa.array((_doubled(other, length, window // 4)[at] >> _U(32)).astype(np.uint32).view(np.int32)))
                names.append("g")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


PLACE_BITS = 24


def _place(keys: list[str], small: bool) -> Column:
    """A window's place in the order of documents and starts: one long where it fits, else a struct."""
    return F.shiftleft("doc_id", PLACE_BITS) + F.col("pos") if small else F.struct(*keys, "pos")


def repeated_places(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """For docs (doc_id, text, text_hash): where in a document a window starts whose words also start earlier, as key columns
    and `places`; and the key columns' names: doc_id, and text_hash if some doc_id has several texts, which then are
    documents in the order of that hash."""
    if window % 4:
        raise ValueError("the window must be a multiple of 4 words")
    each = docs.groupBy("doc_id").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.max(F.octet_length("text")).alias("n"))
    ends = each.agg(F.min("doc_id"), F.max("doc_id"), F.max("n"), F.max(F.col("a") != F.col("b"))).first()
    keys = ["doc_id", "text_hash"] if ends[3] else ["doc_id"]
    small = len(keys) == 1 and (ends[0] is None or (ends[0] >= 0 and ends[1] < 1 << (63 - PLACE_BITS) and (ends[2] or 0) < 1 << PLACE_BITS))
    rows = ", ".join(f"{k} long" for k in keys) + ", pos int, h long"
    by_doc = lambda rows: rows.groupBy(*keys).agg(F.collect_set("pos").alias("places"))
    kept = None
    for length, below in ((window // 4, None), (window // 2, window // 4)):
        source = docs if kept is None else docs.join(kept.df, keys)
        level = Stored(source.mapInArrow(_emit(keys, length, below, window), rows), "windows")
        # Stored, so that the join back deals both sides anew and adaptive execution can split a hot hash.
        twice = Stored(level.df.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h"), "twice")
        now = Stored(by_doc(level.df.join(twice.df, "h", "left_semi")), "places")
        level.drop()
        twice.drop()
        if kept is not None:
            kept.drop()
        kept = now
    place = _place(keys, small)
    last = Stored(docs.join(kept.df, keys).mapInArrow(_emit(keys, window, window // 2, window), rows + ", g int"), "windows")
    kept.drop()
    firsts = Stored(last.df.select("h", "g", place.alias("p")).groupBy("h", "g").agg(F.min("p").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h", "g", "_first"), "firsts")
    out = Stored(by_doc(last.df.join(firsts.df, ["h", "g"]).where(place > F.col("_first"))), "repeats")
    last.drop()
    firsts.drop()
    return out.df, keys


def _cut(text: str | None, places: pa.ListScalar, window: int) -> tuple[int, int, bytes]:
    """Words, removed words, and the words left, joined by spaces."""
    w = text.encode("utf-8", "surrogatepass").split() if text else []  # bytes split at the same six characters
    if not places.is_valid:
        return len(w), 0, b" ".join(w)
    edge = np.zeros(len(w) + 1, np.int64)
    at = places.values.to_numpy()
    edge[at] += 1
    edge[at + window] -= 1
    left = np.flatnonzero(np.cumsum(edge)[:-1] == 0)
    return len(w), len(w) - len(left), b" ".join([w[k] for k in left.tolist()])


def _with_places(rows: DataFrame, window: int) -> DataFrame:
    """rows (doc_id, text, and others) and `places`, null where there are none."""
    ship(rows.sparkSession)
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    places, keys = repeated_places(hashed.select("doc_id", "text", "text_hash").where("doc_id is not null"), window)
    return hashed.join(places, keys, "left")


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by spaces) for every row.

    Each word is removed that a window covers whose words also start earlier, in a smaller doc_id or earlier in the same
    document, judged on the input. Null has no words; documents shorter than a window stay whole; overlapping repeats
    count by their start. Rows with a null doc_id take no part and stay whole. Rows that repeat a doc_id are one
    document if their texts are equal; those with different texts are documents of their own, in the order of their
    texts' xxhash64. Windows are told apart by 96 bits. An empty table gives no rows; other columns aren't looked at.
    """

    def run(batches):
        for b in slices(batches):
            got = [_cut(t, p, window) for t, p in zip(b.column("text").to_pylist(), b.column("places"), strict=True)]
            kept = [g[2] for g in got]
            cols = [b.column("doc_id"), *(pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in (RESULT + ", kept string").split(", ")])

    return _with_places(table(docs), window).select("doc_id", "text", "places").mapInArrow(run, RESULT + ", kept string")


def trimmed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns as they are, with repeated passages cut from the texts: untouched texts stay byte for byte, rows of
    which nothing is left go, and `n_chars`, if there is such a column, is that of the new text."""
    names, kinds = docs.columns, [f.dataType for f in docs.schema.fields]
    inner = docs.toDF(*(f"_{k}" for k in range(len(names)))).withColumns({"doc_id": F.col(f"_{names.index('doc_id')}").cast("long"), "text": F.col(f"_{names.index('text')}").cast("string")})

    def run(batches):
        for b in slices(batches):
            got = [_cut(t, p, window) if p.is_valid else (0, 0, b"") for t, p in zip(b.column("text").to_pylist(), b.column("places"), strict=True)]
            text = pa.array([g[2] if g[1] else None for g in got], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], text, pa.array([g[1] > 0 for g in got])], [*(f"_{k}" for k in range(len(names))), "kept", "touched"])

    schema = ", ".join(f"_{k} {t.simpleString()}" for k, t in enumerate(kinds)) + ", kept string, touched boolean"
    done = _with_places(inner, window).select(*(f"_{k}" for k in range(len(names))), "text", "places").mapInArrow(run, schema).where("not touched or kept <> ''")
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return done.select(*((F.when(F.col("touched"), new[n]).otherwise(F.col(f"_{k}")).cast(t) if n in new else F.col(f"_{k}")).alias(n) for k, (n, t) in enumerate(zip(names, kinds, strict=True))))
