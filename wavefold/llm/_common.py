"""Shared pieces of the corpus operators: stored intermediate tables, word hashing, slicing of Arrow batches."""

from __future__ import annotations

import contextlib
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import shared
from ..sources.shared import ship  # noqa: F401

#: Entries a worker keeps of what a word encodes to; a full table starts again empty, which changes no result.
CACHE_ENTRIES = 600_000
#: UTF-8 bytes of text a worker takes at a time out of an Arrow batch.
SLICE_BYTES = 2_000_000
_M = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


class Stored:
    """A table written to the shared folder: it cuts lineage and outlives executors. Its shuffles' files go once it is written."""

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = shared.folder(spark, tag)
        with _brief_shuffles(spark):
            df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; only once nothing lazy reads them any more."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def _brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run within as each query ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Filter:
    """A Bloom filter of longs, four bits a number in one of its segments of 8 KB: at most `most` segments (64 MB), so that
    it can go to every worker; a larger set fills it more, and it lets more through, at no loss."""

    BITS = 1 << 16

    def __init__(self, numbers: DataFrame, count: int, most: int = 8192):
        """numbers: one column of longs, of which about `count` differ."""
        self.segments = max(1, min(most, -(-16 * count // self.BITS)))
        segments = self.segments

        def spots(batches):
            for b in batches:
                x = np.asarray(b.column(0).drop_null(), np.int64)
                seg, bits = _spots(x, segments)
                yield pa.RecordBatch.from_arrays([pa.array(seg), pa.array(signed(bits))], ["seg", "bits"])

        def join(table: pa.Table) -> pa.Table:
            own = np.zeros(self_bits // 8, np.uint8)
            at = np.asarray(table["bits"].combine_chunks(), np.int64).view(_U)
            for k in range(4):
                one = (at >> _U(16 * k)) & _U(0xFFFF)
                np.bitwise_or.at(own, (one >> _U(3)).astype(np.int64), (1 << (one & _U(7)).astype(np.uint8)).astype(np.uint8))
            return pa.table({"seg": table["seg"][:1], "own": pa.array([own.tobytes()], pa.binary())})

        self_bits = self.BITS
        got = numbers.distinct().mapInArrow(spots, "seg int, bits long").groupBy("seg").applyInArrow(join, "seg int, own binary").collect()
        self.bits = np.zeros((segments, self.BITS // 8), np.uint8)
        for r in got:
            self.bits[r[0]] = np.frombuffer(r[1], np.uint8)

    def may_hold(self, x: np.ndarray) -> np.ndarray:
        seg, bits = _spots(x, self.segments)
        ok = np.ones(len(x), bool)
        for k in range(4):
            one = ((bits >> _U(16 * k)) & _U(0xFFFF)).astype(np.int64)
            ok &= (self.bits[seg, one >> 3] >> (one & 7).astype(np.uint8)) & 1 == 1
        return ok


def _spots(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(x.astype(np.int64).view(_U) + _M)
    return ((h >> _U(32)) * _U(segments) >> _U(32)).astype(np.int32), mix(h + _M)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes; empty where there are fewer."""
    if n < 1 or len(h) < n:
        return np.empty(0, _U)
    k = len(h) - n + 1
    out = h[:k].copy()
    for j in range(1, n):
        out *= _M
        out += h[j : j + k]
    return mix(out ^ _U(n))


def sliding_min_places(h: np.ndarray, w: int) -> np.ndarray:
    """Winnowing: of each run of w consecutive hashes the place of the smallest, the last one of equals. Runs are made of
    shorter ones, doubled."""
    best, at, have = h, np.arange(len(h)), 1
    while have < w and len(best):
        step = min(have, w - have)
        take = best[step:] <= best[:-step]
        best, at = np.where(take, best[step:], best[:-step]), np.where(take, at[step:], at[:-step])
        have += step
    return at


def sliding_min_choice(h: np.ndarray, w: int) -> np.ndarray:
    """The places that winnowing keeps, sorted and without repeats; one where there are fewer than w hashes."""
    if not len(h):
        return np.empty(0, np.int64)
    at = sliding_min_places(h, min(w, len(h)))
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


class Words:
    """What is a word, by bytes of UTF-8; `fold` says which byte another counts as."""

    def __init__(self, inside: np.ndarray, fold: np.ndarray):
        self.inside = inside
        self.fold = fold.astype(np.uint8)

    def hashes(self, texts: list[str | None], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word of all texts, and where each text's words begin (one more than texts). Hashes of another seed
        are independent of the first ones."""
        raw, ends = _joined(texts)
        out, places, at = [np.empty(0, _U)], [np.empty(0, np.int64)], 0
        while at < len(raw):
            end = min(at + _BLOCK, len(raw))
            while end < len(raw) and self.inside[raw[end - 1]] and self.inside[raw[end]]:  # words stay whole
                gaps = np.flatnonzero(~self.inside[raw[end : end + _BLOCK]])
                end = end + int(gaps[0]) if len(gaps) else min(end + _BLOCK, len(raw))
            own = raw[at:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], self.inside[own], [False]]).view(np.int8)))
            out.append(run_hashes(self.fold[own], edge[::2], edge[1::2], seed))
            places.append(edge[::2] + at)
            at = end
        return np.concatenate(out), np.concatenate([[0], np.searchsorted(np.concatenate(places), ends)])

    def normal(self, texts: list[str | None]) -> list[bytes]:
        """Each text's words with one space after each."""
        raw, ends = _joined(texts)
        inside = self.inside[raw]
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        flat = np.where(inside, self.fold[raw], np.uint8(32))[keep].tobytes()
        sizes = np.add.reduceat(keep, np.concatenate([[0], ends[:-1]]), dtype=np.int64) if len(ends) else []
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, a space after each, and where each ends with that."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return np.frombuffer(b" ".join([*raws, b""]), np.uint8), np.cumsum([len(r) + 1 for r in raws])


#: Bytes of a run that are hashed eight at a time beside those of all other runs; longer ones go one by one.
_LONG = 48
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of runs of bytes: eight bytes at a time are mixed into the state, which isn't linear in any of them."""
    size = end - start
    words = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix((words[start] & _MASKS[np.minimum(size, 8)]) ^ mix(size.astype(_U) * _M + _U(seed)))
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    for k in range(8, _LONG, 8):
        if not len(more):
            break
        block = words[start[more] + k] & _MASKS[np.minimum(size[more] - k, 8)]
        out[more] = mix(out[more] * _M + block)
        more = more[size[more] > k + 8]
    if len(more := np.flatnonzero(size > _LONG)):
        flat = raw.tobytes()
        out[more] = [xxhash.xxh3_64_intdigest(flat[a:b], seed) for a, b in zip(start[more].tolist(), end[more].tolist(), strict=True)]
    return out


_BLOCK = 1 << 18
_ALL = np.arange(256)
#: Runs of anything but space and the five controls from tab on, unchanged.
SPACED = Words(~np.isin(_ALL, [32, 9, 10, 11, 12, 13]), _ALL)
#: Runs of digits, ASCII letters (large as small) and all beyond ASCII.
LETTERS = Words((_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL | 0x20) >= 0x61) & ((_ALL | 0x20) <= 0x7A) & (_ALL >= 0x41), np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL))


def whole(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of runs of n words that begin at each of `total` - n + 1 words, whether they lie in one text."""
    ok = np.ones(max(total - n + 1, 0), bool)
    for j in range(1, n):
        ok[np.clip(first[1:-1] - j, 0, None)[(first[1:-1] - j >= 0) & (first[1:-1] - j < len(ok))]] = False
    return ok


def signed(h: np.ndarray) -> np.ndarray:
    """uint64 as Spark's long."""
    return h.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where their texts add up to about `most` bytes, so that a worker's memory is bounded by that and its longest text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
        ends = np.flatnonzero(np.diff(np.cumsum(size) // most, append=-1)) + 1
        begin = 0
        for e in ends.tolist():
            if e > begin:
                yield batch.slice(begin, e - begin)
                begin = e


def lists(values: np.ndarray, lengths: list[int], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, kind))


def table(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, stay outside."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def no_threads() -> None:
    """Workers share cores: the tokenizer's own threads stay off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


if sys.byteorder != "little":  # the digests are of little-endian ids
    raise ImportError("little-endian machines only")
