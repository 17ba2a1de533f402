"""Best-fit packing of documents into fixed-length token sequences.

The plan needs only how many pieces there are of each length, at most `capacity` numbers however large the corpus is.
Pieces above a third of the capacity pair at most twice per sequence, the longest first with the longest that still
fits; shorter ones, longest first, go to the fullest sequence with room (best fit). Equal pieces move together, so the
plan is a short list of runs: the pieces of a length with rank r0 .. r1 lie at one place of consecutive sequences.
Ranks come from windows over salted lengths, with more salts the more pieces a length has, so that no length, however
common, meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import Stored, ship, slices, table
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: A window ranks about so many pieces, or a `WINDOWS`-th of all if that is more: so many numbers go to the driver at most.
RANKED, WINDOWS = 20_000, 100_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else capacity-sized ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, n)] if n <= capacity else [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) for counts[length] pieces; the sequences are numbered from 0."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be 1 .. capacity")
    used, runs, sequences = dict.fromkeys(left, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    rooms: list[int] = []

    def put(n: int, k: int, first: int, offset: int) -> None:
        runs.append((n, used[n], k, first, offset))
        used[n] += k
        left[n] -= k

    def opened(room: int, first: int, k: int) -> None:
        if room and k:
            if room not in gaps:
                insort(rooms, room)
                gaps[room] = []
            gaps[room].append((first, k))

    large = [n for n in left if 3 * n > capacity]
    ascending = sorted(large)
    for n in sorted(large, reverse=True):
        at = bisect_left(ascending, capacity - n + 1) - 1
        while left[n] and at >= 0:
            m = ascending[at]
            k = left[n] // 2 if m == n else min(left[n], left[m]) if m < n else 0
            if k:
                put(n, k, sequences, 0)
                put(m, k, sequences, n)
                opened(capacity - n - m, sequences, k)
                sequences += k
            at -= 1
        if k := left[n]:
            put(n, k, sequences, 0)
            opened(capacity - n, sequences, k)
            sequences += k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n] and (at := bisect_left(rooms, n)) < len(rooms):
            room = rooms[at]
            first, there = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[at]
            full, rest = divmod(left[n], room // n)  # a sequence that took one is the fullest with room until it can't take more
            full, rest = (there, 0) if full >= there else (full, rest)
            for j in range(room // n):
                if k := full + (j < rest):
                    put(n, k, first, capacity - room + j * n)
            opened(room, first + full + (rest > 0), there - full - (rest > 0))
            opened(room % n, first, full)
            if rest:
                opened(room - rest * n, first + full, 1)
        if c := left[n]:
            each = capacity // n
            full, rest = divmod(c, each)
            for j in range(each):
                if k := full + (j < rest):
                    put(n, k, sequences, j * n)
            opened(capacity - each * n, sequences, full)
            if rest:
                opened(capacity - rest * n, sequences + full, 1)
            sequences += full + (rest > 0)
    return runs


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 2, ids: bool = False) -> DataFrame:
    """The pieces of every document, in no order; with `ids` also their token ids."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            rows = [(d, k, s, n, raw[4 * s : 4 * (s + n)]) for d, raw in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True) for raw in [raw + end] for k, (s, n) in enumerate(cut(len(raw) // 4, capacity))]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [zlib.crc32(r[4]) for r in rows]]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array([np.frombuffer(r[4], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    ship(docs.sparkSession)
    return table(docs).mapInArrow(run, PIECES + (", ids array<int>" if ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Places every document's pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed as often as they come;
    an empty table gives no rows; other columns aren't looked at. Ties among pieces of a length go by doc_id, piece,
    digest and a number written with the pieces, so a task run again after a lost executor gives the same places.
    """
    spark = docs.sparkSession
    pieces = Stored(tokenize(docs, tokenizer, capacity, end_id).withColumn("_n", F.monotonically_increasing_id()), "pieces").df
    sizes = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` numbers
    each = max(RANKED, sum(sizes.values()) // WINDOWS)
    salts = spark.createDataFrame([(n, -(-c // each)) for n, c in sizes.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64("_n"), F.col("_salts")).cast("int"))
    # At most capacity + WINDOWS rows, whatever the corpus.
    counted = [(r[0], r[1], r[2]) for r in salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "_salt").collect()]
    counts: dict[int, int] = {}
    before: dict[tuple[int, int], int] = {}
    for n, salt, k in counted:
        before[n, salt] = counts.get(n, 0)
        counts[n] = counts.get(n, 0) + k
    runs = sorted(pack_counts(counts, capacity))
    plan = spark.sparkContext.broadcast(
        (np.array([(n << 44) + r for n, r, *_ in runs], np.int64), np.array([r[3] - r[1] for r in runs], np.int64), np.array([r[4] for r in runs], np.int64), before)
    )  # as many runs as lengths and changes of room, a few thousands for 1024
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "_n")

    def place(batches):
        keys, shift, offsets, start = plan.value
        for b in batches:
            length, salt = np.asarray(b.column("length")), np.asarray(b.column("_salt"))
            rank = np.asarray(b.column("_rank"), np.int64) - 1 + np.array([start[x] for x in zip(length.tolist(), salt.tolist(), strict=True)], np.int64)
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(rank + shift[at], pa.int64()), pa.array(offsets[at], pa.int64())], [x.split()[0] for x in PLACED.split(", ")])

    return salted.select("doc_id", "piece", "start", "length", "ids_crc32", "_salt", F.row_number().over(within).alias("_rank")).mapInArrow(place, PLACED)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and for each piece doc_id, piece, offset and length in order of place.

    Pieces are told apart by doc_id, piece and digest, so doc_id must not repeat with the same text.
    """
    ids = tokenize(docs, tokenizer, capacity, end_id, ids=True)
    keys = ["doc_id", "piece", "ids_crc32"]
    whole = placed.join(ids.select(*keys, "ids"), keys)
    return whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("_p")).select(
        "sequence_id", F.flatten("_p.ids").alias("ids"), F.transform("_p", lambda p: F.struct(p.doc_id.alias("doc_id"), p.piece.alias("piece"), p.offset.alias("offset"), p.length.alias("length"))).alias("pieces")
    )
