"""Token-id files: documents' ids in ascending doc_id order, range-coded in independent checksummed blocks.

A file is one value of a binary column, so Spark's own writers carry it to any store and tasks read files apart:

    magic "WFIDRC02" | documents, blocks, directory bytes, table bytes: u32 each | ids: u64 | crc32 of directory and table: u32
    directory, deflated: doc_id i64 each | 1 where doc_id is null, u8 each | ids u32 each
    table of the file's ids, deflated: gaps between distinct ids, by their bytes | classes of their counts, u8 each
    blocks: ids, crc32 of the ids, payload bytes: u32 each | payloads

All numbers are little-endian. `file_no` counts a partition's files; partitions are ranges of doc_id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import rangecoder
from ._common import Stored, ship, slices, table
from .tokens import encoder

MAGIC = b"WFIDRC02"
_HEAD = struct.Struct("<8sIIIIQI")
#: A partition holds about so many bytes of text; beyond `MOST_PARTS` partitions each holds more, in more files.
PART_BYTES, MOST_PARTS = 25_000_000, 20_000
FILES = "part int, file_no int, n_docs long, n_tokens long, content binary"
DOCS = "part int, file_no int, doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + lengths.tobytes()
    directory = zlib.compress(names, 6)
    table, blocks = rangecoder.encode(np.frombuffer(b"".join(ids), "<u4"))
    head, heads = directory + table.dump(), np.array([(n, crc, len(p)) for n, crc, p in blocks], "<u4").reshape(-1, 3).tobytes()
    return b"".join([_HEAD.pack(MAGIC, len(ids), len(blocks), len(directory), len(head) - len(directory), int(lengths.sum()), zlib.crc32(head)), head, heads, *(b[2] for b in blocks)])


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, each document's number of ids, all ids; raises ValueError where magic, size or a checksum doesn't hold."""
    if len(raw) < _HEAD.size or raw[:8] != MAGIC:
        raise ValueError("not a token-id file")
    _, docs, count, size, table_size, total, crc = _HEAD.unpack_from(raw)
    at = _HEAD.size
    head = raw[at : at + size + table_size]
    if zlib.crc32(head) != crc:
        raise ValueError("the directory's checksum doesn't hold")
    names, table = zlib.decompress(head[:size]), rangecoder.Table.load(head[size:])
    ids, null, lengths = np.frombuffer(names[: 8 * docs], "<i8"), names[8 * docs : 9 * docs], np.frombuffer(names[9 * docs :], "<u4")
    at += size + table_size
    heads = np.frombuffer(raw[at : at + 12 * count], "<u4").reshape(-1, 3)
    at += 12 * count
    blocks = []
    for n, c, long in heads.tolist():
        blocks.append((n, c, raw[at : at + long]))
        at += long
    tokens = rangecoder.decode(table, blocks)
    if at != len(raw) or len(tokens) != total or int(lengths.sum()) != total:
        raise ValueError("the file's size doesn't hold")
    return [None if z else d for d, z in zip(ids.tolist(), null, strict=True)], lengths, tokens


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, file_tokens: int = 12_000_000) -> DataFrame:
    """The files of all documents: part, file_no, n_docs, n_tokens, content.

    Null counts as empty: the end id alone. Rows with a null doc_id come first; rows that repeat one are written as
    often as they come, in the order of the table. An empty table gives no files; other columns aren't looked at.
    """
    ship(docs.sparkSession)

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, number, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def full():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held // 4], pa.int64()), pa.array([pack_file(names, ids)], pa.binary())], [x.split()[0] for x in FILES.split(", ")])

        for b in slices(batches):
            for d, raw in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                names.append(d)
                ids.append(raw + end)
                held += len(raw) + 4
                if held >= 4 * file_tokens:
                    yield full()
                    number, names, ids, held = number + 1, [], [], 0
        if ids:
            yield full()

    texts = table(docs)
    parts = min(MOST_PARTS, 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
    # Rows without a doc_id, or that share one, are dealt out in the order they are read in.
    ranged = texts.withColumn("k", F.monotonically_increasing_id()).repartitionByRange(parts, "doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "text")
    return ranged.mapInArrow(run, FILES)


def read(files: DataFrame, ids: bool = False) -> DataFrame:
    """Every document of the files: part, file_no, doc_id, start (in its file), n_tokens, ids_crc32; with `ids` its ids."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                names, lengths, tokens = unpack_file(b.column("content")[k].as_py())
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(tokens).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array([b.column("part")[k].as_py()] * len(names), pa.int32()), pa.array([b.column("file_no")[k].as_py()] * len(names), pa.int32()), pa.array(names, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())]
                head = [x.split()[0] for x in DOCS.split(", ")]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens.astype(np.int32))))
                    head.append("ids")
                yield pa.RecordBatch.from_arrays(cols, head)

    return files.select("part", "file_no", "content").mapInArrow(run, DOCS + (", ids array<int>" if ids else ""))


def index(files: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of documents read from the files."""
    spark = files.sparkSession
    sizes = files.select("part", "file_no", "n_tokens")
    at = 0
    parts = []
    for part, n in sorted((r[0], r[1]) for r in sizes.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a number for each partition, MOST_PARTS at most
        parts.append((part, at))
        at += n
    begin = spark.createDataFrame(parts, "part int, _part long")
    own = Window.partitionBy("part").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.join(F.broadcast(begin), "part").select("part", "file_no", (F.col("_part") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("_at"))
    return docs.join(places, ["part", "file_no"]).select("doc_id", (F.col("_at") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the files to the shared folder, reads them back, and indexes what was read."""
    files = Stored(write(docs, tokenizer, end_id), "token-files").df
    return index(files, read(files))
