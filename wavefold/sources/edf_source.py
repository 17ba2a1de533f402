"""EDF recordings as a Spark data source.

    spark.dataSource.register(EdfSource)
    spark.read.format("edf").load(folder).where("channel in ('O1', 'O2') and start >= 60")

Planning lists files and cuts them by bytes, as text files are cut; each task reads a file's header and then only the bytes
of the asked channels in the data records that begin in its range and in the asked time. Filters on path, channel and
start are pushed down, for which `register` sets spark.sql.python.filterPushdown.enabled; `scan` asks by options.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import shared

SCHEMA = "path string, channel string, start double, sfreq double, samples array<double>"
#: Bytes of files that a task reads from, bytes that are read at a time, and gaps that are read through.
PARTITION, CHUNK, GAP = 128 << 20, 8 << 20, 4096


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it: the schemes s3a and s3n are s3's, dbfs is mounted at /dbfs."""
    path = re.sub("^file:/+", "file:///", path)
    path = re.sub("^s3[an]://", "s3://", path)
    path = re.sub("^dbfs:/+", "file:///dbfs/", path)
    return pafs.FileSystem.from_uri(path if re.match("[a-z0-9]+://", path) else "file://" + os.path.abspath(path))


@dataclass
class Header:
    """Where a file's data records begin, how many there are, their length in seconds and bytes, and of each signal its name,
    samples and offset (in bytes) in a record, scale and shift of its values."""

    size: int
    records: int
    seconds: float
    record: int
    names: list[str]
    counts: list[int]
    offsets: list[int]
    scale: list[float]
    shift: list[float]


def read_header(f, length: int) -> Header:
    first = f.read(256)
    text = lambda a, n, raw=first: raw[a : a + n].decode("ascii", "replace").strip()
    n = int(text(252, 4))
    rest, at, fields = f.read(256 * n), 0, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([text(at + k * width, width, rest) for k in range(n)])
        at += width * n
    pmin, pmax, dmin, dmax = (np.array([float(x) for x in fields[k]]) for k in (3, 4, 5, 6))
    counts = [int(x) for x in fields[8]]
    size, record = int(text(184, 8)), 2 * sum(counts)
    there = (length - size) // record if record else 0  # a file may be shorter than it says, and -1 says nothing
    said = int(text(236, 8))
    scale = (pmax - pmin) / np.where(dmax == dmin, 1, dmax - dmin)
    return Header(size, there if said < 0 else min(said, there), float(text(244, 8)), record, fields[0], counts, (2 * np.cumsum([0, *counts[:-1]])).tolist(), scale.tolist(), (pmin - dmin * scale).tolist())


@dataclass
class Wanted:
    """What is asked for: None is all; times are of a record's start, closed or open at either end."""

    paths: set | None = None
    channels: set | None = None
    low: float = -np.inf
    high: float = np.inf
    above: float = -np.inf
    below: float = np.inf

    def take(self, f: Filter) -> bool:
        """Narrows this by a filter, if that can be said here."""
        name = getattr(f, "attribute", None)
        if name in (("channel",), ("path",)) and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            key = "channels" if name == ("channel",) else "paths"
            setattr(self, key, values if getattr(self, key) is None else getattr(self, key) & values)
            return True
        if name != ("start",):
            return False
        if isinstance(f, EqualTo):
            self.low, self.high = max(self.low, f.value), min(self.high, f.value)
        elif isinstance(f, GreaterThanOrEqual):
            self.low = max(self.low, f.value)
        elif isinstance(f, LessThanOrEqual):
            self.high = min(self.high, f.value)
        elif isinstance(f, GreaterThan):
            self.above = max(self.above, f.value)
        elif isinstance(f, LessThan):
            self.below = min(self.below, f.value)
        else:
            return False
        return True

    def starts(self, start: np.ndarray) -> np.ndarray:
        return (start >= self.low) & (start <= self.high) & (start > self.above) & (start < self.below)


@dataclass
class Splits(InputPartition):
    """Files and the ranges of their bytes in which the records begin that a task reads."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts):
        super().__init__(None)
        self.parts = parts


def plan(files: list[tuple[str, int]], most: int) -> list[Splits]:
    """Files (path, length): large ones are cut, small ones put together, up to `most` bytes."""
    out, now, held = [], [], 0
    for path, length in files:
        for begin in range(0, max(length, 1), most):
            end = min(begin + most, length)
            if now and held + end - begin > most:
                out.append(Splits(now))
                now, held = [], 0
            now.append((path, length, begin, end))
            held += end - begin
    return [*out, Splits(now)] if now else out


def pieces(intervals: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Ascending intervals of bytes, put together where no more than `gap` bytes lie between them."""
    out: list[list[int]] = []
    for a, b in intervals:
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def read_records(f, path: str, h: Header, begin: int, end: int, wanted: Wanted, gap: int = GAP, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows of the records that begin in [begin, end), one for each channel and record."""
    if not h.record:
        return
    first, last = (min(max(-(-(x - h.size) // h.record), 0), h.records) for x in (begin, end))
    own = np.arange(first, last)
    own = own[wanted.starts(own * h.seconds)]
    signals = [k for k, n in enumerate(h.names) if h.counts[k] and (wanted.channels is None or n in wanted.channels)]
    if not len(own) or not signals:
        return
    span = max(1, chunk // h.record)
    for i in range(0, len(own), span):
        some = own[i : i + span].tolist()
        at = [[h.size + r * h.record + h.offsets[k] for k in signals] for r in some]
        held = {}
        for a, b in pieces([(x, x + 2 * h.counts[k]) for row in at for x, k in zip(row, signals, strict=True)], gap):
            f.seek(a)
            held[a] = np.frombuffer(f.read(b - a), np.uint8)
        begins = np.array(sorted(held))
        values, sizes, names, starts, rates = [], [], [], [], []
        for r, row in zip(some, at, strict=True):
            for x, k in zip(row, signals, strict=True):
                a = int(begins[np.searchsorted(begins, x, side="right") - 1])
                values.append(held[a][x - a : x - a + 2 * h.counts[k]].view("<i2") * h.scale[k] + h.shift[k])
                sizes.append(h.counts[k])
                names.append(h.names[k])
                starts.append(r * h.seconds)
                rates.append(h.counts[k] / h.seconds if h.seconds else 0.0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(names)), pa.array(names), pa.array(starts), pa.array(rates), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))], ["path", "channel", "start", "sfreq", "samples"])


class EdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("suffix", ".edf")
        self.most, self.gap = int(options.get("partitionBytes", PARTITION)), int(options.get("gap", GAP))
        split = options.get("channels")
        self.wanted = Wanted(channels=None if split is None else set(split.split(",")), low=float(options.get("from", -np.inf)), below=float(options.get("to", np.inf)))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def files(self) -> list[tuple[str, int]]:
        fs, root = file_system(self.root)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(self.glob)]
        scheme = re.match("([a-z0-9]+://|[a-z0-9]+:/)?", self.root)[0]
        full = lambda p: p if not scheme else "file://" + p if scheme.startswith("file") else p if fs.type_name == "local" else scheme + p.lstrip("/") if "s3" in scheme or scheme.startswith("g") else re.match("[a-z0-9]+://[^/]*", self.root)[0] + p
        listed = sorted((full(x.path), x.size) for x in found)
        return [x for x in listed if self.wanted.paths is None or x[0] in self.wanted.paths]

    def partitions(self) -> list[Splits]:
        return plan(self.files(), self.most) or [Splits([])]

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        for path, length, begin, end in partition.parts:
            fs, name = file_system(path)
            with fs.open_input_file(name) as f:
                yield from read_records(f, path, read_header(f, length), begin, end, self.wanted, self.gap)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class EdfWriter(DataSourceWriter):
    """Rows (name, sfreq, channels, samples: an array for each channel): a file for each, in records of a second. A file
    of that name is replaced, so that a task can be run again."""

    def __init__(self, options: dict):
        self.root, self.low, self.high = options["path"], float(options.get("low", -32768)), float(options.get("high", 32767))

    def write(self, rows: Iterator) -> Written:
        fs, root = file_system(self.root)
        fs.create_dir(root, recursive=True)
        done = []
        for r in rows:
            path = f"{root}/{r.name}.edf"
            with fs.open_output_stream(path + ".part") as f:  # seen under its name only when it is whole
                f.write(encode(list(r.channels), [np.asarray(x, float) for x in r.samples], r.sfreq, self.low, self.high))
            fs.move(path + ".part", path)
            done.append(path)
        return Written(done)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        for m in messages:
            for p in m.paths if m else []:
                fs, _ = file_system(self.root)
                fs.delete_file(p)


def encode(names: list[str], samples: list[np.ndarray], sfreq: float, low: float, high: float) -> bytes:
    """An EDF file; values are clipped to low .. high and rounded to 65,535 steps between; the last second is filled up with the last value."""
    fs, n = int(sfreq), len(names)
    if fs != sfreq or fs < 1 or len({len(x) for x in samples}) > 1 or n != len(samples):
        raise ValueError("channels of one length and a whole number of samples a second are needed")
    seconds = -(-len(samples[0]) // fs) if n else 0
    pad = lambda v, w: str(v)[:w].ljust(w).encode("ascii", "replace")
    number = lambda v: pad(f"{v:.8g}", 8)
    head = [pad("0", 8), pad("", 160), pad("01.01.00", 8), pad("00.00.00", 8), pad(256 * (n + 1), 8), pad("", 44), pad(seconds, 8), pad(1, 8), pad(n, 4)]
    head += [pad(x, 16) for x in names] + [pad("", 80)] * n + [pad("uV", 8)] * n + [number(low)] * n + [number(high)] * n + [pad(-32768, 8)] * n + [pad(32767, 8)] * n + [pad("", 80)] * n + [pad(fs, 8)] * n + [pad("", 32)] * n
    full = [np.pad(x, (0, seconds * fs - len(x)), mode="edge") if len(x) else x for x in samples]
    steps = [np.clip(np.round((x - low) / (high - low) * 65535 - 32768), -32768, 32767).astype("<i2").reshape(seconds, fs) for x in full]
    return b"".join(head) + (np.concatenate(steps, axis=1).tobytes() if n else b"")


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        return EdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> EdfWriter:
        return EdfWriter(self.options)


def register(spark: SparkSession) -> None:
    shared.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EdfSource)


def scan(spark: SparkSession, root: str, channels: list[str] | None = None, begin: float | None = None, end: float | None = None, **options) -> DataFrame:
    """SCHEMA of the recordings below root: a row for each channel and data record that starts in [begin, end). Only what is
    asked for is read. A file shorter than its header says counts as far as it goes; channels of one name are all read."""
    register(spark)
    asked = {"channels": None if channels is None else ",".join(channels), "from": begin, "to": end, **options}
    reader = spark.read.format("edf")
    for k, v in asked.items():
        if v is not None:
            reader = reader.option(k, str(v))
    return reader.load(root)


def write(rows: DataFrame, root: str, **options) -> None:
    """rows (name, sfreq, channels array<string>, samples array<array<double>>): a file for each row."""
    register(rows.sparkSession)
    rows.write.format("edf").options(**options).mode("append").save(root)
