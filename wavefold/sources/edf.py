"""EDF recordings: discovery, header, samples and reports, read by Spark's binary and text sources."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import relational
from .edf_source import file_system

SIGNALS = "path string, name string, sfreq double, samples array<double>"


def discover(spark: SparkSession, root: str, glob: str = "*.edf") -> DataFrame:
    """path, length, content of every file below root; content is read only where it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def headers(files: DataFrame, size: int = 88) -> DataFrame:
    """path, header (its first 88 bytes), age and gender; no more of a file is read. Paths are of local, hdfs, s3 (also as
    s3a and s3n), gs or mounted dbfs file systems."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = []
            for path in b.column("path").to_pylist():
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    heads.append(f.read(size).decode("ascii", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(heads, pa.string())], ["path", "header"])

    return relational.age_gender(files.select("path").mapInArrow(run, "path string, header string"))


def parse(raw: bytes) -> list[tuple[str, float, np.ndarray]]:
    """Name, sampling frequency and physical values of each signal of an EDF file."""
    text = lambda a, n: raw[a : a + n].decode("ascii", "replace").strip()
    size, records, seconds, n = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    at, fields = 256, []
    for width in (16, 80, 8, 8, 8, 8, 8, 80, 8, 32):
        fields.append([text(at + k * width, width) for k in range(n)])
        at += width * n
    names, counts = fields[0], np.array([int(x) for x in fields[8]])
    pmin, pmax, dmin, dmax = (np.array([float(x) for x in fields[k]]) for k in (3, 4, 5, 6))
    data = np.frombuffer(raw, "<i2", offset=size)
    if records < 0:
        records = len(data) // counts.sum()
    data = data[: records * counts.sum()].reshape(records, counts.sum())
    out, begin = [], 0
    for k in range(n):
        own = data[:, begin : begin + counts[k]].ravel().astype(float)
        begin += counts[k]
        out.append((names[k], float(counts[k] / seconds), (own - dmin[k]) * (pmax[k] - pmin[k]) / (dmax[k] - dmin[k]) + pmin[k]))
    return out


def signals(files: DataFrame) -> DataFrame:
    """path, name, sfreq, samples: one row for each channel, a file a task at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = [(path, name, fs, x) for name, fs, x in parse(content)]
                yield pd.DataFrame(rows, columns=["path", "name", "sfreq", "samples"])

    return files.select("path", "content").mapInPandas(run, SIGNALS)


def reports(spark: SparkSession, root: str) -> DataFrame:
    """folder, name, report: the text files beside recordings; utf-8, else latin-1. Fails on an empty one."""
    files = discover(spark, root, "*.txt").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("folder", "name", F.when(F.length(text) == 0, F.raise_error(F.concat(F.lit("empty report in "), F.col("folder"))).cast("string")).otherwise(text).alias("report"))


def dates(spark: SparkSession, root: str) -> DataFrame:
    """folder, date: the JSON files beside recordings that name the day they were taken."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root, schema="date date")
    return rows.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"), "date").where("date is not null").groupBy("folder").agg(F.min("date").alias("date"))


def recording_dates(files: DataFrame, keep: bool = True) -> DataFrame:
    """path, date (null where neither names one), source ("side-car" or "header"), kept (whether a side-car is there now).

    A recording's date is that of the side-car beside it (its name with _date.txt for .edf: a JSON object of year, month
    and day); without one, that of its header, which is then kept in a side-car, so that the next time the recording isn't opened. A
    folder that can't be written costs nothing else. A header's years 85 to 99 are 19.., the others 20...
    """

    def one(path: str) -> tuple[str, date | None, str, bool]:
        fs, name = file_system(path)
        side = re.sub(r"\.edf$", "", name) + "_date.txt"
        if fs.get_file_info(side).type == pafs.FileType.File:
            with fs.open_input_file(side) as f:
                d = json.loads(f.read())
            return path, date(int(d["year"]), int(d["month"]), int(d["day"])), "side-car", True
        with fs.open_input_file(name) as f:
            text = f.read(176)[168:176].decode("ascii", "replace")
        try:
            day, month, year = (int(x) for x in text.split("."))
            found = date(year + (1900 if year >= 85 else 2000), month, day)
        except ValueError:
            return path, None, "header", False
        if keep:
            try:
                with fs.open_output_stream(side) as f:
                    f.write(json.dumps({"year": found.year, "month": found.month, "day": found.day}).encode())
            except OSError:
                return path, found, "header", False
        return path, found, "header", keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(map(one, b.column("path").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.date32(), pa.string(), pa.bool_()))], ["path", "date", "source", "kept"])

    return files.select("path").mapInArrow(run, "path string, date date, source string, kept boolean")


def descriptions(spark: SparkSession, root: str, schema: str = "path string, subject string, session int, segment int, year int, month int, day int, epilepsy int") -> DataFrame:
    """The description CSV files (with a header) below root, columns by name, and pos, a row's place in its file."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("enforceSchema", False).csv(root, schema=schema)
    # Blocks of a file are read in any order; within a block rows are numbered as they come.
    return rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("pos"))


def subject_labels(described: DataFrame, label: str = "epilepsy") -> DataFrame:
    """subject and the label of its first row."""
    return relational.first_label(described.where("subject is not null"), "subject", label, "pos")


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """One row for each file: description from path and header, report of its folder if there is one (several are put
    together in the order of their names)."""
    described = relational.path_description(headers(discover(spark, root)), keep=("age", "gender"))
    texts = reports(spark, root).groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "report"))), lambda r: r.report), "\n").alias("report"))
    return described.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).join(texts, "folder", "left").drop("folder")


def fake_recording(spark: SparkSession, channels: int = 21, fs: int = 10, seconds: int = 360, seed: int = 0) -> DataFrame:
    """rec, ch, t, v of standard normal noise."""
    n = fs * seconds
    return spark.range(channels * n).select(F.lit(0).cast("long").alias("rec"), F.expr(f"id div {n}").alias("ch"), (F.col("id") % n).alias("t"), F.randn(seed).alias("v"))


def write_edf(path: str, names: list[str], x: np.ndarray, fs: int, patient: str = "") -> None:
    """A small EDF file for tests and exports: one-second records, 16-bit values over the data's range."""
    n, seconds = len(names), x.shape[1] // fs
    low, high = float(x.min()), float(max(x.max(), x.min() + 1))
    pad = lambda v, w: str(v)[:w].ljust(w).encode("ascii")
    head = [pad("0", 8), pad(patient, 80), pad("", 80), pad("01.01.00", 8), pad("00.00.00", 8), pad(256 * (n + 1), 8), pad("", 44), pad(seconds, 8), pad(1, 8), pad(n, 4)]
    lo, hi = f"{low:.6f}"[:8], f"{high:.6f}"[:8]
    for values, w in ((names, 16), ([""] * n, 80), (["uV"] * n, 8), ([lo] * n, 8), ([hi] * n, 8), ([-32768] * n, 8), ([32767] * n, 8), ([""] * n, 80), ([fs] * n, 8), ([""] * n, 32)):
        head += [pad(v, w) for v in values]
    scaled = np.clip(np.round((x[:, : seconds * fs] - float(lo)) / (float(hi) - float(lo)) * 65535 - 32768), -32768, 32767).astype("<i2")
    with open(path, "wb") as f:
        f.write(b"".join(head) + scaled.reshape(n, seconds, fs).transpose(1, 0, 2).tobytes())
