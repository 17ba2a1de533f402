"""The EDF data source: channels and times alone are read, large files are cut, filters are pushed down."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.sources import edf_source as E


def made(n=3, fs=8, seconds=6, seed=0):
    return np.round(np.random.default_rng(seed).normal(size=(n, fs * seconds)) * 1000)


class Counted(io.BytesIO):
    total = 0

    def read(self, n=-1):
        out = super().read(n)
        self.total += len(out)
        return out


def records(raw, wanted=None, begin=0, end=None, **more):
    f = Counted(raw)
    h = E.read_header(f, len(raw))
    f.total = 0
    rows = [r for b in E.read_records(f, "p", h, begin, len(raw) if end is None else end, wanted or E.Wanted(), **more) for r in b.to_pylist()]
    return rows, f.total


def test_only_the_asked_bytes_are_read():
    x = made()
    raw = E.encode(["A", "B", "C"], list(x), 8, -32768, 32767)
    rows, read = records(raw)
    assert read == 2 * x.size and len(rows) == 18
    for r in rows:
        k, s = "ABC".index(r["channel"]), int(r["start"])
        assert r["sfreq"] == 8 and r["samples"] == x[k, 8 * s : 8 * s + 8].tolist()
    rows, read = records(raw, E.Wanted(channels={"B"}, low=2, below=4), gap=0)
    assert read == 2 * 8 * 2 and [(r["channel"], r["start"]) for r in rows] == [("B", 2.0), ("B", 3.0)]
    assert records(raw, E.Wanted(channels={"B"}), gap=10**6)[1] == 2 * (x.size - 16)
    assert records(raw, E.Wanted(channels={"Z"})) == ([], 0) and records(raw, E.Wanted(low=99)) == ([], 0)
    assert records(raw, chunk=1)[0] == records(raw)[0]


@pytest.mark.parametrize("most", [1, 50, 100, 1000, 10**6])
def test_every_record_is_in_one_split(most):
    raws = {f"f{k}": E.encode(["A", "B"], list(made(2, 4, k)), 4, -32768, 32767) for k in range(5)}
    got = []
    for s in E.plan([(n, len(r)) for n, r in raws.items()], most):
        assert sum(e - b for _, _, b, e in s.parts) <= most
        for name, _, b, e in s.parts:
            got += [(name, r["channel"], r["start"]) for r in records(raws[name], begin=b, end=e)[0]]
    assert sorted(got) == sorted((f"f{k}", c, float(s)) for k in range(5) for s in range(k) for c in "AB")


def test_filters_narrow_what_is_asked():
    w = E.Wanted()
    s = ("start",)
    assert all(map(w.take, [E.In(("channel",), ("A", "B")), E.EqualTo(("channel",), "B"), E.GreaterThan(s, 1.0), E.LessThanOrEqual(s, 3.0), E.GreaterThanOrEqual(s, 0.5), E.LessThan(s, 9.0)]))
    assert w.channels == {"B"} and w.starts(np.arange(6.0)).tolist() == [False, False, True, True, False, False]
    assert not w.take(E.GreaterThan(("sfreq",), 1.0)) and not w.take(E.GreaterThan(("channel",), "A"))


def test_spark_reads_what_it_wrote(spark, tmp_path):
    root = str(tmp_path / "edf")
    x = [made(2, 4, 3, k) for k in range(7)]
    rows = spark.createDataFrame([(f"r{k}", 4.0, ["A", "B"], v[:, :11].tolist()) for k, v in enumerate(x)], "name string, sfreq double, channels array<string>, samples array<array<double>>")
    E.write(rows, root)
    E.write(rows.limit(1), root)
    got = E.scan(spark, root, ["B"], 1, partitionBytes=700)
    assert got.rdd.getNumPartitions() > 3
    back = {(r.path.rsplit("/", 1)[1], r.start): r.samples for r in got.collect()}
    full = [np.concatenate([v[1, :11], v[1, 10:11]]) for v in x]
    assert back == {(f"r{k}.edf", float(s)): v[4 * s : 4 * s + 4].tolist() for k, v in enumerate(full) for s in (1, 2)}
    pushed = E.scan(spark, "file://" + root).where("channel = 'A' and start < 1 and size(samples) = 4")
    assert pushed.count() == 7 and {r.path for r in pushed.collect()} == {f"file://{root}/r{k}.edf" for k in range(7)}
    assert E.scan(spark, str(tmp_path), suffix=".none").collect() == []


def test_a_file_of_more_than_two_gigabytes_is_read_in_parts(spark, tmp_path):
    path = tmp_path / "big.edf"
    raw = E.encode(["A", "B"], list(made(2, 1000, 2)), 1000, -32768, 32767)
    records_ = 800_000
    with open(path, "wb") as f:
        f.write(raw[:236] + str(records_).ljust(8).encode() + raw[244:768])
        f.truncate(768 + records_ * 4000)
        f.seek(768 + (records_ - 1) * 4000 + 2000)
        f.write(np.full(1000, 7, "<i2").tobytes())
    assert path.stat().st_size > 2 << 30
    reader = E.EdfReader({"path": str(path)})
    assert len(reader.partitions()) == 24
    last = E.scan(spark, str(path), ["B"], records_ - 2)
    assert [(r.start, set(r.samples)) for r in last.orderBy("start").collect()] == [(records_ - 2.0, {0.0}), (records_ - 1.0, {7.0})]
    assert E.scan(spark, str(path), ["A"], 10, 20).agg(F.count(F.lit(1))).first()[0] == 10


def test_paths_of_other_schemes(monkeypatch):
    asked = []
    monkeypatch.setattr(E.pafs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda u: asked.append(u) or (None, u))}))
    for p in ("s3a://b/x", "dbfs:/x/y", "file:/a", "/a b", "hdfs://h/x"):
        E.file_system(p)
    assert asked == ["s3://b/x", "file:///dbfs/x/y", "file:///a", "file:///a b", "hdfs://h/x"]
