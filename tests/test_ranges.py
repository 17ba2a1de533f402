"""Order-dependent operators whose groups are cut into many ranges, against plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefold.functions import learn, numeric
from wavefold.operators import calibration, evaluation, longsignal, ranges, stats

R = random.Random(6)


@pytest.fixture(params=[1, 3, 10**6])
def size(request, monkeypatch):
    monkeypatch.setattr(ranges, "SIZE", request.param)
    return request.param


def test_running_sums_and_neighbours(spark, size):
    rows = [(R.choice(["hot", None]) if k < 60 else f"g{k % 3}", float(R.choice([R.randint(0, 40), -1.5])) if k % 17 else None, k, R.choice([None, k])) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, x double, k long, v long")
    for down in (False, True):
        order = [F.desc_nulls_last("x") if down else F.asc_nulls_first("x"), F.asc("k")]
        parted = ranges.cut(df, ["g"], "x", down)
        got = ranges.running(parted, ["g"], order, {"s": F.col("k")}, {"a": "v"}, {"b": "k"}).collect()
        assert len(got) == 90
        for g in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: ((r[1] is None, -(r[1] or 0)) if down else (r[1] is not None, r[1] or 0), r[2]))
            total = 0
            for i, r in enumerate(own):
                total += r[2]
                m = next(x for x in got if x.k == r[2])
                assert (m.s, m.s_all, m.a, m.b) == (total, sum(x[2] for x in own), own[i + 1][3] if i + 1 < len(own) else None, own[i - 1][2] if i else None)


def test_curves_and_areas_of_split_groups(spark, size):
    rows = [(R.choice("ab"), R.randint(0, 1), R.choice([R.random(), 0.5, 0.25])) for _ in range(120)] + [("one class", 1, 0.3), ("one class", 1, 0.4)]
    df = spark.createDataFrame(rows, "g string, y_true int, y_prob double")
    got = {r.g: r for r in evaluation.areas(df, ["g"]).collect()}
    curves = {(r.g, r.k): (r.threshold, r.fpr, r.tpr) for r in evaluation.roc_curve(df, ["g"]).collect()}
    ranks = {r.g: r for r in stats.mann_whitney(df, ["g"], "y_prob", "y_true").collect()}
    for g in "ab":
        own = [(p, y) for h, y, p in rows if h == g]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        u = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
        assert got[g].auc == pytest.approx(u / len(pos) / len(neg)) and ranks[g].u == pytest.approx(u) and (ranks[g].n1, ranks[g].n0) == (len(pos), len(neg))
        points, ap, area, last = [(math.inf, 0.0, 0.0)], 0.0, 0.0, (1.0, 0.0)
        for t in sorted({p for p, _ in own}, reverse=True):
            tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
            points.append((t, fp / len(neg), tp / len(pos)))
            now = (tp / (tp + fp), tp / len(pos))
            ap, area, last = ap + (now[1] - last[1]) * now[0], area + (now[1] - last[1]) * (now[0] + last[0]) / 2, now
        assert (got[g].ap, got[g].auprc) == pytest.approx((ap, area))
        kept = [curves[g, k] for k in range(sum(h == g for h, _ in curves))]
        assert kept[0] == points[0] and kept[1] == points[1] and kept[-1] == points[-1] and set(kept) <= set(points)
        for p in points:  # dropped points lie on the straight lines of those kept
            if p not in kept:
                a, b = max((q for q in kept if q[0] > p[0]), key=lambda q: -q[0]), max((q for q in kept if q[0] < p[0]), key=lambda q: q[0])
                assert (p[1] - a[1]) * (b[2] - a[2]) == pytest.approx((p[2] - a[2]) * (b[1] - a[1]), abs=1e-12)
    assert got["one class"].auc is None and curves["one class", 0][1] is None


@pytest.mark.parametrize("limit", [1, 5, 10**6])
def test_quantiles_are_exact(spark, limit):
    at = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    rows = [(None if k % 5 == 0 else "a", R.choice([R.random(), 7.0, -2.0])) for k in range(150)] + [("one", 3.0), ("none", None), ("a", None)]
    got = {r.g: r.q for r in ranges.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", at, size=limit).collect()}
    want = {g: np.quantile([v for h, v in rows if h == g and v is not None], at).tolist() for g in (None, "a", "one")}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in got)
    assert ranges.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", at).collect() == []
    whole = ranges.quantiles(spark.createDataFrame(rows, "g string, v double"), [], "v", at, size=limit).collect()
    assert whole[0].q == pytest.approx(np.quantile([v for _, v in rows if v is not None], at).tolist())


def test_interpolation_between_the_points_next_to_a_row(spark, size):
    points = [("a", float(x), float(R.randint(0, 9))) for x in R.sample(range(0, 200, 2), 40)] + [("a", 10.0, 3.0), ("a", 10.0, 8.0), ("b", 5.0, 1.0), (None, 1.0, 4.0), ("a", None, 1.0), ("a", 3.0, None)]
    asked = [("a", float(x), k) for k, x in enumerate(range(-5, 210, 3))] + [("a", 10.0, 900), ("b", 5.0, 901), ("b", 4.0, 902), ("c", 1.0, 903), (None, 1.0, 904), ("a", None, 905)]
    a, p = spark.createDataFrame(asked, "g string, x double, k long"), spark.createDataFrame(points, "g string, x double, y double")
    for hold in (False, True):
        got = {r.k: r for r in ranges.interpolate_asof(a, p, ["g"], hold=hold).collect()}
        assert len(got) == len(asked)
        for g, x, k in asked:
            known = {}
            for h, px, y in points:
                if h == g and px is not None and y is not None:
                    known.setdefault(px, []).append(y)
            low = max((q for q in known if x is not None and q <= x), default=None)
            high = min((q for q in known if x is not None and q >= x), default=None)
            if low is not None and high is not None:
                y = max(known[low]) if low == high else max(known[low]) + (min(known[high]) - max(known[low])) * (x - low) / (high - low)
            else:
                y = None if not hold or x is None else max(known[low]) if low is not None else min(known[high]) if high is not None else None
            assert (got[k].before, got[k].after) == (low, high) and got[k].y == (None if y is None else pytest.approx(y))


def test_peaks_apart_are_the_array_version_s(spark, size):
    for distance in (1, 2, 5, 40):
        rows = [(g, t, float(R.choice([0, 1, 2, 3, 4, 4, 5]))) for g in ("a", None) for t in range(120)]
        got = longsignal.peaks(spark.createDataFrame(rows, "g string, t long, v double").repartition(3), ["g"], 2.0, distance)
        for g in ("a", None):
            x = np.array([v for h, _, v in rows if h == g])
            assert sorted(r.t for r in got.collect() if r.g == g) == numeric.peaks(x, 2.0, distance).tolist()
        if size > 1:
            break
    assert longsignal.peaks(spark.createDataFrame([], "g string, t long, v double"), ["g"], 2.0, 3).collect() == []


def test_filters_go_on_from_block_to_block(spark):
    r = np.random.default_rng(2)
    filters = {n: numeric.band_filter(n, 250.0) for n in ("delta", "theta", "beta")} | {"gain": ([2.0], [1.0]), "delay": ([0.0, 1.0], [1.0])}
    x = {"a": r.normal(size=1000), None: r.normal(size=37)}
    rows = []
    for g, v in x.items():
        at, k = 0, 0
        while at < len(v):
            n = int(r.integers(0, 90))
            rows.append((g, k, v[at : at + n].tolist()))
            at, k = at + n, k + 1
    rows.append(("a", 10**6, None))
    df = spark.createDataFrame(rows, "g string, block long, samples array<double>").where("g is not null").repartition(3)
    got = longsignal.iir_blocks(df, ["g"], filters).collect()
    for name, (b, a) in filters.items():
        y = np.concatenate([np.array(q.samples, float) for q in sorted((q for q in got if q.band == name), key=lambda q: q.block)])
        assert np.allclose(y, numeric.lfilter(np.asarray(b, float), np.asarray(a, float), x["a"]), atol=1e-4 if name == "theta" else 1e-9)


def test_hulls():
    r = np.random.default_rng(3)
    for n in [1, 2, 3, 10, 200]:
        x, y = np.cumsum(r.integers(1, 4, n)).astype(float), np.cumsum(r.integers(-3, 4, n)).astype(float)
        at = calibration.lower_hull(x, y)
        assert at[0] == 0 and at[-1] == n - 1 and (np.diff(np.diff(y[at]) / np.diff(x[at])) > 0).all()
        assert (np.interp(x, x[at], y[at]) <= y + 1e-9).all()


def test_isotonic_fits_are_those_of_pooling(spark, size):
    rows = [(R.choice(["a", None]), R.choice([R.random(), 0.5]), R.randint(0, 1)) for _ in range(150)] + [("one", 0.5, 1), ("up", 0.1, 0), ("up", 0.2, 1), ("down", 0.1, 1), ("down", 0.2, 0), ("a", None, 1), ("a", 0.3, None)]
    df = spark.createDataFrame(rows, "g string, y_prob double, y_true int")
    blocks = calibration.isotonic(df, ["g"])
    asked = [(g, q / 50) for g in ("a", None, "one", "up", "down", "unknown") for q in range(-1, 53)]
    got = {(r.g, r.y_prob): r.calibrated for r in calibration.calibrated(spark.createDataFrame(asked, "g string, y_prob double"), blocks, ["g"]).collect()}
    for g in ("a", None, "one", "up", "down"):
        own = [(p, y) for h, p, y in rows if h == g and p is not None and y is not None]
        knots = learn.isotonic(np.array([p for p, _ in own]), np.array([y for _, y in own], float))
        for h, q in asked:
            if h == g:
                assert got[g, q] == pytest.approx(float(learn.calibrate(knots, np.array([q]))[0]))
    assert got["unknown", 0.5] is None and sum(r.weight for r in blocks.collect()) == 155
    assert calibration.isotonic(df.limit(0), ["g"]).collect() == []
