"""Signal operators on the long form (rec, ch, t, v) in built-in expressions, and on arrays where whole channels meet.

Everything that belongs to one (rec, ch) or (rec, t) is shuffled once on that key; windows and aggregates after it reuse
the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import numeric

#: Canonical channels in order of their row.
CHANNELS = ("FP1", "F3", "C3", "P3", "F7", "T3", "T5", "O1", "FZ", "CZ", "PZ", "FP2", "F4", "C4", "P4", "F8", "T4", "T6", "O2", "PHOTIC PH")
EEG, STIM, CZ = 19, 19, 9
#: Rows of anode and cathode of each bipolar derivation.
BIPOLAR = ((0, 4), (4, 5), (5, 6), (6, 7), (0, 1), (1, 2), (2, 3), (3, 7), (11, 15), (15, 16), (16, 17), (17, 18), (8, 9), (9, 10), (11, 12), (12, 13), (13, 14), (14, 18))
#: The neighbours whose mean is taken from each row in the Laplacian derivation.
NEIGHBOURS = (
    (4, 11, 1), (0, 4, 8, 2), (1, 5, 9, 3), (2, 6, 10, 7), (0, 1, 5), (2, 4, 6), (5, 3, 7), (6, 3, 18), (1, 11, 2, 12, 9), (2, 8, 10, 13), (18, 3, 14, 7, 9), (0, 15, 12),
    (11, 15, 8, 13), (12, 16, 9, 14), (13, 17, 10, 18), (11, 12, 16), (17, 13, 15), (18, 14, 16), (14, 17, 7),
)


def weights(name: str, channels: int = EEG) -> list[dict[int, float]]:
    """A montage as a sparse matrix: of each output channel, input rows and weights."""
    if name == "CAR":
        return [{j: (1.0 if i == j else 0.0) - 1.0 / channels for j in range(channels)} for i in range(channels)]
    if name == "Cz":
        return [{i: 1.0, CZ: -1.0} for i in range(channels) if i != CZ]
    if name == "BipolarDB":
        return [{a: 1.0, c: -1.0} for a, c in BIPOLAR]
    if name == "Laplacian":
        return [{i: 1.0} | {j: -1.0 / len(near) for j in near} for i, near in enumerate(NEIGHBOURS)]
    raise ValueError(f"unknown montage {name!r}")


def montage(signal: DataFrame, name: str, include_stim: bool = False) -> DataFrame:
    """rec, out_ch, t, v of a montage. One shuffle on (rec, t) gathers a sample's channels into columns; outputs are
    linear expressions of these. A sample without one of an output's channels has no such output."""
    count = EEG + include_stim if name in ("CAR", "Cz") else EEG
    wide = signal.where(F.col("ch") < count).groupBy("rec", "t").agg(*(F.max(F.when(F.col("ch") == k, F.col("v"))).alias(f"c{k}") for k in range(count)))
    if name == "CAR":
        mean = sum((F.col(f"c{k}") for k in range(1, count)), F.col("c0")) / count
        wide = wide.withColumn("m", mean)
        outs = [F.col(f"c{k}") - F.col("m") for k in range(count)]
    else:
        outs = [sum((F.col(f"c{j}") * w for j, w in list(row.items())[1:]), F.col(f"c{next(iter(row))}") * next(iter(row.values()))) for row in weights(name, count)]
    return wide.select("rec", "t", F.posexplode(F.array(*outs)).alias("out_ch", "v")).where("v is not null").select("rec", F.col("out_ch").cast("long").alias("out_ch"), "t", "v")


def _times(w: float):
    return lambda a: a * w


def _plus(w: float):
    return lambda a, b: a + b * w


def montage_arrays(arrays: DataFrame, name: str, partial: bool = False) -> DataFrame:
    """The same from rec, ch, samples to rec, out_ch, samples: one shuffle by recording, of arrays and not of samples.
    Recordings without all EEG channels have no rows, but with `partial` the average of CAR is that of the channels which have
    a sample, and those that are there come out."""
    rows = arrays.where(F.col("ch") < EEG).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("ch", "samples"))).alias("_c"))
    if partial:
        if name != "CAR":
            raise ValueError(f"{name} needs all channels")
        return _partial_average(rows)
    rows = rows.where(F.size("_c") == EEG)
    x = rows.select("rec", F.transform("_c", lambda c: c.samples).alias("_x"))
    at = lambda k: F.col("_x")[k]
    if name == "CAR":
        mean = F.transform(F.sequence(F.lit(0), F.size(at(0)) - 1), lambda t: F.aggregate("_x", F.lit(0.0), lambda s, c: s + c[t]) / EEG)
        x = x.withColumn("_m", F.when(F.size(at(0)) > 0, mean).otherwise(F.array().cast("array<double>")))
        outs = [F.zip_with(at(k), F.col("_m"), lambda a, b: a - b) for k in range(EEG)]
    else:
        outs = []
        for row in weights(name):
            (k, w), *rest = row.items()
            out = at(k) if w == 1 else F.transform(at(k), _times(w))
            for j, v in rest:
                out = F.zip_with(out, at(j), _plus(v))
            outs.append(out)
    return x.select("rec", F.posexplode(F.array(*outs)).alias("out_ch", "samples")).select("rec", F.col("out_ch").cast("long").alias("out_ch"), "samples")


def _partial_average(rows: DataFrame) -> DataFrame:
    """rows (rec, _c: ch and samples of each channel) less the mean of the channels at each sample."""
    x = F.transform("_c", lambda c: c.samples)
    at = lambda t: F.filter(F.transform("_x", lambda c: F.get(c, t)), lambda v: v.isNotNull())
    long = F.array_max(F.transform("_x", lambda c: F.size(c)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(a), F.lit(0))
    means = F.transform(F.transform(F.sequence(F.lit(0), long - 1), at), mean)
    own = rows.withColumn("_x", x).withColumn("_m", F.when(long > 0, means).otherwise(F.array().cast("array<double>"))).select("rec", "_m", F.inline("_c"))
    return own.select("rec", F.col("ch").cast("long").alias("out_ch"), F.transform("samples", lambda v, t: v - F.get("_m", t)).alias("samples"))


def array_segments(arrays: DataFrame, length: int) -> DataFrame:
    """Adds seg and cuts samples to it; a signal shorter than one window is one segment."""
    n = F.size("samples")
    count = F.greatest(F.floor(n / F.lit(length)), F.lit(1))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: F.slice("samples", (k * length + 1).cast("int"), F.lit(length)))
    return arrays.select(*[c for c in arrays.columns if c != "samples"], F.posexplode(cut).alias("seg", "samples"))


def array_energy(seg: DataFrame) -> DataFrame:
    """Adds energy and vpp of each segment's samples."""
    return seg.withColumn("energy", F.aggregate("samples", F.lit(0.0), lambda s, v: s + v * v)).withColumn("vpp", F.array_max("samples") - F.array_min("samples"))


def segments(signal: DataFrame, length: int, fallback: bool = True, by: tuple[str, ...] = ("rec", "ch")) -> DataFrame:
    """Adds seg: tumbling windows of `length` samples without the incomplete last one. With `fallback` a signal shorter
    than one window is one segment, else it has none."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    seg = F.expr(f"t div {length}")
    whole = signal.withColumn("_n", n)
    keep = whole.where(F.col("_n") >= length).withColumn("seg", seg).where(F.col("seg") < F.expr(f"_n div {length}")) if not fallback else whole.withColumn("seg", F.when(F.col("_n") >= length, seg).otherwise(F.lit(0).cast("long"))).where((F.col("_n") < length) | (F.col("seg") < F.expr(f"_n div {length}")))
    return keep.drop("_n")


def skewness(x: Column, bias: bool = True) -> Column:
    """Skewness aggregate; unbiased from three values on, null where the values don't vary."""
    n, g1 = F.count(x).cast("double"), F.skewness(x)
    return g1 if bias else F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))).otherwise(g1)


def combine(features: DataFrame, keys: list[str], value: str = "value", bias: bool = False) -> DataFrame:
    """The five combiners of a feature over its segments in one pass."""
    x = F.col(value)
    return features.groupBy(*keys).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), skewness(x, bias).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def temporal_basic(seg: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median, population deviation, skewness, kurtosis, energy and peak-to-peak value of each segment."""
    x = F.col("v")
    return seg.groupBy(*keys).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"), F.sum(x * x).alias("energy"), (F.max(x) - F.min(x)).alias("vpp"))


def _ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("t")


def zero_crossings(signal: DataFrame, keys: list[str]) -> DataFrame:
    """How often the sign changes from one sample to the next."""
    s = signal.withColumn("_p", F.lag(F.signum("v")).over(_ordered(keys)))
    return s.groupBy(*keys).agg(F.count_if(F.col("_p") != F.signum("v")).alias("crossings"))


def nleo(signal: DataFrame, keys: list[str], l: int, p: int, q: int, s: int) -> DataFrame:  # noqa: E741
    """Adds nleo = x[n-l] x[n-p] - x[n-q] x[n-s]; zero within l + p + q + s + 1 samples of the ends."""
    w, edge = _ordered(keys), abs(l) + abs(p) + abs(q) + abs(s)
    x = lambda k: F.lag("v", k).over(w) if k >= 0 else F.lead("v", -k).over(w)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    inside = (F.col("t") >= edge + 1) & (F.col("t") < F.col("_n") - edge - 1)
    return signal.withColumn("_n", n).withColumn("nleo", F.when(inside, x(l) * x(p) - x(q) * x(s)).otherwise(0.0)).drop("_n")


def moving_average(signal: DataFrame, keys: list[str], width: int) -> DataFrame:
    """avg of the last `width` samples, where there are as many."""
    w = _ordered(keys)
    return signal.withColumn("avg", F.avg("v").over(w.rowsBetween(-(width - 1), 0))).where(F.col("t") >= width - 1)


def peak_candidates(signal: DataFrame, keys: list[str], height: float) -> DataFrame:
    """Samples above both neighbours and of at least `height`."""
    w = _ordered(keys)
    x = signal.withColumn("_a", F.lag("v").over(w)).withColumn("_b", F.lead("v").over(w))
    return x.where((F.col("v") > F.col("_a")) & (F.col("v") > F.col("_b")) & (F.col("v") >= height)).drop("_a", "_b")


def histogram_entropy(signal: DataFrame, keys: list[str], bins: int = 1024) -> DataFrame:
    """Entropy in bits of the values' shares of equal bins between least and largest."""
    span = Window.partitionBy(*keys)
    x = signal.withColumn("_lo", F.min("v").over(span)).withColumn("_w", F.max("v").over(span) - F.min("v").over(span)).withColumn("_n", F.count(F.lit(1)).over(span))
    b = x.withColumn("_b", F.least(F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.col("_w")), F.lit(0.0)) * bins), F.lit(bins - 1)))
    p = F.col("_c") / F.col("_n")
    return b.groupBy(*keys, "_b", "_n").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg((-F.sum(p * F.log2(p)) + 0.0).alias("entropy"))


# The same on arrays of whole channels: no row a sample, and no shuffle


def array_zero_crossings(arrays: DataFrame) -> DataFrame:
    """Adds crossings: how often the sign of the samples less their mean changes. None in an array of less than two."""
    x, n = F.col("samples"), F.greatest(F.size("samples") - 1, F.lit(0))
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    s = arrays.withColumn("_m", F.when(F.size(x) > 0, mean)).withColumn("_s", F.transform(x, lambda v: F.signum(v - F.col("_m"))))
    turns = F.zip_with(F.slice("_s", F.lit(2), n), F.slice("_s", F.lit(1), n), lambda a, b: a != b)
    return s.withColumn("crossings", F.size(F.filter(turns, lambda c: c)).cast("long")).drop("_m", "_s")


def array_nleo(arrays: DataFrame, l: int, p: int, q: int, s: int) -> DataFrame:  # noqa: E741
    """Adds nleo, an array: x[n-l] x[n-p] - x[n-q] x[n-s], zero within |l| + |p| + |q| + |s| + 1 samples of the ends."""
    edge, x = abs(l) + abs(p) + abs(q) + abs(s) + 1, F.col("samples")
    at = lambda t, k: F.get(x, t - k)
    value = lambda v, t: F.when((t >= edge) & (t < F.size(x) - edge), at(t, l) * at(t, p) - at(t, q) * at(t, s)).otherwise(F.lit(0.0))
    return arrays.withColumn("nleo", F.transform(x, value))


def array_moving_average(arrays: DataFrame, width: int) -> DataFrame:
    """samples becomes the mean of each `width` samples in a row, the first of them at index 0; empty where there are fewer."""
    x = F.col("samples")
    starts = F.when(F.size(x) >= width, F.sequence(F.lit(1), F.size(x) - width + 1)).otherwise(F.array().cast("array<int>"))
    return arrays.withColumn("samples", F.transform(starts, lambda k: F.aggregate(F.slice(x, k, F.lit(width)), F.lit(0.0), lambda s, v: s + v) / width))


def array_peak_candidates(arrays: DataFrame, height: float) -> DataFrame:
    """Adds peaks, an array of (t, v): samples above both neighbours and of at least `height`."""
    x = F.col("samples")
    high = F.filter(F.transform(x, lambda v, t: F.struct(t.cast("long").alias("t"), v.alias("v"))), lambda s: (s.v >= height) & (s.v > F.get(x, (s.t - 1).cast("int"))) & (s.v > F.get(x, (s.t + 1).cast("int"))))
    return arrays.withColumn("peaks", high)


def iir_energies(arrays: DataFrame, filters: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """arrays (keys, samples) -> keys, band, energy of the samples through each filter (b, a), from rest. Rows of one length
    are filtered together, in time linear in their samples."""
    keys = [c for c in arrays.columns if c != "samples"]
    made = {n: tuple(np.asarray(c, float) for c in ba) for n, ba in filters.items()}

    def run(batches):
        for b in batches:
            col = b.column("samples")
            sizes, flat, offsets = np.diff(np.asarray(col.offsets)), np.asarray(col.values, float), np.asarray(col.offsets)
            energy = np.zeros((len(made), b.num_rows))
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                x = flat[offsets[own][:, None] + np.arange(n)]
                for k, (p, q) in enumerate(made.values()):
                    energy[k, own] = np.square(numeric.lfilter(p, q, x)).sum(axis=-1)
            for k, name in enumerate(made):
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array([name] * b.num_rows), pa.array(energy[k])], [*keys, "band", "energy"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrays.schema if f.name != "samples")
    return arrays.select(*keys, "samples").mapInArrow(run, f"{kinds}, band string, energy double")


# Stimulus periods


def stim_bounds(signal: DataFrame, level: float = 0.0, stim: int = STIM) -> DataFrame:
    """rec, first, last: the first and last sample where the stimulus channel is above `level`; no row where it never is."""
    return signal.where((F.col("ch") == stim) & (F.col("v") > level)).groupBy("rec").agg(F.min("t").alias("first"), F.max("t").alias("last"))


def stim_periods(signal: DataFrame, bounds: DataFrame, buffer: int) -> DataFrame:
    """Adds kind: "stim" from `buffer` samples before the first to `buffer` after the last (kept inside the recording),
    "rest" for the others, with t counted anew in each."""
    j = signal.join(bounds, "rec")
    inside = F.col("t").between(F.greatest(F.col("first") - buffer, F.lit(0)), F.col("last") + buffer)
    kind = j.withColumn("kind", F.when(inside, "stim").otherwise("rest"))
    return kind.select("rec", "ch", "kind", (F.row_number().over(Window.partitionBy("rec", "ch", "kind").orderBy("t")) - 1).cast("long").alias("t"), "v")


def trim_calibration(signal: DataFrame, amplitude: float, tolerance: float, stim: int = STIM) -> DataFrame:
    """Drops what comes before the stimulus channel first falls below amplitude - tolerance; nothing where it never does."""
    start = signal.where((F.col("ch") == stim) & (F.abs("v") < amplitude - tolerance)).groupBy("rec").agg(F.min("t").alias("_s"))
    return signal.join(start, "rec", "left").where(F.col("t") >= F.coalesce("_s", F.lit(0))).select("rec", "ch", (F.col("t") - F.coalesce("_s", F.lit(0))).alias("t"), "v")


def split_midpoint(signal: DataFrame, recordings: list[int], overlap: int) -> DataFrame:
    """Adds half: the listed recordings are cut in the middle into 0 and 1 that share `overlap` samples each side; others are 0."""
    n = F.max("t").over(Window.partitionBy("rec")) + 1
    mid = F.expr("_n div 2")
    x = signal.withColumn("_n", n)
    chosen = F.col("rec").isin(recordings)
    halves = F.when(~chosen, F.array(F.lit(0))).otherwise(F.filter(F.array(F.when(F.col("t") < mid + overlap, 0), F.when(F.col("t") >= mid - overlap, 1)), lambda h: h.isNotNull()))
    return x.withColumn("half", F.explode(halves)).drop("_n")


def has_channels(signal: DataFrame, required: list[int]) -> DataFrame:
    """Recordings with every required channel."""
    need = F.array(*[F.lit(c).cast("long") for c in required])
    return signal.groupBy("rec").agg(F.collect_set("ch").alias("_s")).where(F.size(F.array_except(need, "_s")) == 0).select("rec")


def long_enough(signal: DataFrame, seconds: float, fs: float) -> DataFrame:
    return signal.groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") / fs >= seconds)


def valid_stimulus(signal: DataFrame, least: int, level: float = 0.0, stim: int = STIM) -> DataFrame:
    """Recordings whose stimulus channel isn't silent and that have at least `least` samples."""
    return signal.where(F.col("ch") == stim).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("v") > level).alias("on")).where(F.col("on") & (F.col("n") >= least)).select("rec", "n")


def add_missing_channel(signal: DataFrame, channel: int) -> DataFrame:
    """Recordings without the channel get one of zeros, as long as they are."""
    have = signal.where(F.col("ch") == channel).select("rec").distinct()
    times = signal.join(have, "rec", "left_anti").select("rec", "t").distinct()
    return signal.unionByName(times.select("rec", F.lit(channel).cast("long").alias("ch"), "t", F.lit(0.0).alias("v")))


def prepare_photostim(signal: DataFrame, discarded: DataFrame, keys: list[str], fs: float, seconds: float = 30.0, amplitude: float = 100.0, tolerance: float = 20.0, scale: float = 1e-6, stim: int = STIM) -> DataFrame:
    """signal (keys, rec, ch, t, v) of recordings with flashes: without those in `discarded` (keys), with all channels up to
    the stimulus alone, without what comes before the calibration's end, the stimulus scaled, and only recordings that then
    have some stimulus and at least `seconds`. Filters and another sampling rate are families.preprocess's, on arrays."""
    kept = signal.join(discarded, keys, "left_anti")
    whole = kept.where(F.col("ch") <= stim)
    picked = whole.join(has_channels(whole, list(range(stim + 1))), "rec", "left_semi")
    trimmed = trim_calibration(picked, amplitude, tolerance, stim).withColumn("v", F.when(F.col("ch") == stim, F.col("v") * scale).otherwise(F.col("v")))
    on = trimmed.where(F.col("ch") == stim).groupBy("rec").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("v") != 0).alias("on")).where(F.col("on") & (F.col("n") / fs >= seconds))
    return trimmed.join(on.select("rec"), "rec", "left_semi")


def extract_periods(signal: DataFrame, fs: float, buffer_seconds: float = 1.0, split: list[int] | None = None, level: float = 0.0, stim: int = STIM) -> DataFrame:
    """signal (rec, ch, t, v) -> rec, half, ch, kind, t, v: the stimulus period with a buffer on both sides ("stim") and the
    rest of the recording ("rest"), each counted anew. Periods of the recordings in `split` hold two and are cut in the
    middle into halves 0 and 1, which share a buffer each side."""
    buffer = int(fs * buffer_seconds)
    cut = stim_periods(signal, stim_bounds(signal, level, stim), buffer)
    rest = cut.where("kind = 'rest'").withColumn("half", F.lit(0))
    halves = split_midpoint(cut.where("kind = 'stim'"), split or [], buffer)
    again = F.col("t") - F.min("t").over(Window.partitionBy("rec", "half"))
    return halves.withColumn("t", again).select("rec", "half", "ch", "kind", "t", "v").unionByName(rest.select("rec", "half", "ch", "kind", "t", "v"))


# Pairs of channels


def _locking(x: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    return numeric.locking_matrix(x)[j, k]


def _zero_lag(x: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    product, e = np.abs(x @ x.T), np.sqrt(np.square(x).sum(axis=-1))
    scale = e[j] * e[k]
    return np.divide(product[j, k], scale, out=np.zeros(len(j)), where=scale > 0)


#: Of channels (rows) j and k: |mean exp i(x - y)| with the values taken for phases, the correlation without lag, and the
#: largest correlation over all lags.
PAIR_MEASURES = {"locking": _locking, "zero_lag": _zero_lag, "any_lag": numeric.cross_correlations}


def pair_measure(arrays: DataFrame, measure: str, length: int | None = None, channels: int = EEG) -> DataFrame:
    """arrays (rec, ch, samples) -> rec, seg, i, j, w: a measure of each pair of channels i > j in each segment of `length`
    samples (the whole recording without one, or where it is shorter).

    One shuffle, of arrays and by recording; pairs are products of a recording's channels inside its row. Channels are
    compared as far as the shortest goes.
    """
    f = PAIR_MEASURES[measure]

    def run(batches):
        for b in batches:
            out = [[] for _ in range(5)]
            for rec, chans in zip(b.column("rec").to_pylist(), b.column("c"), strict=True):
                ch = np.asarray(chans.values.field("ch"))
                samples = chans.values.field("samples")
                n = int(np.diff(np.asarray(samples.offsets)).min()) if len(ch) else 0
                x = np.stack([samples[k].values.to_numpy(zero_copy_only=False)[:n] for k in range(len(ch))]) if len(ch) else np.empty((0, 0))
                j, k = np.tril_indices(len(ch), -1)
                size = length if length and n >= length else n
                for seg in range(n // size if size else 0):
                    out[0].append(np.full(len(j), rec))
                    out[1].append(np.full(len(j), seg))
                    out[2].append(ch[j])
                    out[3].append(ch[k])
                    out[4].append(f(x[:, seg * size : (seg + 1) * size], j, k))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0), t) for c, t in zip(out, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["rec", "seg", "i", "j", "w"])

    rows = arrays.where(F.col("ch") < channels).groupBy("rec").agg(F.array_sort(F.collect_list(F.struct(F.col("ch").cast("long").alias("ch"), "samples"))).alias("c"))
    return rows.select(F.col("rec").cast("long").alias("rec"), "c").mapInArrow(run, "rec long, seg long, i long, j long, w double")
