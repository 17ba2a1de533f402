"""Feature families that need a transform or an eigenproblem: one Arrow call for each batch of recordings.

A recording's channels come as one row of a matrix column, so a task works on whole recordings, montages and segments
are cut once for all families asked for, and nothing is shuffled after the gathering by recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import graph, numeric
from .signal import EEG, weights

SCHEMA = "rec long, family string, montage string, seconds double, combiner string, features array<double>"
COMBINERS = ("mean", "median", "std", "skew", "kurt")


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Channels j > k in row-major order."""
    return np.tril_indices(n, -1)


# Each takes all segments of a recording (segments, channels, samples) at once and gives segments by features.


def _flat(rows: np.ndarray) -> np.ndarray:
    return rows.reshape(len(rows), -1)


def _spectral(x: np.ndarray, fs: float, whole: int) -> np.ndarray:
    return _flat(np.moveaxis(numeric.relative_power(x, fs), 0, 1))


def _in_parts(f: Callable) -> Callable:
    """Segments a few at a time, for transforms that need room."""
    return lambda x, fs, whole: np.concatenate([_flat(f(x[k : k + 4], fs)) for k in range(0, len(x), 4)])


def _temporal(x: np.ndarray, fs: float, whole: int) -> np.ndarray:
    return np.array([np.concatenate([numeric.temporal(c, fs) for c in s]) for s in x])


def _cc(x: np.ndarray, fs: float, whole: int) -> np.ndarray:
    return np.array([numeric.cross_correlations(s, *_pairs(x.shape[1])) for s in x])


def _plv(x: np.ndarray, fs: float, whole: int) -> np.ndarray:
    j, k = _pairs(x.shape[1])
    made = (x if band == "raw" else numeric.lfilter(*numeric.band_filter(band, fs), x) for band in ("raw", *numeric.BANDS))
    return np.concatenate([numeric.locking_matrix(np.angle(numeric.analytic(y)))[:, j, k] for y in made], axis=1)


def _profiles(w: np.ndarray, n: int) -> np.ndarray:
    out = []
    for row in w:
        m = np.zeros((n, n))
        m[_pairs(n)] = row
        out.append(graph.profile(graph.clean(m + m.T)))
    return np.array(out)


def _gplv(x: np.ndarray, fs: float, whole: int) -> np.ndarray:
    """The amplitudes themselves stand for phases, as the method has it."""
    j, k = _pairs(x.shape[1])
    return _profiles(numeric.locking_matrix(x)[:, j, k], x.shape[1])


#: family -> (features of all segments, whether the skewness combiner is biased)
FAMILIES: dict[str, tuple[Callable[[np.ndarray, float, int], np.ndarray], bool]] = {
    "spectral": (_spectral, False), "cwt": (lambda x, fs, w: _flat(numeric.cwt_energy(x, numeric.cwt_scales(w, fs))), True), "dwt": (lambda x, fs, w: _flat(numeric.dwt_energy(x)), False),
    "mst": (_in_parts(numeric.mst), False), "sst": (_in_parts(numeric.sst), False), "utm": (_temporal, False), "plv": (_plv, False), "cc": (_cc, True),
    "gcc": (lambda x, fs, w: _profiles(_cc(x, fs, w), x.shape[1]), False), "gplv": (_gplv, False),
}
ALIASES = {"kurtosis": "kurt", "sr": "spectral", "skewness": "skew"}


def register_family(name: str, f: Callable[[np.ndarray, float, int], np.ndarray], bias: bool = False) -> None:
    """Adds a family: f(segments x channels x samples, sampling frequency, samples of the recording) -> segments x features."""
    FAMILIES[name] = f, bias


def width(family: str, n: int) -> int:
    """How many features n output channels give."""
    p = n * (n - 1) // 2
    return {"spectral": 5 * n, "cwt": 26 * n, "dwt": 24 * n, "mst": 6 * n, "sst": 6 * n, "utm": 13 * n, "plv": 6 * p, "cc": p, "gcc": 20, "gplv": 20}[ALIASES.get(family, family)]


def montage_matrix(name: str) -> np.ndarray:
    rows = weights(name)
    out = np.zeros((len(rows), EEG))
    for k, row in enumerate(rows):
        for c, w in row.items():
            out[k, c] = w
    return out


def segment_features(x: np.ndarray, family: str, fs: float, seconds: float, how: tuple[Callable, bool] | None = None) -> np.ndarray:
    """5 combiners by features of one recording after montage; a recording shorter than a segment is one segment, whose
    features stand for every combiner."""
    f, bias = how or FAMILIES[family]
    size, n = int(fs * seconds), x.shape[1]
    count = n // size if size else 0
    if count == 0:
        return np.tile(f(x[None], fs, n), (5, 1))
    rows = f(x[:, : count * size].reshape(len(x), count, size).swapaxes(0, 1), fs, n)
    with np.errstate(all="ignore"):
        return numeric.combine(rows, bias)


def extract(recordings: DataFrame, grid: list[tuple[str, str, float]], fs: float = 250.0) -> DataFrame:
    """recordings (rec, ch, samples) and a grid of (family, montage, seconds) -> a row for each and each combiner.

    NaN and infinite features are null. Recordings without all EEG channels of one length have no rows; an unknown
    family or montage is an error at once.
    """
    grid = [(ALIASES.get(f, f), m, s) for f, m, s in grid]
    for f, m, _ in grid:
        if f not in FAMILIES:
            raise ValueError(f"unknown family {f!r}")
        montage_matrix(m)
    own = {f: FAMILIES[f] for f, _, _ in grid}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mats = {m: montage_matrix(m) for _, m, _ in grid}
        for b in batches:
            for rec, chans in zip(b.column("rec").to_pylist(), b.column("channels"), strict=True):
                x = np.asarray(chans.values.field("samples").flatten(), float).reshape(EEG, -1)
                made = {m: mats[m] @ x for m in mats}
                rows = [segment_features(made[m], f, fs, s, own[f]) for f, m, s in grid]
                n = len(COMBINERS)
                flat = np.concatenate([row.ravel() for row in rows]) if rows else np.empty(0)
                ends = np.concatenate([[0], np.cumsum(np.repeat([row.shape[1] for row in rows], n))]).astype(np.int32)
                features = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, mask=~np.isfinite(flat)))
                names = [pa.array([g[k] for g in grid for _ in COMBINERS]) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([rec] * (n * len(grid)), pa.int64()), *names, pa.array([float(g[2]) for g in grid for _ in COMBINERS]), pa.array(list(COMBINERS) * len(grid)), features], [c.split()[0] for c in SCHEMA.split(", ")])

    eeg = recordings.where(F.col("ch") < EEG).select("rec", "ch", "samples")
    whole = eeg.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("ch", "samples"))).alias("channels"), F.countDistinct(F.size("samples")).alias("_n"))
    return whole.where((F.size("channels") == EEG) & (F.col("_n") == 1)).select("rec", "channels").mapInArrow(run, SCHEMA)


def connectivity_profiles(edges: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """edges (keys, i, j, w) -> the 20 kept graph measures of each graph."""
    schema = ", ".join(f"{k} long" for k in keys) + ", features array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((nodes, nodes))
        w[pdf["i"], pdf["j"]] = w[pdf["j"], pdf["i"]] = pdf["w"]
        row = graph.profile(graph.clean(w))
        return pd.DataFrame([[*pdf[keys].iloc[0], [float(v) if np.isfinite(v) else None for v in row]]], columns=[*keys, "features"])

    return edges.groupBy(*keys).applyInPandas(run, schema)  # a group is one graph: at most nodes * (nodes - 1) / 2 rows


def node_measures(edges: DataFrame, keys: list[str], nodes: int) -> DataFrame:
    """Of each node: module, eigenvector centrality, betweenness, mean path length and eccentricity."""
    schema = ", ".join(f"{k} long" for k in keys) + ", u long, module int, centrality double, betweenness double, path_length double, eccentricity double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((nodes, nodes))
        w[pdf["i"], pdf["j"]] = w[pdf["j"], pdf["i"]] = pdf["w"]
        d = graph.distances(graph.clean(w, scale=False))
        off = np.where(np.eye(nodes, dtype=bool) | ~np.isfinite(d), np.nan, d)
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * nodes for k in keys} | {"u": range(nodes)})
        some = np.isfinite(off).any(axis=1)
        return out.assign(module=graph.modules(w), centrality=graph.eigenvector_centrality(w), betweenness=graph.betweenness(w), path_length=[np.nanmean(r) if s else np.nan for r, s in zip(off, some, strict=True)], eccentricity=[np.nanmax(r) if s else np.nan for r, s in zip(off, some, strict=True)])

    return edges.groupBy(*keys).applyInPandas(run, schema)


def preprocess(recordings: DataFrame, fs: float, target: float = 250.0, low: float = 0.1, notch: float | None = 60.0) -> DataFrame:
    """rec, ch, samples: FIR band-pass from `low` to fs / 2 - 0.1, notch, resampling; channel by channel, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x in b["samples"]:
                y = numeric.fir_bandpass(np.array(x, float), fs, low, fs / 2 - 0.1)
                if notch is not None and notch < fs / 2:
                    y = numeric.notch(y, fs, notch)
                out.append(numeric.resample(y, fs, target) if fs != target else y)
            yield b.assign(samples=out)

    return recordings.select("rec", "ch", "samples").mapInPandas(run, "rec long, ch long, samples array<double>")
