"""Kernels against closed forms and invariants."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from wavefold.functions import graph, learn, numeric

R = np.random.default_rng(0)


@pytest.mark.parametrize("n", [16, 64, 65, 101])
def test_wavelet_step_is_invertible(n):
    x = R.normal(size=n)
    assert np.allclose(numeric.idwt_step(*numeric.dwt_step(x))[:n], x)


def test_butterworth_has_unit_gain_inside_and_half_power_at_the_edge():
    b, a = numeric.butterworth(4, 8, 13, 250)
    gain = lambda f: abs(np.polyval(b, np.exp(-2j * np.pi * f / 250)) / np.polyval(a, np.exp(-2j * np.pi * f / 250)))
    h = lambda f: abs(sum(c * np.exp(-2j * np.pi * f / 250 * k) for k, c in enumerate(b)) / sum(c * np.exp(-2j * np.pi * f / 250 * k) for k, c in enumerate(a)))
    assert h(10.2) == pytest.approx(1, abs=1e-3) and h(8) == pytest.approx(2**-0.5, abs=1e-6) and h(40) < 1e-3
    assert gain(10.2) > 0


def test_sine_power_is_in_its_band():
    t = np.arange(2000) / 250
    p = numeric.relative_power(np.sin(2 * np.pi * 10 * t)[None], 250).ravel()
    assert p.argmax() == 2 and p[2] > 0.9 and p.sum() == pytest.approx(1)
    assert not numeric.relative_power(np.zeros((1, 50)), 250).any()


def test_phase_locking_of_a_signal_with_itself():
    x = R.normal(size=128)
    assert numeric.phase_locking(x, x) == pytest.approx(1)


def test_cross_correlation_finds_a_shift():
    x = R.normal(size=100)
    y = np.concatenate([np.zeros(7), x])[:100]
    assert numeric.cross_correlation(x, y) > 0.9 and numeric.cross_correlation(x, x) == pytest.approx(1) and numeric.cross_correlation(x, 0 * x) == 0


def test_zero_phase_filter_keeps_a_slow_wave_in_place():
    t = np.arange(1000) / 100
    x = np.sin(2 * np.pi * t)
    assert np.abs(numeric.filtfilt(*numeric.butterworth(2, None, 10, 100), x) - x)[100:-100].max() < 1e-2


def test_band_pass_stops_a_constant_and_keeps_its_band():
    for fs in (160.0, 250.0):
        h = numeric.fir_taps(fs, 0.1, fs / 2 - 0.1)
        gain = lambda f: abs((h * np.exp(-2j * np.pi * f / fs * np.arange(len(h)))).sum())
        assert gain(0) < 0.01 and gain(fs / 2) < 0.01 and all(gain(f) == pytest.approx(1, abs=0.01) for f in (0.3, 1, 10, fs / 2 - 0.4))
        t = np.arange(int(60 * fs)) / fs
        x = np.sin(2 * np.pi * 7 * t)
        assert np.abs(numeric.fir_bandpass(x + 50, fs, 0.1, fs / 2 - 0.1) - x)[2000:-2000].max() < 0.02
    assert numeric.fir_bandpass(np.ones((3, 64)), 250, 0.1, 124.9).shape == (3, 64)


def test_resampling_and_notch():
    t = np.arange(500) / 500
    x = np.sin(2 * np.pi * 5 * t)
    assert np.allclose(numeric.resample(x, 500, 250), x[::2], atol=1e-9)
    hum = np.sin(2 * np.pi * 60 * np.arange(5000) / 500)
    assert np.abs(numeric.notch(hum, 500)[1000:-1000]).max() < 0.05


def test_peaks_keep_the_higher_of_near_ones():
    x = np.zeros(30)
    x[[5, 7, 20]] = [60, 80, 55]
    assert numeric.peaks(x, 50, 5).tolist() == [7, 20] and numeric.peaks(x, 50, 1).tolist() == [5, 7, 20]


def test_energy_operators():
    x = np.sin(0.3 * np.arange(200))
    assert np.allclose(numeric.nleo(x, 0, 0, 1, -1)[10:-10], np.sin(0.3) ** 2)
    assert np.allclose(numeric.energy_operator(x, "env_only"), x**2)
    assert len(numeric.energy_operator(x[:199], "envelope_diff")) == 199
    with pytest.raises(ValueError):
        numeric.energy_operator(x, "other")


def test_moments_of_constant_and_small_samples():
    assert all(np.isnan(v).all() for v in numeric.moments(np.ones((5, 1))))
    g = numeric.moments(np.array([[1.0], [2], [4], [8], [16]]))
    assert g[0][0] == pytest.approx(0.88905, abs=1e-4) and g[1][0] == pytest.approx(3 - 0.67406, abs=1e-4)
    assert np.isnan(numeric.combine(np.ones((1, 2)), False)[2]).all()


def test_complete_graph():
    w = np.ones((5, 5)) - np.eye(5)
    p = dict(zip([n for n in graph.NAMES if n], graph.profile(w), strict=True))
    assert p["clustering"] == p["path_length"] == p["global_efficiency"] == p["transitivity"] == p["edge_overlap"] == pytest.approx(1)
    assert p["degree"] == p["coreness"] == 4 and p["betweenness"] == 0


def test_two_cliques_are_two_modules():
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    np.fill_diagonal(w, 0)
    w[3, 4] = w[4, 3] = 0.1
    m = graph.modules(w)
    assert len(set(m[:4])) == len(set(m[4:])) == 1 and m[0] != m[4]


def test_path_graph_betweenness_and_distances():
    w = np.diag(np.ones(3), 1)
    w = w + w.T
    assert graph.betweenness(w).tolist() == [0, 4, 4, 0] and graph.distances(w)[0, 3] == 3


def test_boosting_learns_and_shapley_values_add_up():
    x = R.normal(size=(80, 4))
    x[R.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) > 0).astype(int)
    b = learn.Booster(learn.BoostParams(trees=8, depth=3)).fit(x, y)
    assert ((b.predict(x) > 0.5) == y).mean() > 0.9
    assert np.allclose(b.shap(x).sum(axis=1), b.margin(x))


def test_shapley_values_are_the_brute_force_ones():
    x = R.normal(size=(60, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)
    b = learn.Booster(learn.BoostParams(trees=1, depth=3, subsample=1.0, gamma=0.0)).fit(x, y)
    feature, cut, left, right, _, value, cover = b.trees[0]

    def expect(v, known, n=0):
        if feature[n] < 0:
            return value[n]
        if feature[n] in known:
            return expect(v, known, left[n] if v[feature[n]] <= cut[n] else right[n])
        return (cover[left[n]] * expect(v, known, left[n]) + cover[right[n]] * expect(v, known, right[n])) / cover[n]

    for v, got in zip(x[:5], b.shap(x[:5]), strict=True):
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            parts = [(1 / 3 if len(s) in (0, 2) else 1 / 6) * (expect(v, {*s, f}) - expect(v, set(s))) for k in range(3) for s in itertools.combinations(rest, k)]
            assert got[f] == pytest.approx(sum(parts))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_is_monotone_and_keeps_the_mean(pairs):
    x, y = np.array(pairs, float).T
    knots = learn.isotonic(x, y)
    fit = learn.calibrate(knots, x)
    assert (np.diff(knots[1]) >= -1e-12).all() and fit.mean() == pytest.approx(y.mean())


def test_stacker_weights_lie_on_the_simplex():
    z = R.normal(size=(60, 3))
    w = learn.simplex_stacker(z, (z[:, 0] + 0.1 * z[:, 1] > 0).astype(int))
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and w.argmax() == 0


def test_quantiles_and_threshold():
    assert learn.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and learn.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert learn.optimal_threshold(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.6, 0.9])) == 0.6
