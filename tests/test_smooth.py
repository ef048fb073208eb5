import math

import numpy as np
import pytest

from panelweave.operators import panel, smooth, smooth_nb
from panelweave.operators.panel import PanelError

from .helpers import default_rows, frame

ALL = [m for m in smooth.METHODS if m != "none"]


def long(spark, x):
    rows = [(f"o{i}", k + 1, "f", float(v)) for i, s in enumerate(x) for k, v in enumerate(s)]
    return spark.createDataFrame(rows, "observation string, time_index int, feature string, abundance_value double").repartition(4)


def cube_of(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[int(r.observation[1:]), r.time_index - 1] = r.abundance_value
    return out


def kalman(y, back, qratio=0.1, initvar=100.0):
    """Local level filter in its usual recursive form, scaled by the variance."""
    r = y.var(ddof=1) or 1.0
    q, m, p = qratio * r, [y[0]], [initvar * r]
    for v in y[1:]:
        pred = p[-1] + q
        k = pred / (pred + r)
        m.append(m[-1] + k * (v - m[-1]))
        p.append((1 - k) * pred)
    if back:
        s = list(m)
        for t in range(len(y) - 2, -1, -1):
            s[t] = m[t] + p[t] / (p[t] + q) * (s[t + 1] - m[t])
        return np.array(s)
    return np.array(m)


def reference(method, y):
    n, t = len(y), np.arange(len(y))
    if method in ("ekf", "rts"):
        return kalman(y, method == "rts")
    if method == "ewma":
        out = [y[0]]
        for v in y[1:]:
            out.append(0.3 * v + 0.7 * out[-1])
        return np.array(out)
    if method == "moving_average":
        return np.array([y[max(0, i - 2) : i + 3].mean() for i in t])
    if method == "gaussian":
        w = np.exp(-0.5 * ((t[:, None] - t) / 2) ** 2) * (np.abs(t[:, None] - t) <= 6)
        return (w * y).sum(1) / w.sum(1)
    if method == "spline":
        d = np.zeros((max(n - 2, 0), n))
        for i in range(n - 2):
            d[i, i : i + 3] = 1, -2, 1
        return np.linalg.solve(np.eye(n) + d.T @ d, y)
    if method == "savgol":
        return np.array([np.polyval(np.polyfit(t[lo:hi] - i, y[lo:hi], 2), 0) for i in t for lo, hi in [(max(0, i - 2), i + 3)]])
    half = 0.75 * (n - 1) / 2
    out = []
    for i in t:
        w = np.clip(1 - (np.abs(t - i) / half) ** 3, 0, None) ** 1.5 * (np.abs(t - i) <= max(1, int(half)))
        use = w > 0
        out.append(np.polyval(np.polyfit(t[use] - i, y[use], 1, w=w[use]), 0))
    return np.array(out)


@pytest.mark.parametrize("method", ALL)
def test_against_recursions(spark, method):
    x = np.random.default_rng(2).normal(size=(4, 12)).cumsum(axis=1)
    want = np.array([reference(method, y) for y in x])
    assert np.allclose(cube_of(smooth.smooth(long(spark, x), 12, method, []), x.shape), want, atol=1e-9)


@pytest.mark.parametrize("method", [m for m in ALL if m not in smooth.WHOLE_SERIES])
def test_segments_do_not_mix(method):
    whole = smooth.weight_matrix(method, 9, [4])
    assert not whole[:3, 3:].any() and not whole[3:, :3].any()
    assert np.allclose(whole[3:, 3:], smooth.weight_matrix(method, 6))


@pytest.mark.parametrize("n", [1, 2, 3, 4])
@pytest.mark.parametrize("method", ALL)
def test_short_series_are_finite_and_keep_constants(method, n):
    w = smooth.weight_matrix(method, n)
    assert np.isfinite(w).all() and np.allclose(w.sum(axis=1), 1)


def test_incomplete_series_is_an_error(spark):
    df = long(spark, np.ones((2, 5))).where("not (observation = 'o0' and time_index = 3)")
    with pytest.raises(Exception, match="does not have 5 layers"):
        smooth.smooth(df, 5, "ekf").collect()


def test_rejections():
    for bad in (lambda: smooth.weight_matrix("nope", 3), lambda: smooth.weight_matrix("ewma", 3, alpha=0), lambda: smooth.segments(3, [4]), lambda: smooth.weight_matrix("ekf", 0)):
        with pytest.raises(PanelError):
            bad()


def test_panel_smoothing_stops_at_the_onset(spark):
    p = panel.from_long(frame(spark, default_rows(t=6, onset=4)))
    out = smooth.smooth_panel(p, "moving_average", halfwindow=5)
    got = {(r.observation, r.feature, r.time_index): r.abundance_value for r in out.long.collect()}
    src = {(r.observation, r.feature, r.time_index): r.abundance_value for r in p.long.collect()}
    for (o, f, t), v in got.items():
        part = range(1, 4) if t < 4 else range(4, 7)
        assert v == pytest.approx(np.mean([src[o, f, k] for k in part]))


def nb_reference(x, lib, q, phi, back):
    """One series of the negative-binomial filter, cell by cell."""
    t = len(x)
    z, p, ahead = [np.log((x[0] + 0.5) / lib[0])], [max(q, 1e-6)], [0.0]
    for k in range(1, t):
        pred = p[-1] + q
        m = lib[k] * np.exp(max(z[-1], -16))
        gain = pred * m / (m * m * pred + m + m * m / max(phi, 1e-4))
        z.append(z[-1] + gain * (x[k] - m))
        p.append((1 - gain * m) * pred)
        ahead.append(pred)
    s = list(z)
    if back:
        for k in range(t - 2, -1, -1):
            s[k] = z[k] + p[k] / ahead[k + 1] * (s[k + 1] - z[k])
    return lib * np.exp(np.maximum(s, -16))


@pytest.mark.parametrize("method", ["ekf", "rts"])
def test_negative_binomial(spark, method):
    rng = np.random.default_rng(3)
    x = rng.poisson(20, (3, 6)).astype(float)
    rows = [(f"o{i}", k + 1, f, float(x[i, k] + (f == "g"))) for i in range(3) for k in range(6) for f in ("f", "g")]
    df = spark.createDataFrame(rows, "observation string, time_index int, feature string, abundance_value double").repartition(3)
    out = smooth_nb.smooth_nb(df, 6, method).where("feature = 'f'")
    want = np.array([nb_reference(x[i], 2 * x[i] + 1, 0.1, 1.0, method == "rts") for i in range(3)])
    assert np.allclose(cube_of(out, (3, 6)), want)


def em_reference(x, lib, q, phi, rounds):
    """EM cell by cell: smooth every series, then update q and phi by moments."""
    n, t = x.shape
    z = [[math.log((x[i, k] + 0.5) / lib[i, k]) for k in range(t)] for i in range(n)]
    for _ in range(rounds):
        for i in range(n):
            f, p, ahead = [z[i][0]], [max(q, 1e-6)], [0.0]
            for k in range(1, t):
                pred = p[-1] + q
                m = lib[i, k] * math.exp(max(f[-1], -16))
                gain = pred * m / (m * m * pred + m + m * m / max(phi, 1e-4))
                f.append(f[-1] + gain * (x[i, k] - m))
                p.append((1 - gain * m) * pred)
                ahead.append(pred)
            s = list(f)
            for k in range(t - 2, -1, -1):
                s[k] = f[k] + p[k] / ahead[k + 1] * (s[k + 1] - f[k])
            z[i] = [max(v, -16) for v in s]
        q = max(sum((z[i][k] - z[i][k - 1]) ** 2 for i in range(n) for k in range(1, t)) / (n * (t - 1)), 1e-6)
        num = den = 0.0
        for i in range(n):
            for k in range(t):
                m = lib[i, k] * math.exp(z[i][k])
                acc = (x[i, k] - m) ** 2 - m
                if acc > 0:
                    num, den = num + m**3 / acc, den + m * m
        if den:
            phi = min(max(num / den, 1e-4), 1e3)
    return np.array(z), q, phi


def test_negative_binomial_em():
    rng = np.random.default_rng(5)
    lib = rng.uniform(500, 1500, (12, 6))
    x = rng.poisson(lib * 0.03 * np.exp(rng.normal(0, 0.3, (12, 6)).cumsum(axis=1))).astype(float)
    want, q, phi = em_reference(x, lib, 0.1, 1.0, 4)
    states, got_q, got_phi, rounds = smooth_nb.fit_feature(x, lib, 0.1, 1.0, np.ones(6), iterations=4)
    assert rounds == 4 and np.allclose(states, want) and got_q == pytest.approx(q) and got_phi == pytest.approx(phi)
    *_, rounds = smooth_nb.fit_feature(x, lib, 0.1, 1.0, np.ones(6))
    assert rounds <= 80


def test_negative_binomial_has_no_ceiling():
    x = np.array([[0.0, 0.0, 90.0, 0.0, 90.0], [90.0, 0.0, 0.0, 1.0, 0.0]])
    lib = np.full(x.shape, 100.0)
    for smooth_ in (False, True):
        z = smooth_nb.run_filter(x, lib, smooth_nb.start_states(x, lib)[:, 0], 0.5, 1.0, np.ones(5), smooth_)
        for i in range(2):
            assert np.allclose(lib[i] * np.exp(np.maximum(z[i], -16)), nb_reference(x[i], lib[i], 0.5, 1.0, smooth_))
        assert z.max() > 0  # a step from a tiny mean overshoots


def test_negative_binomial_em_on_the_cluster(spark):
    x = np.random.default_rng(6).poisson(30, (4, 5)).astype(float) + 1
    df = long(spark, x)
    lib = spark.createDataFrame([(f"o{i}", k + 1, 500.0) for i in range(4) for k in range(5)], "observation string, time_index int, library_size double")
    out = smooth_nb.smooth_nb(df, 5, "rts", library=lib, hierarchical=True)
    states, q, phi, _ = smooth_nb.fit_feature(x, np.full(x.shape, 500.0), 0.1, 1.0, np.ones(5))
    want = 500.0 * np.exp(smooth_nb.run_filter(x, np.full(x.shape, 500.0), states[:, 0], q, phi, np.ones(5), True))
    assert np.allclose(cube_of(out, x.shape), want)
    with pytest.raises(PanelError):
        smooth_nb.smooth_nb(df, 5, "ewma")


@pytest.mark.parametrize("method", ["ekf", "rts"])
def test_negative_binomial_em_of_large_features(spark, method):
    """Rounds over the series where they lie give what one task gives, feature by feature."""
    rng = np.random.default_rng(7)
    cube = rng.poisson(30 * np.exp(rng.normal(0, 0.4, (3, 9, 5)).cumsum(axis=2))).astype(float) + 1
    rows = [(f"o{i}", k + 1, f"f{j}", float(cube[j, i, k])) for j in range(3) for i in range(9 if j < 2 else 2) for k in range(5)]
    df = spark.createDataFrame(rows, "observation string, time_index int, feature string, abundance_value double").repartition(3)
    key = lambda r: (r.feature, r.observation, r.time_index)
    lib = spark.createDataFrame([(f"o{i}", k + 1, 500.0 + i) for i in range(9) for k in range(5)], "observation string, time_index int, library_size double")
    got, want = (
        sorted(smooth_nb.smooth_nb(df, 5, method, library=lib, hierarchical=True, em_iterations=12, task_cells=n).collect(), key=key) for n in (10, 45)
    )
    assert list(map(key, got)) == list(map(key, want)) and len(got) == 100
    assert np.allclose([r.abundance_value for r in got], [r.abundance_value for r in want], rtol=1e-9)
