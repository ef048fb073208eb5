"""Smoothing of every (observation, feature) series along time.

All Gaussian-model methods are linear: ``y = W x`` with a T x T matrix that
depends on the number of layers, the segments and the parameters only, never
on the data.  So one operator serves them all: the driver builds ``W`` (T is at
most 1000), the plan carries it as one broadcast row, and each series is one
array.  One shuffle on (observation, feature), everything in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import MAX_LAYERS, Panel, PanelError, from_series, to_series

METHODS = ("none", "ekf", "rts", "gaussian", "loess", "savgol", "moving_average", "ewma", "spline")
#: Methods that run over the whole series; the others stop at breakpoints.
WHOLE_SERIES = ("ekf", "rts")


def segments(n: int, breakpoints: list[int] | None = None) -> list[tuple[int, int]]:
    """Half-open 0-based ranges; a breakpoint (1-based) starts a segment."""
    cuts = sorted(set(breakpoints or []))
    if any(not 1 <= b <= n for b in cuts):
        raise PanelError(f"breakpoints must lie in 1..{n}")
    starts = sorted({0, *(b - 1 for b in cuts)})
    return list(zip(starts, [*starts[1:], n], strict=True))


def local_level(n: int, qratio: float = 0.1, initvar: float = 100.0, smooth: bool = False) -> np.ndarray:
    """Filter (or RTS smoother) of a local level model as a matrix.

    Observation variance, state variance and prior are all proportional to the
    series' variance, so the gains do not depend on it.
    """
    w = np.zeros((n, n))
    w[0, 0] = 1.0
    p, before, after = initvar, [initvar], [initvar]
    for t in range(1, n):
        pred = p + qratio
        gain = pred / (pred + 1.0)
        w[t] = (1 - gain) * w[t - 1]
        w[t, t] += gain
        p = (1 - gain) * pred
        before.append(pred)
        after.append(p)
    if smooth:
        for t in range(n - 2, -1, -1):
            g = after[t] / before[t + 1]
            w[t] = w[t] + g * (w[t + 1] - w[t])
    return w


def _local_fit(n: int, at: int, weights: np.ndarray, degree: int) -> np.ndarray:
    """Row of W: weighted polynomial fit at ``at``; the degree falls until solvable."""
    use = np.flatnonzero(weights > 0)
    if len(use) == 0:
        use, weights = np.array([at]), np.eye(n)[at]
    x, wt = (use - at).astype(float), weights[use]
    for d in range(min(degree, len(use) - 1), -1, -1):
        a = np.vander(x, d + 1, increasing=True)
        gram = a.T @ (wt[:, None] * a)
        if np.linalg.matrix_rank(gram) == d + 1:
            row = np.zeros(n)
            row[use] = np.linalg.solve(gram, (wt[:, None] * a).T)[0]
            return row
    raise AssertionError("degree 0 is always solvable")


def _kernel(n: int, weight, degree: int) -> np.ndarray:
    d = np.arange(n)
    return np.array([_local_fit(n, i, weight(np.abs(d - i).astype(float)), degree) for i in range(n)])


def gaussian(n: int, sigma: float = 2.0) -> np.ndarray:
    if sigma <= 0:
        raise PanelError("sigma must be positive")
    radius = max(1, math.floor(3 * sigma + 0.5))
    return _kernel(n, lambda d: np.where(d <= radius, np.exp(-0.5 * (d / sigma) ** 2), 0.0), 0)


def loess(n: int, span: float = 0.75) -> np.ndarray:
    """Local lines under tricube weights; short segments fall back to means."""
    if span <= 0:
        raise PanelError("span must be positive")
    half = span * (n - 1) / 2
    radius, scale = max(1, math.floor(half)), max(1.0, half)
    return _kernel(n, lambda d: np.where(d <= radius, np.clip(1 - (d / scale) ** 3, 0, None) ** 3, 0.0), 1)


def savgol(n: int, halfwindow: int = 2, degree: int = 2) -> np.ndarray:
    if halfwindow < 1 or degree < 0:
        raise PanelError("halfwindow must be at least 1 and degree at least 0")
    return _kernel(n, lambda d: (d <= halfwindow).astype(float), degree)


def ewma(n: int, alpha: float = 0.3) -> np.ndarray:
    if not 0 < alpha <= 1:
        raise PanelError("alpha must lie in (0, 1]")
    w = np.zeros((n, n))
    w[0, 0] = 1.0
    for t in range(1, n):
        w[t] = (1 - alpha) * w[t - 1]
        w[t, t] += alpha
    return w


def spline(n: int, lam: float = 1.0) -> np.ndarray:
    """Inverse of I + lambda D'D with second differences; identity up to two points."""
    if n <= 2:
        return np.eye(n)
    d = np.diff(np.eye(n), 2, axis=0)
    return np.linalg.inv(np.eye(n) + lam * d.T @ d)


def weight_matrix(
    method: str,
    n: int,
    breakpoints: list[int] | None = None,
    qratio: float = 0.1,
    initvar: float = 100.0,
    sigma: float = 2.0,
    span: float = 0.75,
    halfwindow: int = 2,
    degree: int = 2,
    alpha: float = 0.3,
    lam: float = 1.0,
) -> np.ndarray:
    """The T x T matrix of a method; block diagonal over segments."""
    if not 1 <= n <= MAX_LAYERS:
        raise PanelError(f"a series must have 1..{MAX_LAYERS} layers")
    build = {
        "none": np.eye,
        "ekf": lambda k: local_level(k, qratio, initvar),
        "rts": lambda k: local_level(k, qratio, initvar, smooth=True),
        "gaussian": lambda k: gaussian(k, sigma),
        "loess": lambda k: loess(k, span),
        "savgol": lambda k: savgol(k, halfwindow, degree),
        "moving_average": lambda k: savgol(k, halfwindow, 0),
        "ewma": lambda k: ewma(k, alpha),
        "spline": lambda k: spline(k, lam),
    }
    if method not in build:
        raise PanelError(f"smoothing method {method!r} is not one of {', '.join(METHODS)}")
    out = np.zeros((n, n))
    for a, b in segments(n, None if method in WHOLE_SERIES else breakpoints):
        out[a:b, a:b] = build[method](b - a)
    return out


def apply_matrix(long: DataFrame, matrix: np.ndarray, value: str = "abundance_value", keys: tuple[str, ...] = ("observation", "feature")) -> DataFrame:
    """Every series multiplied by ``matrix``; an incomplete series is an error."""
    n = len(matrix)
    spark = long.sparkSession
    # only each row's band of non-zero weights travels and is multiplied
    rows = []
    for r in matrix:
        use = np.flatnonzero(r)
        lo, hi = (int(use[0]), int(use[-1]) + 1) if len(use) else (0, 0)
        rows.append((lo + 1, [float(v) for v in r[lo:hi]]))
    weights = spark.createDataFrame([(rows,)], "_w array<struct<lo:int,w:array<double>>>")
    series = to_series(long, value, keys).crossJoin(F.broadcast(weights))
    whole = F.when(F.size("xs") == n, F.col("xs")).otherwise(F.raise_error(F.lit(f"a series does not have {n} layers")))
    dot = "transform(_w, r -> aggregate(zip_with(r.w, slice(_x, r.lo, size(r.w)), (a, b) -> a * b), 0D, (s, v) -> s + v))"
    out = series.withColumn("_x", whole).withColumn("xs", F.expr(dot))
    return from_series(out, value, "xs", keys)


def smooth(long: DataFrame, n_layers: int, method: str = "ekf", breakpoints: list[int] | None = None, value: str = "abundance_value", **params) -> DataFrame:
    """Smoothed long rows (observation, feature, time_index, value)."""
    return apply_matrix(long, weight_matrix(method, n_layers, breakpoints, **params), value)


def onset(panel: Panel) -> int | None:
    """1-based index of the first intervention layer, if there is one."""
    flagged = F.min(F.when(F.col("is_intervention_timepoint"), F.col("time_index")))
    return panel.time_meta.agg(flagged).first()[0]


def smooth_panel(panel: Panel, method: str = "ekf", breakpoints: list[int] | None = None, model: str = "gaussian", library_size: DataFrame | None = None, time_scaling: bool = False, **params) -> Panel:
    """The panel smoothed; without breakpoints the onset is the only one.

    ``model="nb"``: counts with negative-binomial noise, by ekf or rts over whole
    series; ``library_size``: (observation, time_index, library_size), by default
    the samples' sums; ``time_scaling``: innovations grow with the sampling
    intervals; ``params``: dispersion, qratio, hierarchical, em_iterations.
    """
    if model == "nb":
        from .smooth_nb import sampling_intervals, smooth_nb

        gaps = sampling_intervals(panel) if time_scaling else None
        return panel.with_values(smooth_nb(panel.long, panel.time_meta.count(), method, library_size, intervals=gaps, **params))
    if model != "gaussian" or library_size is not None or time_scaling:
        raise PanelError("model is gaussian or nb; library_size and time_scaling belong to nb")
    if breakpoints is None:
        t0 = onset(panel)
        breakpoints = [t0] if t0 else []
    return panel.with_values(smooth(panel.long, panel.time_meta.count(), method, breakpoints, **params))
