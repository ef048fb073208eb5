"""Negative-binomial Kalman smoothing of count series, with optional EM.

Latent log relative abundance follows a random walk; counts have mean
``library * exp(z)`` and negative-binomial variance.  With fixed parameters each
series is on its own: one Arrow pass, numpy over a batch of series.  The
hierarchical variant shares the innovation variance and dispersion inside a
feature and alternates smoothing and moment updates.  A feature of at most
``TASK_CELLS`` cells is fitted by one task; for larger ones every round is one pass
over the series where they lie, and the driver sums up their moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import remove_table, write_table
from .panel import Panel, PanelError, from_series

FLOOR = -16.0
MIN_DISPERSION, MAX_DISPERSION = 1e-4, 1e3
MIN_INNOVATION = 1e-6
EM_TOLERANCE = 1e-6
EM_ITERATIONS = 80
#: Cells (series x layers) of a feature that one task fits by itself.
TASK_CELLS = 1 << 22


def run_filter(x: np.ndarray, lib: np.ndarray, first: np.ndarray, q, phi, dt: np.ndarray, smooth: bool, ceiling: bool = False) -> np.ndarray:
    """Latent states of series in rows; ``q`` and ``phi`` scalar or per row.

    States have a floor and no ceiling: a linearized step from a tiny mean may
    overshoot, up to infinite or undefined states, as the recursion defines it.
    With ``ceiling`` they stay at most at a share of 1, or at the series' largest
    observed one if libraries are given smaller than that.
    """
    n, t = x.shape
    top = np.maximum(0.0, start_states(x, lib).max(axis=1)) if ceiling else np.inf
    z, p, ahead = np.empty((n, t)), np.empty((n, t)), np.empty((n, t))
    z[:, 0], p[:, 0], ahead[:, 0] = first, np.maximum(q, MIN_INNOVATION), 0.0
    phi = np.maximum(phi, MIN_DISPERSION)
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(1, t):
            pred = p[:, k - 1] + q * dt[k]
            mean = lib[:, k] * np.exp(np.maximum(z[:, k - 1], FLOOR))
            spread = mean * mean * pred + mean + mean * mean / phi
            gain = pred * mean / np.maximum(spread, 1e-300)
            z[:, k] = np.minimum(z[:, k - 1] + gain * (x[:, k] - mean), top)
            p[:, k] = (1.0 - gain * mean) * pred
            ahead[:, k] = pred
    if not smooth:
        return z
    out = z.copy()
    for k in range(t - 2, -1, -1):
        back = p[:, k] / np.maximum(ahead[:, k + 1], 1e-30)
        out[:, k] = np.minimum(z[:, k] + back * (out[:, k + 1] - z[:, k]), top)
    return out


def start_states(x: np.ndarray, lib: np.ndarray) -> np.ndarray:
    return np.log((x + 0.5) / lib)


def moments(x: np.ndarray, lib: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Per series what the parameters are updated by: squared steps, and the two sums of the dispersion."""
    mean = lib * np.exp(states)
    excess = (x - mean) ** 2 - mean
    use = (mean > 0) & (excess > 0)
    share = np.divide(mean**3, excess, out=np.zeros_like(mean), where=use)
    return np.stack([(np.diff(states, axis=1) ** 2).sum(axis=1), share.sum(axis=1), np.where(use, mean * mean, 0.0).sum(axis=1)])


def update(q: float, phi: float, sums: np.ndarray, steps: int) -> tuple[float, float, float]:
    """(new q, new phi, larger relative change) from a feature's moments over ``steps`` steps."""
    new_q = max(float(sums[0]) / steps if steps else 0.0, MIN_INNOVATION)
    new_phi = float(np.clip(sums[1] / sums[2], MIN_DISPERSION, MAX_DISPERSION)) if sums[2] != 0 else phi
    return new_q, new_phi, max(abs(new_q - q) / max(q, 1e-30), abs(new_phi - phi) / max(phi, 1e-30))


def fit_feature(x: np.ndarray, lib: np.ndarray, q: float, phi: float, dt: np.ndarray, iterations: int = EM_ITERATIONS, ceiling: bool = False) -> tuple[np.ndarray, float, float, int]:
    """(states, q, phi, rounds) of one feature's series by EM."""
    states, rounds = start_states(x, lib), 0
    for rounds in range(1, iterations + 1):
        states = np.maximum(run_filter(x, lib, states[:, 0], q, phi, dt, True, ceiling), FLOOR)
        q, phi, change = update(q, phi, moments(x, lib, states).sum(axis=1), states[:, 1:].size)
        if change < EM_TOLERANCE:
            break
    return states, q, phi, rounds


def sampling_intervals(panel: Panel) -> list[float]:
    """Time since the previous layer, 1 for the first and where it is 0."""
    gaps = [r.delta_t for r in panel.time_meta.orderBy("time_index").collect()]
    return [g if g > 0 else 1.0 for g in gaps]


def _with_library(long: DataFrame, value: str, library: DataFrame | None) -> DataFrame:
    """Series arrays ``xs`` (counts) and ``ls`` (library sizes) in time order."""
    if library is None:
        library = long.groupBy("observation", "time_index").agg(F.sum(value).alias("library_size"))
    rows = long.join(library.select("observation", "time_index", "library_size"), ["observation", "time_index"])
    packed = F.array_sort(F.collect_list(F.struct("time_index", F.col(value).cast("double").alias("x"), F.col("library_size").cast("double").alias("l"))))
    return rows.groupBy("observation", "feature").agg(packed.alias("s")).selectExpr("observation", "feature", "transform(s, e -> e.x) xs", "transform(s, e -> e.l) ls")


def smooth_nb(
    long: DataFrame,
    n_layers: int,
    method: str = "rts",
    library: DataFrame | None = None,
    dispersion: float = 1.0,
    qratio: float = 0.1,
    hierarchical: bool = False,
    em_iterations: int = EM_ITERATIONS,
    intervals: list[float] | None = None,
    ceiling: bool = False,
    value: str = "abundance_value",
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """Smoothed means, same rows as ``long``.

    ``library``: (observation, time_index, library_size), by default the
    samples' sums; ``intervals``: time since the previous layer, used to scale
    the innovation variance (default: 1 everywhere); ``ceiling``: see
    :func:`run_filter`.
    """
    if method not in ("ekf", "rts"):
        raise PanelError("counts are smoothed by ekf or rts")
    if intervals is not None and len(intervals) != n_layers:
        raise PanelError(f"intervals must have {n_layers} entries")
    dt = np.ones(n_layers) if intervals is None else np.asarray(intervals, float)
    smooth = method == "rts"
    series = _with_library(long, value, library)

    def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if (pdf["xs"].map(len) != n_layers).any():
            raise PanelError(f"a series does not have {n_layers} layers")
        lib = np.stack(pdf["ls"].to_numpy()).astype(float)
        if (lib <= 0).any():
            raise PanelError("library sizes must be positive")
        return np.stack(pdf["xs"].to_numpy()).astype(float), lib

    def finish(pdf: pd.DataFrame, lib: np.ndarray, states: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"observation": pdf["observation"], "feature": pdf["feature"], "xs": list(lib * np.exp(np.maximum(states, FLOOR)))})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, lib = arrays(pdf)
                yield finish(pdf, lib, run_filter(x, lib, start_states(x, lib)[:, 0], qratio, dispersion, dt, smooth, ceiling))

    def feature(pdf: pd.DataFrame) -> pd.DataFrame:
        x, lib = arrays(pdf)
        states, q, phi, _ = fit_feature(x, lib, qratio, dispersion, dt, em_iterations, ceiling)
        return finish(pdf, lib, run_filter(x, lib, states[:, 0], q, phi, dt, smooth, ceiling))

    def rounds(large: DataFrame, sizes: dict[str, int]) -> DataFrame:
        """EM of features too large for a task: a table of series and first states a round."""
        spark, values = large.sparkSession, {f: (qratio, dispersion) for f in sizes}
        columns = "observation string, feature string, xs array<double>, ls array<double>, z double, step double, top double, base double"
        names = [c.split()[0] for c in columns.split(", ")]
        now, path = write_table(large.selectExpr("observation", "feature", "xs", "ls", "cast(null as double) z", "0D step", "0D top", "0D base"), "nb-series")
        open_ = set(sizes)

        def first_of(pdf: pd.DataFrame, x: np.ndarray, lib: np.ndarray) -> np.ndarray:
            z = pdf["z"].to_numpy(float)
            return np.where(np.isnan(z), start_states(x, lib)[:, 0], z)

        def parameters(pdf: pd.DataFrame, values: dict) -> np.ndarray:
            return np.array([values[f] for f in pdf["feature"]]).T

        for _ in range(em_iterations):

            def one(batches: Iterator[pd.DataFrame], values=dict(values), running=frozenset(open_)) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    on = pdf["feature"].isin(running).to_numpy()
                    if on.any():
                        part = pdf[on]
                        x, lib = arrays(part)
                        q, phi = parameters(part, values)
                        states = np.maximum(run_filter(x, lib, first_of(part, x, lib), q, phi, dt, True, ceiling), FLOOR)
                        pdf.loc[on, ["z", "step", "top", "base"]] = np.vstack([states[:, :1].T, moments(x, lib, states)]).T
                    yield pdf[names]

            before = path
            now, path = write_table(now.mapInPandas(one, columns), "nb-series")
            remove_table(spark, before)
            for r in now.where(F.col("feature").isin(sorted(open_))).groupBy("feature").agg(*(F.sum(c).alias(c) for c in names[-3:])).collect():
                q, phi, change = update(*values[r.feature], np.array([r.step, r.top, r.base]), sizes[r.feature] * (n_layers - 1))
                values[r.feature] = q, phi
                if change < EM_TOLERANCE:
                    open_.discard(r.feature)
            if not open_:
                break

        def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x, lib = arrays(pdf)
                    yield finish(pdf, lib, run_filter(x, lib, first_of(pdf, x, lib), *parameters(pdf, values), dt, smooth, ceiling))

        return now.mapInPandas(last, schema)

    schema = "observation string, feature string, xs array<double>"
    if not hierarchical:
        return from_series(series.mapInPandas(each, schema), value)
    found = long.groupBy("feature").count().where(F.col("count") > task_cells).collect()  # at most cells / task_cells rows
    sizes = {r.feature: r["count"] // n_layers for r in found}
    large = F.col("feature").isin(sorted(sizes))
    small = series.where(~large) if sizes else series
    out = small.groupBy("feature").applyInPandas(feature, schema)
    return from_series(out.unionAll(rounds(series.where(large), sizes)) if sizes else out, value)
