"""Synthetic control: one small quadratic program per treated unit and feature.

Donor weights come from the layers before the onset, by non-negative least
squares or on the simplex (weights sum to 1), optionally after removing each
unit's own pre-onset mean.  A feature's series travel as arrays; treated units
are dealt into blocks, each with the feature's donor matrix, so many treated
units spread over tasks.  A task holds one donor matrix (donors x layers).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .causal import Design, finish_effects, group_means, series, unit_means, with_statistic
from .panel import PanelError

CONSTRAINTS = ("nnls", "simplex")
SNR_EPS = 1e-10
#: Values beyond this are scaled before a fit, as their products would overflow.
HUGE = 1e100
#: Least number of units that a task fits for a feature.
BLOCK = 64


def block_count(units: int, donors: int) -> int:
    """Blocks that a feature's fits are dealt into; each gets a copy of the donors.

    A block has at least a sixteenth as many units as there are donors, so the
    copies add up to at most sixteen times the units' own rows.
    """
    return max(1, -(-units // max(BLOCK, -(-donors // 16))))


# --------------------------------------------------------------------------- #
# solvers
# --------------------------------------------------------------------------- #
def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """min ||a w - b|| over w >= 0, by the active-set method.

    Inner problems are solved by least squares of minimum norm, so dependent
    columns are no problem; the passive set grows by the steepest multiplier.
    """
    n = a.shape[1]
    w, passive = np.zeros(n), np.zeros(n, bool)
    scale = tol * max(1.0, float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)))
    for _ in range(3 * n + 30):
        slope = a.T @ (b - a @ w)
        slope[passive] = -np.inf
        j = int(slope.argmax()) if n else 0
        if not n or slope[j] <= scale:
            break
        passive[j] = True
        while True:
            s = np.zeros(n)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if (s[passive] > 0).all():
                w = s
                break
            low = passive & (s <= 0)
            step = float((w[low] / (w[low] - s[low])).min()) if (w[low] > s[low]).all() else 0.0
            w = w + step * (s - w)
            passive &= w > 1e-14
            w[~passive] = 0.0
            if not passive.any():
                break
    return w


def simplex(a: np.ndarray, b: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """min ||a w - b|| over w >= 0, sum w = 1.

    That is the point of least norm in the convex hull of the shifted columns,
    found by Wolfe's finite algorithm: an affinely independent set of columns
    grows by the most violating one and shrinks when a weight leaves.
    Identical columns share equal weight.
    """
    n = a.shape[1]
    if n == 0:
        raise PanelError("there are no donors")
    points = a - b[:, None]
    if np.ptp(points, axis=1).max(initial=0.0) == 0.0:
        return np.full(n, 1.0 / n)
    size = float((points * points).sum(axis=0).max())
    use = [int((points * points).sum(axis=0).argmin())]
    w = np.array([1.0])
    for _ in range(50 * (n + 10)):
        x = points[:, use] @ w
        gains = points.T @ x
        j = int(gains.argmin())
        if gains[j] >= x @ x - tol * max(size, 1e-300) or j in use:
            break
        use.append(j)
        w = np.append(w, 0.0)
        while True:
            q = points[:, use]
            k = len(use)
            system = np.zeros((k + 1, k + 1))
            system[:k, :k], system[:k, k], system[k, :k] = q.T @ q, 1.0, 1.0
            v = np.linalg.lstsq(system, np.append(np.zeros(k), 1.0), rcond=None)[0][:k]
            if (v > 1e-14).all():
                w = v / v.sum()
                break
            low = v <= 1e-14
            drop = w[low] - v[low]
            step = float(np.min(np.where(drop > 0, w[low] / np.where(drop > 0, drop, 1.0), 1.0)))
            w = w + min(1.0, step) * (v - w)
            stay = w > 1e-14
            if stay.all():
                stay[np.flatnonzero(low)[0]] = False
            use, w = [u for u, s in zip(use, stay.tolist(), strict=True) if s], w[stay]
            w = w / w.sum()
    out = np.zeros(n)
    out[use] = w
    return out


def kkt_residual(a: np.ndarray, b: np.ndarray, w: np.ndarray, constraint: str) -> float:
    """How far ``w`` is from optimal, relative to the size of the gradient."""
    slope = a.T @ (a @ w - b)
    size = max(1.0, float(np.abs(a).max()) ** 2 * a.shape[0])
    worst = max(0.0, -float(w.min()))
    if constraint == "simplex":
        worst = max(worst, abs(float(w.sum()) - 1.0))
        slope = slope - slope @ w
    return max(worst, max(0.0, -float(slope.min())) / size, float(np.abs(slope * w).max()) / size)


def fit_unit(donors: np.ndarray, unit: np.ndarray, t0: int, constraint: str, offset: bool) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, offset, gaps of all layers); donors x layers, layers.

    Where a value before the onset is not finite there is no fit: all are NaN.
    """
    pre_d, pre_u = donors[:, : t0 - 1], unit[: t0 - 1]
    if not (np.isfinite(pre_d).all() and np.isfinite(pre_u).all()):
        return np.full(len(donors), np.nan), np.nan, np.full(len(unit), np.nan)
    peak = max(float(np.abs(pre_d).max(initial=0.0)), float(np.abs(pre_u).max(initial=0.0)))
    if peak > HUGE:  # the weights are those of the values scaled down; a power of two keeps digits
        scale = 2.0 ** -np.frexp(peak)[1]
        w, mu, _ = fit_unit(donors[:, : t0 - 1] * scale, pre_u * scale, t0, constraint, offset)
        with np.errstate(over="ignore", invalid="ignore"):
            return w, mu / scale, unit - w @ donors - mu / scale
    if offset:
        mean_d, mean_u = pre_d.mean(axis=1), float(pre_u.mean())
        pre_d, pre_u = pre_d - mean_d[:, None], pre_u - mean_u
    w = (simplex if constraint == "simplex" else nnls)(pre_d.T, pre_u)
    mu = mean_u - float(mean_d @ w) if offset else 0.0
    return w, mu, unit - w @ donors - mu


def check(constraint: str) -> None:
    if constraint not in CONSTRAINTS:
        raise PanelError(f"scm_constraint {constraint!r} is not one of {', '.join(CONSTRAINTS)}")


# --------------------------------------------------------------------------- #
# on the cluster
# --------------------------------------------------------------------------- #
def unit_series(d: Design) -> DataFrame:
    """One row per (feature, unit) of the two groups: flag and values in time order."""
    return series(d).where("is_treated or is_control").select("feature", "observation", "is_treated", "xs")


def _arrays(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    pdf = pdf.sort_values("observation", kind="stable")
    return list(pdf["observation"]), np.stack(pdf["xs"].to_numpy()).astype(float)


def fit_units(d: Design, constraint: str = "simplex", offset: bool = True) -> DataFrame:
    """Per (feature, treated unit): donors, weights, offset, gaps of all layers."""
    check(constraint)
    t0 = d.t0
    units = unit_series(d)
    blocks = block_count(d.n_treated, d.n_control)
    block = F.pmod(F.xxhash64("observation"), F.lit(blocks))
    treated = units.where("is_treated").select("feature", "observation", "xs", block.alias("block"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))
    donors = units.where("not is_treated").select("feature", "observation", "xs", F.explode(every).alias("block"))

    def run(units: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        if not len(units):
            return pd.DataFrame(columns=["feature", "treated_unit", "donors", "weights", "mu", "gaps"], dtype=object)
        names, x = _arrays(pool)
        units = units.sort_values("observation", kind="stable")
        fits = [fit_unit(x, np.asarray(u, float), t0, constraint, offset) for u in units["xs"]]
        return pd.DataFrame(
            {"feature": units["feature"].to_numpy(), "treated_unit": units["observation"].to_numpy(), "donors": [names] * len(fits), "weights": [f[0] for f in fits], "mu": [f[1] for f in fits], "gaps": [f[2] for f in fits]}
        )

    schema = "feature string, treated_unit string, donors array<string>, weights array<double>, mu double, gaps array<double>"
    names = ("feature", "observation", "xs", "block")  # toDF: both sides come from the same rows
    return treated.toDF(*names).groupBy("feature", "block").cogroup(donors.toDF(*names).groupBy("feature", "block")).applyInPandas(run, schema)


def synthetic_control(d: Design, constraint: str = "simplex", offset: bool = True, inference: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(effects, per-layer path, weights, weight sums)."""
    fits = fit_units(d, constraint, offset)
    # per feature and layer the units' mean gap, and as layer 0 that of their gaps' means:
    # one pass over the fits gives the effect and its path
    after = F.slice("gaps", d.t0, d.n_layers)
    each = fits.select("feature", F.posexplode(F.concat(F.array(F.aggregate(after, F.lit(0.0), lambda a, g: a + g) / F.size(after)), after)).alias("k", "gap"))
    means = each.groupBy("feature", "k").agg(F.avg("gap").alias("estimate"), F.sqrt(F.var_samp("gap") / F.count(F.lit(1))).alias("standard_error"))
    path = means.where("k > 0").select(
        "feature",
        (F.col("k") + F.lit(d.t0 - 1)).alias("time_index"),
        (F.col("k") - 1).alias("relative_time"),
        F.lit("scm").alias("method"),
        "estimate",
        "standard_error",
    )
    path = with_statistic(path, inference)
    zero = F.col("k") == 0
    head = means.groupBy("feature").agg(
        F.max(F.when(zero, F.col("estimate"))).alias("estimate"),
        F.max(F.when(zero, F.col("standard_error"))).alias("standard_error"),
        (F.max(F.when(~zero, F.col("estimate"))) - F.min(F.when(~zero, F.col("estimate")))).alias("effect_range"),
    )
    effects = finish_effects(group_means(unit_means(d)).join(head, "feature"), "scm", inference)
    pairs = fits.select("feature", "treated_unit", F.explode(F.arrays_zip("donors", "weights")).alias("p"))
    weights = pairs.select("feature", "treated_unit", F.col("p.donors").alias("donor_unit"), F.col("p.weights").alias("weight"))
    sums = fits.select("feature", "treated_unit", F.expr("aggregate(weights, 0D, (a, b) -> a + b)").alias("weight_sum"))
    return effects, path, weights, sums


def pre_fit(d: Design, weights: DataFrame, offset: bool = True) -> DataFrame:
    """Per (feature, treated unit): RMSE and signal-to-noise before the onset."""
    pre = d.rows.where(F.col("time_index") < d.t0).select("feature", "observation", "time_index", "value")
    donor = pre.select("feature", F.col("observation").alias("donor_unit"), "time_index", F.col("value").alias("x"))
    used = weights.where("weight <> 0")
    made = used.join(donor, ["feature", "donor_unit"]).groupBy("feature", "treated_unit", "time_index").agg(F.sum(F.col("weight") * F.col("x")).alias("made"))
    unit = d.rows.where(F.col("is_treated") & (F.col("time_index") < d.t0)).select("feature", F.col("observation").alias("treated_unit"), "time_index", F.col("value").alias("x"))
    both = unit.join(made, ["feature", "treated_unit", "time_index"], "left").withColumn("gap", F.col("x") - F.coalesce("made", F.lit(0.0)))
    if offset:
        mu = both.groupBy("feature", "treated_unit").agg(F.avg("gap").alias("mu"))
        both = both.join(mu, ["feature", "treated_unit"]).withColumn("gap", F.col("gap") - F.col("mu"))
    rmse = F.sqrt(F.avg(F.col("gap") * F.col("gap")))
    return both.groupBy("feature", "treated_unit").agg(rmse.alias("pre_rmse"), (F.avg(F.abs("gap")) / (rmse + F.lit(SNR_EPS))).alias("pre_snr"))
