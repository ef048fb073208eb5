"""Placebo tests and bootstrap intervals."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bh_adjust_large
from .causal import Design, unit_means
from .panel import PanelError
from .scm import _arrays, block_count, check, fit_unit, unit_series

#: Bootstrap units per task and feature, while these are at most so many tasks.
UNITS, MAX_BLOCKS = 4096, 512


def placebo(d: Design, effects: DataFrame, constraint: str = "simplex", offset: bool = True) -> DataFrame:
    """(feature, placebo_p_value, placebo_fdr) from synthetic controls.

    Each control unit in turn is the treated one and the others its donors;
    ``p = (1 + #{|placebo| >= |effect|}) / (controls + 1)``, whatever method made
    the effect in other columns: the effect compared is the synthetic-control
    one.  The smallest possible p is 1 / (controls + 1).
    """
    from .scm import synthetic_control

    check(constraint)
    if d.n_control < 2:
        raise PanelError("placebo needs at least two control observations")
    t0 = d.t0
    blocks = block_count(d.n_control, d.n_control)
    pool = unit_series(d).where("not is_treated")
    pool = pool.select("feature", "observation", "xs", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = _arrays(pdf)
        block = int(pdf["block"].iloc[0])
        mine = [i for i, o in enumerate(names) if zlib.crc32(o.encode()) % blocks == block]
        att = [float(fit_unit(np.delete(x, i, axis=0), x[i], t0, constraint, offset)[2][t0 - 1 :].mean()) for i in mine]
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]] * len(mine), "placebo": att})

    fits = pool.groupBy("feature", "block").applyInPandas(run, "feature string, placebo double")
    if effects.where("method <> 'scm'").isEmpty():
        real = effects.select("feature", "estimate")
    else:
        real = synthetic_control(d, constraint, offset, inference=False)[0].select("feature", "estimate")
    hits = F.sum((F.abs("placebo") >= F.abs("estimate")).cast("double"))
    out = fits.join(real, "feature").groupBy("feature").agg(((hits + 1) / (d.n_control + 1)).alias("placebo_p_value"))
    return bh_adjust_large(out, "placebo_p_value", "placebo_fdr")


def draws(rng: np.random.Generator, n: int, samples: int) -> np.ndarray:
    """Weights (samples x n) of resampling n units with replacement."""
    return rng.multinomial(n, np.full(n, 1.0 / n), size=samples).astype(float)


def bootstrap(
    d: Design,
    method: str = "did",
    samples: int = 500,
    level: float = 0.95,
    seed: int = 1,
    constraint: str = "simplex",
    offset: bool = True,
    batch: int = 64,
) -> DataFrame:
    """(feature, bootstrap_lower, bootstrap_upper): percentile interval.

    Treated and control units are resampled with replacement, the same units
    for every feature; the interval holds ``level`` of the draws.  For the
    estimators with closed forms a draw is a weighted mean of per-unit
    contrasts: units are dealt into blocks, a draw is split among the blocks (the
    same split in every task) and then among a block's units, and the blocks' sums
    add up.  Synthetic control is fitted again on the drawn donors.
    """
    if not 0 < level < 1 or samples < 1:
        raise PanelError("level must lie in (0, 1) and samples be positive")
    tail = (1 - level) / 2
    if method == "scm":
        return _bootstrap_scm(d, samples, tail, seed, constraint, offset)
    contrast = F.col("post") - (F.col("base") if method == "event_study" else F.col("pre"))
    blocks = min(MAX_BLOCKS, max(1, -(-max(d.sizes) // UNITS)))
    block = F.pmod(F.xxhash64("observation"), F.lit(blocks)).cast("int").alias("block")
    units = unit_means(d).where("is_treated or is_control").select("feature", "observation", "is_treated", contrast.alias("x"), block)
    found = d.flags.where("is_treated or is_control").groupBy("is_treated", block).count().collect()  # at most two a block
    sizes = {flag: np.zeros(blocks) for flag in (True, False)}
    for r in found:
        sizes[r.is_treated][r.block] = r["count"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of the drawn units' contrasts, of one block of units, for every draw."""
        pdf = pdf.sort_values("observation", kind="stable")
        which, mask = int(pdf["block"].iloc[0]), pdf["is_treated"].to_numpy(bool)
        sums = {}
        for flag in (True, False):
            x, total = pdf["x"].to_numpy(float)[mask == flag], sizes[flag].sum()
            share = np.random.default_rng([seed, int(flag)]).multinomial(int(total), sizes[flag] / total, size=samples)[:, which]
            rng = np.random.default_rng([seed, int(flag), 1 + which])
            parts = [rng.multinomial(share[at : at + batch], np.full(len(x), 1.0 / len(x))) @ x for at in range(0, samples, batch)] if len(x) else [np.zeros(samples)]
            sums[flag] = np.concatenate(parts) / total
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "draws": [sums[True] - sums[False]]})

    drawn = units.groupBy("feature", "block").applyInPandas(run, "feature string, draws array<double>")
    each = drawn.select("feature", F.posexplode("draws").alias("k", "x")).groupBy("feature", "k").agg(F.sum("x").alias("draw"))
    lower, upper = (F.percentile("draw", F.lit(q)) for q in (tail, 1 - tail))
    return each.groupBy("feature").agg(lower.alias("bootstrap_lower"), upper.alias("bootstrap_upper"))


def _bootstrap_scm(d: Design, samples: int, tail: float, seed: int, constraint: str, offset: bool) -> DataFrame:
    """Draws are spread over tasks: one group per (feature, block of draws)."""
    check(constraint)
    t0, block = d.t0, 25
    blocks = -(-samples // block)
    series = unit_series(d).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        which = int(pdf["block"].iloc[0])
        treated, control = (_arrays(pdf[pdf["is_treated"] == flag])[1] for flag in (True, False))
        rng, out = np.random.default_rng([seed, which]), []
        for _ in range(min(block, samples - which * block)):
            units = draws(rng, len(treated), 1)[0]
            pool = control[draws(rng, len(control), 1)[0] > 0]  # repeated donors add nothing
            gaps = [u * fit_unit(pool, x, t0, constraint, offset)[2][t0 - 1 :].mean() for u, x in zip(units, treated, strict=True) if u]
            out.append(float(np.sum(gaps) / len(treated)))
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]] * len(out), "draw": out})

    fits = series.groupBy("feature", "block").applyInPandas(run, "feature string, draw double")
    lower, upper = (F.percentile("draw", F.lit(q)) for q in (tail, 1 - tail))
    return fits.groupBy("feature").agg(lower.alias("bootstrap_lower"), upper.alias("bootstrap_upper"))
