"""Experiment grids: ablation variants and sensitivity settings over scenarios.

All replicates of a scenario run in one plan: their names become part of the
observation and feature keys, so every operator treats them as separate panels
without a loop over jobs.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import causal, inference, preprocess, scm, simulate, smooth, smooth_nb
from .panel import PanelError

_FILTER = {"min_prevalence": 0.1}


@dataclasses.dataclass(frozen=True)
class Config:
    """What happens between a panel and its effects."""

    filter: dict | None = dataclasses.field(default_factory=lambda: dict(_FILTER))
    zero: str | None = "half_min"
    normalize: str = "clr"
    smooth: dict | None = None
    counts: bool = False  # negative-binomial smoothing of counts, not of shares
    constraint: str = "simplex"
    offset: bool = True
    samples: int = 500
    level: float = 0.95


_C = Config
# The ablation variants and sensitivity grids.
ABLATIONS = {
    "base": _C(),
    "ab_nnls": _C(constraint="nnls"),
    "ab_no_offset": _C(offset=False),
    "ab_smooth_spline": _C(smooth={"method": "spline", "lam": 1.0}),
    "ab_smooth_ewma": _C(smooth={"method": "ewma", "alpha": 0.3}),
    "ab_kalman_gauss": _C(smooth={"method": "rts", "qratio": 0.1}),
    "ab_no_filter": _C(filter=None),
    "ab_rclr_nofill": _C(zero=None, normalize="rclr"),
    "ab_no_normalize": _C(zero=None, normalize="none"),
    "ab_nb_hier": _C(zero=None, normalize="none", counts=True, smooth={"method": "rts", "hierarchical": True, "em_iterations": 80}),
    "ab_nb_nohier": _C(zero=None, normalize="none", counts=True, smooth={"method": "rts", "hierarchical": False}),
}
SENSITIVITY = {
    "filter": {f"prev_{p:g}": _C(filter={"min_prevalence": p}) for p in (0.05, 0.1, 0.2)},
    "normalize": {f"norm_{m}": _C(zero=None if m == "rclr" else "half_min", normalize=m) for m in ("clr", "ilr", "rclr", "z_score", "min_max", "css", "rle", "tss", "log1p")},
    "zero": {f"zero_{m}": _C(zero=m) for m in ("constant", "half_min", "sqrt_min", "multiplicative", "bayesian")} | {"zero_none_rclr": _C(zero=None, normalize="rclr")},
    "band": {f"spline_l{v:.1f}": _C(smooth={"method": "spline", "lam": v}) for v in (0.5, 1.0, 2.0)} | {f"ewma_a{v:.1f}": _C(smooth={"method": "ewma", "alpha": v}) for v in (0.2, 0.3, 0.5)},
    "bootstrap": {f"boot_s{n}_l{v:.2f}": _C(samples=n, level=v) for n, v in ((200, 0.95), (500, 0.9), (500, 0.95), (500, 0.99), (1000, 0.95))},
}


def _keyed(long: DataFrame, value: str) -> DataFrame:
    def key(c: str):
        return F.concat_ws("|", "dataset", F.col("rep").cast("string"), c)

    return long.select(key("observation").alias("observation"), key("feature").alias("feature"), "time_index", F.col(value).alias("abundance_value"), "is_treated")


def design_of(long: DataFrame, scenario: simulate.Scenario, config: Config) -> causal.Design:
    """All replicates of one scenario, processed as ``config`` says."""
    n_layers = len(scenario.times)
    rows = _keyed(long, "raw" if config.counts else "relab")
    flags = rows.select("observation", "is_treated").distinct().withColumn("is_control", ~F.col("is_treated"))
    cells = preprocess.filter_features(rows.drop("is_treated"), **(config.filter or {}))
    if config.zero:
        cells = preprocess.zero_fill(cells, config.zero)
    cells = preprocess.normalize(cells, config.normalize)
    if config.smooth:
        spec = dict(config.smooth)
        if config.counts:
            gaps = [1.0, *(b - a for a, b in zip(scenario.times, scenario.times[1:], strict=False))]
            cells = smooth_nb.smooth_nb(cells, n_layers, spec.pop("method"), intervals=gaps, **spec)
        else:
            cells = smooth.smooth(cells, n_layers, breakpoints=[scenario.t0], **spec)
    rows = cells.withColumnRenamed("abundance_value", "value").join(flags, "observation")
    d = causal.Design(rows, scenario.t0, n_layers, flags)
    d.__dict__["sizes"] = (scenario.n_treated, scenario.n - scenario.n_treated)  # of one replicate
    return d


def _unkeyed(df: DataFrame) -> DataFrame:
    parts = F.split("feature", "[|]")
    return df.withColumn("dataset", parts[0]).withColumn("rep", parts[1].cast("int")).withColumn("feature", parts[2])


def run(
    spark: SparkSession,
    configs: dict[str, Config],
    names: list[str],
    replicates: int = 30,
    method: str = "scm",
    bootstrap: bool = False,
    seed: int = 20260918,
    scenarios: dict[str, simulate.Scenario] | None = None,
) -> DataFrame:
    """Effects per (config, dataset, rep, feature); p-values adjusted per replicate.

    With ``bootstrap`` the interval's bounds are added.
    """
    known = simulate.SCENARIOS if scenarios is None else scenarios
    estimators = {"did": causal.did, "pooled_ols": causal.pooled_ols, "event_study": causal.event_study}
    if method != "scm" and method not in estimators:
        raise PanelError(f"method {method!r} is not known")
    parts = []
    for name in names:
        long = simulate.generate(spark, [name], replicates, seed, known)
        for label, config in configs.items():
            d = design_of(long, known[name], config)
            if method == "scm":
                effects = scm.synthetic_control(d, config.constraint, config.offset, inference=False)[0]
            else:
                effects = estimators[method](d, inference=False)[0]
            if bootstrap:
                effects = effects.join(inference.bootstrap(d, method, config.samples, config.level, seed, config.constraint, config.offset), "feature")
            parts.append(_unkeyed(effects).withColumn("config", F.lit(label)))
    every = reduce(DataFrame.unionByName, parts)
    return causal.bh_adjust(every.withColumn("p_value", causal.normal_p_value(F.col("statistic"))), by=("config", "dataset", "rep"))
