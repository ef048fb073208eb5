"""Accuracy of estimated effects against known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEVEL = 0.05


def _mean(test: Column, where: Column) -> Column:
    return F.avg(F.when(where, test.cast("double")))


def summarize(estimates: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """Per group: sign hits, power, false positives, bias, errors.

    ``estimates``: dataset, rep, feature, estimate, fdr and optionally
    placebo_fdr, pre_rmse, pre_snr, weight_sum, n_kept (averaged); ``truth``: dataset, rep, feature, effect - each replicate is
    scored against its own effects.  An estimate that is NaN counts as missing:
    in ``n_est`` but in no average.
    """
    estimates = estimates.withColumn("estimate", F.when(~F.isnan("estimate"), F.col("estimate")))
    both = estimates.join(truth.select("dataset", "rep", "feature", "effect"), ["dataset", "rep", "feature"])
    if "placebo_fdr" not in both.columns:
        both = both.withColumn("placebo_fdr", F.lit(None).cast("double"))
    fit = [F.avg(c).alias(c) for c in ("pre_rmse", "pre_snr", "weight_sum", "n_kept") if c in both.columns]
    real, null = F.col("effect") != 0, F.col("effect") == 0
    hit = F.signum("estimate") == F.signum("effect")
    found, placebo = F.col("fdr") < _LEVEL, F.col("placebo_fdr") < _LEVEL
    err = F.col("estimate") - F.col("effect")
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_est"),
        _mean(hit, real).alias("sign_hit"),
        _mean(found, real).alias("power_fdr"),
        _mean(found & hit, real).alias("signed_power_fdr"),
        _mean(placebo, real).alias("power_placebo"),
        _mean(found, null).alias("type1_fdr"),
        _mean(placebo, null).alias("type1_placebo"),
        F.avg(F.when(real, err)).alias("bias"),
        F.avg(F.when(real, F.abs(err))).alias("mae"),
        F.avg(F.when(null, F.abs("estimate"))).alias("recon_null"),
        *fit,
    )


def summarize_bootstrap(intervals: DataFrame, truth: DataFrame, by: tuple[str, ...] = ("dataset", "level")) -> DataFrame:
    """Per group: mean width and coverage of the true effect."""
    both = intervals.join(truth.select("dataset", "rep", "feature", "effect"), ["dataset", "rep", "feature"])
    width = F.col("bootstrap_upper") - F.col("bootstrap_lower")
    inside = F.col("effect").between(F.col("bootstrap_lower"), F.col("bootstrap_upper"))
    return both.groupBy(*by).agg(F.avg(width).alias("mean_width"), F.avg(width / F.lit(2 * 1.959963984540054)).alias("implied_error"), F.avg(inside.cast("double")).alias("coverage"))
