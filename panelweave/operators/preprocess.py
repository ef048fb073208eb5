"""Feature filter, zero replacement and normalization as window expressions.

Every method is a column expression over the sample window ``(observation,
time_index)``; chained steps share that partitioning, so filter, zero-fill and
normalize cost one shuffle of the panel plus per-feature aggregates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import Panel, PanelError

SAMPLE = ("observation", "time_index")
VALUE = "abundance_value"
ZERO_METHODS = ("none", "constant", "half_min", "sqrt_min", "multiplicative", "bayesian")
NORMALIZE_METHODS = ("none", "clr", "tss", "log1p", "css", "rle", "ilr", "rclr", "z_score", "min_max")
#: Methods that take logarithms and so get zeros replaced first.
NEEDS_POSITIVE = ("clr", "rle", "ilr")


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


# --------------------------------------------------------------------------- #
# filter
# --------------------------------------------------------------------------- #
def feature_stats(long: DataFrame, min_abundance: float = 0.0, value: str = VALUE) -> DataFrame:
    """Per feature: prevalence, mean, total, maximum, zero share."""
    x = F.col(value)
    return long.groupBy("feature").agg(
        F.avg((x > F.lit(float(min_abundance))).cast("double")).alias("prevalence"),
        F.avg(x).alias("mean"),
        F.sum(x).alias("total"),
        F.max(x).alias("maximum"),
        (F.lit(1.0) - F.avg((x > 0).cast("double"))).alias("zero_share"),
    )


def filter_features(
    long: DataFrame,
    min_prevalence: float | None = None,
    min_abundance: float = 0.0,
    min_mean_abundance: float | None = None,
    min_total_abundance: float | None = None,
    min_max_abundance: float | None = None,
    max_zero_proportion: float | None = None,
    value: str = VALUE,
) -> DataFrame:
    """Rows of the features that meet every bound given.

    ``min_prevalence`` is the bound itself: the share of samples in which the
    feature exceeds ``min_abundance``.
    """
    bounds = {"prevalence": min_prevalence, "mean": min_mean_abundance, "total": min_total_abundance, "maximum": min_max_abundance}
    tests = [F.col(c) >= F.lit(float(b)) for c, b in bounds.items() if b is not None]
    if max_zero_proportion is not None:
        tests.append(F.col("zero_share") <= F.lit(float(max_zero_proportion)))
    if not tests:
        return long
    kept = feature_stats(long, min_abundance, value)
    for t in tests:
        kept = kept.where(t)
    return long.join(kept.select("feature"), "feature", "left_semi")


# --------------------------------------------------------------------------- #
# zeros
# --------------------------------------------------------------------------- #
def _zero_none(x, w, **_):
    return x


def _zero_constant(x, w, constant=0.5, **_):
    return F.when(x == 0, F.lit(float(constant))).otherwise(x)


def _zero_half_min(x, w, fraction=0.5, **_):
    return F.when(x == 0, F.coalesce(F.lit(float(fraction)) * F.min(_positive(x)).over(w), x)).otherwise(x)


def _zero_sqrt_min(x, w, fraction=0.5, **_):
    return F.when(x == 0, F.coalesce(F.lit(float(fraction)) * F.sqrt(F.min(_positive(x)).over(w)), x)).otherwise(x)


def _zero_multiplicative(x, w, delta=1e-4, **_):
    zeros = F.sum((x == 0).cast("double")).over(w)
    total = F.sum(_positive(x)).over(w)
    rest = x * (F.lit(1.0) - zeros * F.lit(float(delta))) / total
    return F.when(zeros == 0, x).when(x == 0, F.lit(float(delta))).when(x > 0, rest).otherwise(x)


def _zero_bayesian(x, w, **_):
    zeros = F.sum((x == 0).cast("double")).over(w)
    total = F.sum(x).over(w)
    n_pos = F.count(_positive(x)).over(w)
    share = F.exp(F.avg(F.ln(_positive(x))).over(w) - F.ln(_positive(total)))
    fill = total * (F.lit(1.0) - share) / F.when(zeros > 0, zeros)
    return F.when((zeros == 0) | (n_pos == 0), x).when(x == 0, fill).when(x > 0, x * share).otherwise(x)


ZERO_FILL: dict[str, Callable[..., Column]] = {
    "none": _zero_none,
    "constant": _zero_constant,
    "half_min": _zero_half_min,
    "sqrt_min": _zero_sqrt_min,
    "multiplicative": _zero_multiplicative,
    "bayesian": _zero_bayesian,
}


def zero_fill(long: DataFrame, method: str = "half_min", value: str = VALUE, keys: tuple[str, ...] = SAMPLE, **params) -> DataFrame:
    """Exact zeros of each sample replaced; samples without zeros unchanged.

    ``multiplicative`` assumes samples that sum to 1; ``bayesian`` keeps the
    sample's sum.  An all-zero sample keeps its zeros, except under
    ``constant`` and ``multiplicative``.
    """
    if method not in ZERO_FILL:
        raise PanelError(f"zero-fill method {method!r} is not one of {', '.join(ZERO_METHODS)}")
    params = {k: v for k, v in params.items() if v is not None}
    return long.withColumn(value, ZERO_FILL[method](F.col(value), Window.partitionBy(*keys), **params))


# --------------------------------------------------------------------------- #
# normalization
# --------------------------------------------------------------------------- #
def _clr(x, w):
    log = F.ln(x)
    return log - F.avg(log).over(w)


def _tss(x, w):
    total = F.sum(x).over(w)
    return x / F.when(total == 0, F.lit(1.0)).otherwise(total)


def _rclr(x, w):
    log = F.ln(_positive(x))
    return F.when(F.count(log).over(w) == 0, x).otherwise(F.coalesce(log - F.avg(log).over(w), F.lit(0.0)))


def _z_score(x, w):
    sd = F.stddev_samp(x).over(w)
    return (x - F.avg(x).over(w)) / F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def _min_max(x, w):
    low = F.min(x).over(w)
    span = F.max(x).over(w) - low
    return (x - low) / F.when(span == 0, F.lit(1.0)).otherwise(span)


SIMPLE: dict[str, Callable[[Column, object], Column]] = {
    "none": lambda x, w: x,
    "clr": _clr,
    "tss": _tss,
    "log1p": lambda x, w: F.log1p(x),
    "rclr": _rclr,
    "z_score": _z_score,
    "min_max": _min_max,
}


def _css(long: DataFrame, value: str, keys: tuple[str, ...], quantile: float) -> DataFrame:
    """Divided by the sum of the smallest share of the sample's positive values."""
    x, w = F.col(value), Window.partitionBy(*keys)
    pos = _positive(x)
    ranked = long.withColumn("_r", F.row_number().over(w.orderBy(pos.asc_nulls_last(), "feature"))).withColumn("_n", F.count(pos).over(w))
    take = F.greatest(F.lit(1), F.floor(F.lit(float(quantile)) * F.col("_n")))
    scale = F.sum(F.when((x > 0) & (F.col("_r") <= take), x)).over(w)
    return ranked.withColumn("_s", F.coalesce(scale, F.lit(0.0))).withColumn(value, x / F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))).drop("_r", "_n", "_s")


def _rle(long: DataFrame, value: str, keys: tuple[str, ...], reference: DataFrame | None, mode: str) -> DataFrame:
    """Divided by the sample's median ratio to the reference.

    ``feature``: geometric mean of each feature over all samples.
    ``feature_time``: geometric mean of each feature over the observations of a
    layer; a sample's median then runs over its ratios to every layer's
    reference.
    """
    if mode not in ("feature", "feature_time"):
        raise PanelError("reference_mode must be feature or feature_time")
    x = F.col(value)
    if reference is None:
        by = ["feature"] if mode == "feature" else ["feature", "time_index"]
        reference = long.groupBy(*by).agg(F.exp(F.avg(F.ln(_positive(x)))).alias("_ref")).select("feature", "_ref")
    else:
        reference = reference.select("feature", F.col("reference").alias("_ref"))
    ratio = F.when((x > 0) & (F.col("_ref") > 0), x / F.when(F.col("_ref") > 0, F.col("_ref")))
    scale = long.join(reference, "feature", "left").groupBy(*keys).agg(F.median(ratio).alias("_s"))
    scaled = long.join(scale, list(keys))
    safe = F.when(F.col("_s").isNull() | (F.col("_s") == 0), F.lit(1.0)).otherwise(F.col("_s"))
    return scaled.withColumn(value, x / safe).drop("_s")


def _ilr(long: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Helmert contrasts of the clr values; the last coordinate is 0.

    In closed form ``z_j = (j c_{j+1} - sum_{i<=j} c_i) / sqrt(j (j+1))`` with
    features in order of name, so one running sum replaces the basis.  Row j
    keeps the name of feature j although it is a contrast.  Samples of a
    balanced panel hold the same features, so j is the rank in the sample.
    """
    w = Window.partitionBy(*keys)
    ordered = w.orderBy("feature")
    c, j = F.col("_c"), F.row_number().over(ordered).cast("double")
    running = F.sum(c).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    contrast = (j * F.lead(c).over(ordered) - running) / F.sqrt(j * (j + 1))
    out = long.withColumn("_c", _clr(F.col(value), w))
    return out.withColumn(value, F.coalesce(contrast, F.lit(0.0))).drop("_c")


def normalize(
    long: DataFrame,
    method: str = "clr",
    zero_method: str | None = "half_min",
    value: str = VALUE,
    keys: tuple[str, ...] = SAMPLE,
    constant: float | None = None,
    delta: float | None = None,
    fraction: float | None = None,
    reference: DataFrame | None = None,
    reference_mode: str = "feature",
    quantile: float = 0.5,
) -> DataFrame:
    """Each sample normalized along the feature axis.

    clr, rle and ilr replace zeros first by ``zero_method`` ("none" turns that
    off; logarithms of remaining zeros are null).
    """
    if method not in NORMALIZE_METHODS:
        raise PanelError(f"normalization method {method!r} is not one of {', '.join(NORMALIZE_METHODS)}")
    if method in NEEDS_POSITIVE and zero_method not in (None, "none"):
        long = zero_fill(long, zero_method, value, keys, constant=constant, delta=delta, fraction=fraction)
    if method in SIMPLE:
        return long.withColumn(value, SIMPLE[method](F.col(value), Window.partitionBy(*keys)))
    if method == "css":
        return _css(long, value, keys, quantile)
    if method == "rle":
        return _rle(long, value, keys, reference, reference_mode)
    return _ilr(long, value, keys)


def preprocess(long: DataFrame, filter: dict | None = None, zero: dict | None = None, normalize_: dict | str | None = "clr") -> tuple[DataFrame, DataFrame]:
    """(processed rows, features with ``kept``): filter, zero-fill, normalize."""
    kept = filter_features(long, **(filter or {}))
    names = kept.select("feature").distinct().withColumn("kept", F.lit(True))
    report = long.select("feature").distinct().join(names, "feature", "left").na.fill({"kept": False})
    out = zero_fill(kept, **zero) if zero else kept
    spec = {"method": normalize_} if isinstance(normalize_, str) else normalize_
    return (normalize(out, **spec) if spec else out), report


def preprocess_panel(panel: Panel, **spec) -> Panel:
    """The panel with processed values and its metadata."""
    return panel.with_values(preprocess(panel.long, **spec)[0])
