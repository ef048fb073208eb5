"""Effects of an intervention per feature: DiD, two-way FE, event study, SCM.

On a balanced panel the two-way fixed-effect estimators have closed forms in
group means, so three of the four estimators are plain aggregations: one
shuffle to per-series sums, one to per-feature results.  Only synthetic control
solves a program per unit and runs in grouped pandas functions (``scm``).
"""

from __future__ import annotations

import dataclasses
import functools
import re
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bh_adjust, bh_adjust_large, normal_p_value
from .panel import Panel, PanelError, as_panel, to_series

METHODS = ("did", "pooled_ols", "event_study", "scm")
EFFECTS = (
    "feature", "method", "estimate", "standard_error", "statistic", "p_value", "fdr", "n_treated", "n_control",
    "mean_pre_treated", "mean_post_treated", "mean_pre_control", "mean_post_control", "effect_range",
)
_ALIASES = {
    "abundance": "abundance_value", "value": "abundance_value", "y": "abundance_value",
    "feature": "feature", "abundance_value": "abundance_value",
    "group": "label", "treatment": "label", "label": "label",
    "obs": "observation", "unit": "observation", "subject": "observation", "observation": "observation",
    "time": "time_identifier", "layer": "time_identifier", "time_identifier": "time_identifier",
}


@dataclasses.dataclass(frozen=True)
class Formula:
    response: str
    treatment: str
    fixed: tuple[str, ...] = ()


def parse_formula(text: str) -> Formula:
    """``response ~ treatment | effect + effect``, names resolved and checked."""
    m = re.fullmatch(r"\s*([\w.]+)\s*~\s*([\w.]+)\s*(?:\|\s*([\w.]+(?:\s*\+\s*[\w.]+)*))?\s*", text)
    if not m:
        raise PanelError(f"formula {text!r} is not of the form y ~ x | a + b")
    fixed = tuple(re.split(r"\s*\+\s*", m[3])) if m[3] else ()

    def resolve(name: str, allowed: tuple[str, ...], role: str) -> str:
        found = _ALIASES.get(name.lower())
        if found not in allowed:
            raise PanelError(f"{name!r} cannot be the {role}")
        return found

    return Formula(
        resolve(m[1], ("feature", "abundance_value"), "response"),
        resolve(m[2], ("label",), "treatment"),
        tuple(resolve(f, ("observation", "time_identifier"), "fixed effect") for f in fixed),
    )


@dataclasses.dataclass(frozen=True)
class Design:
    """Panel rows with group flags, the onset and the number of layers.

    Group sizes are counted inside the plans that need them; ``sizes`` runs a
    small job for the few places that plan with them.
    """

    rows: DataFrame  # observation, feature, time_index, value, is_treated, is_control
    t0: int
    n_layers: int
    flags: DataFrame  # observation, is_treated, is_control

    @functools.cached_property
    def sizes(self) -> tuple[int, int]:
        """(treated, control) observations."""
        return tuple(self.flags.agg(F.count_if("is_treated"), F.count_if("is_control")).first())

    @property
    def n_treated(self) -> int:
        return self.sizes[0]

    @property
    def n_control(self) -> int:
        return self.sizes[1]


def resolve_onset(panel: Panel, index: int | None = None) -> tuple[int, int]:
    """(onset, number of layers); by default the first flagged layer."""
    flagged = F.min(F.when(F.col("is_intervention_timepoint"), F.col("time_index")))
    found, n = panel.time_meta.agg(flagged, F.count(F.lit(1))).first()
    t0 = index if index is not None else found
    if t0 is None:
        raise PanelError("no layer is flagged as intervention; give intervention_index")
    if not 2 <= t0 <= n:
        raise PanelError(f"the intervention must start in layer 2..{n}")
    return t0, n


def design(panel: Panel, treatment_level: str | None = None, control_level: str | tuple[str, ...] | None = None, intervention_index: int | None = None) -> Design:
    """Groups and onset; with two labels the second one is treated by default."""
    levels = panel.levels
    if treatment_level is None:
        if len(levels) != 2:
            raise PanelError("treatment_level must be given unless there are two labels")
        treatment_level = levels[1]
    if treatment_level not in levels:
        raise PanelError(f"label {treatment_level!r} does not occur")
    controls = (control_level,) if isinstance(control_level, str) else control_level
    controls = tuple(x for x in levels if x != treatment_level) if controls is None else tuple(controls)
    if treatment_level in controls or not set(controls) <= set(levels):
        raise PanelError("control_level must name other labels that occur")
    t0, n = resolve_onset(panel, intervention_index)
    flags = panel.observation_meta.select(
        F.col("observation_id").alias("observation"),
        (F.col("label") == treatment_level).alias("is_treated"),
        F.col("label").isin(*controls).alias("is_control"),
    )
    rows = panel.long.withColumnRenamed("abundance_value", "value").join(flags, "observation")
    return Design(rows, t0, n, flags)


def series(d: Design) -> DataFrame:
    """One row a series with its group flags and ``xs``, values in time order.

    Everything else is derived from these rows, and equal shuffles are run
    once, so an estimator reads and shuffles the panel a single time.
    """
    return to_series(d.rows, "value", ("feature", "observation", "is_treated", "is_control"))


def unit_means(d: Design, keep: bool = False) -> DataFrame:
    """Per series: pre and post means, their difference, the value before the
    onset, and ``within``, the sum of squares around the series' mean;
    with ``keep`` also the series."""
    total = "aggregate({}, 0D, (s, x) -> s + x)"
    out = series(d).selectExpr(
        "feature",
        "observation",
        "is_treated",
        "is_control",
        f"{total.format(f'slice(xs, 1, {d.t0 - 1})')} / {d.t0 - 1}D as pre",
        f"{total.format(f'slice(xs, {d.t0}, {d.n_layers - d.t0 + 1})')} / {d.n_layers - d.t0 + 1}D as post",
        f"xs[{d.t0 - 2}] as base",
        f"{total.format('xs')} / {d.n_layers}D as mean",
        "xs",
    )
    out = out.withColumn("within", F.expr("aggregate(xs, 0D, (s, x) -> s + (x - mean) * (x - mean))")).withColumn("delta", F.col("post") - F.col("pre"))
    return out if keep else out.drop("xs")


def group_means(units: DataFrame) -> DataFrame:
    """Per feature: pre and post means of both groups, variances of differences."""

    def avg(c: str, flag: str, name: str) -> Column:
        return F.avg(F.when(F.col(flag), F.col(c))).alias(name)

    return units.groupBy("feature").agg(
        avg("pre", "is_treated", "mean_pre_treated"),
        avg("post", "is_treated", "mean_post_treated"),
        avg("pre", "is_control", "mean_pre_control"),
        avg("post", "is_control", "mean_post_control"),
        F.var_samp(F.when(F.col("is_treated"), F.col("delta"))).alias("var_treated"),
        F.var_samp(F.when(F.col("is_control"), F.col("delta"))).alias("var_control"),
        F.count_if("is_treated").alias("n_treated"),
        F.count_if("is_control").alias("n_control"),
        F.count(F.lit(1)).alias("n_all"),
    )


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where b is 0 or null."""
    return a / F.when(b != 0, b)


def with_statistic(df: DataFrame, inference: bool = True) -> DataFrame:
    out = df.withColumn("statistic", _ratio(F.col("estimate"), F.col("standard_error")))
    return out.withColumn("p_value", normal_p_value(F.col("statistic"))) if inference else out


def finish_effects(rows: DataFrame, method: str, inference: bool) -> DataFrame:
    """Counts as integers, method, statistic and p-values, in the order of ``EFFECTS``."""
    out = rows.withColumns({"method": F.lit(method), "n_treated": F.col("n_treated").cast("int"), "n_control": F.col("n_control").cast("int")})
    out = with_statistic(out, inference)
    if not inference:
        return out.select(*[c for c in EFFECTS if c not in ("p_value", "fdr")])
    return bh_adjust_large(out).select(*EFFECTS)


def profile(d: Design) -> DataFrame:
    """Per (feature, ``k``): means and variances of the groups; k = 0 is the whole series.

    Suffixes: ``t`` treated, ``c`` chosen controls, ``o`` all that are not treated,
    ``a`` all.  Row 0 holds the pre and post means of both
    groups, the moments of the units' differences and the sum of squares within
    series; rows 1.. the layers' values.  So one shuffle over the series and one
    over features and layers serve an estimator and its path.
    """
    units = unit_means(d, keep=True)
    empty = F.lit(None).cast("double")
    fields = ("x", "pre", "post", "within")
    head = F.struct(F.col("delta").alias("x"), *(F.col(c) for c in fields[1:]))
    rest = F.transform("xs", lambda v: F.struct(v.alias("x"), *(empty.alias(c) for c in fields[1:])))
    rows = units.select("feature", "is_treated", "is_control", F.posexplode(F.concat(F.array(head), rest)).alias("k", "v"))
    t, c, x = F.col("is_treated"), F.col("is_control"), F.col("v.x")

    def mean(flag: Column, of: str, name: str) -> Column:
        return F.avg(F.when(flag, F.col(f"v.{of}"))).alias(name)

    return rows.groupBy("feature", "k").agg(
        mean(t, "x", "mean_t"),
        mean(c, "x", "mean_c"),
        mean(~t, "x", "mean_o"),
        F.avg(x).alias("mean_a"),
        F.var_samp(F.when(t, x)).alias("var_t"),
        F.var_samp(F.when(c, x)).alias("var_c"),
        F.count_if(t).alias("n_t"),
        F.count_if(c).alias("n_c"),
        F.count(F.lit(1)).alias("n_a"),
        mean(t, "pre", "mean_pre_treated"),
        mean(t, "post", "mean_post_treated"),
        mean(c, "pre", "mean_pre_control"),
        mean(c, "post", "mean_post_control"),
        F.sum("v.within").alias("within"),
    )


def _one(c: str, k: Column) -> Column:
    """The value of ``c`` in the group's row ``k``."""
    return F.max(F.when(k, F.col(c)))


def _folded(p: DataFrame, *more: Column) -> DataFrame:
    """One row a feature of :func:`profile`: its row 0 and ``more`` aggregates over the layers."""
    head = F.col("k") == 0
    names = {"n_t": "n_treated", "n_c": "n_control", "n_a": "n_all", "within": "within"} | {m: m for m in EFFECTS if m.startswith("mean_")}
    return p.groupBy("feature").agg(*(_one(c, head).alias(name) for c, name in names.items()), *more)


def _layer_rows(p: DataFrame, d: Design, method: str, estimate: Column, se: Column) -> DataFrame:
    return p.select(
        "feature", F.col("k").alias("time_index"), (F.col("k") - d.t0).alias("relative_time"), F.lit(method).alias("method"), estimate.alias("estimate"), se.alias("standard_error")
    )


def _gap_path(p: DataFrame, d: Design, method: str, inference: bool) -> DataFrame:
    """Per (feature, layer): treated minus control mean with its error."""
    se = F.sqrt(F.col("var_t") / F.col("n_t") + F.col("var_c") / F.col("n_c"))
    return with_statistic(_layer_rows(p.where("k > 0"), d, method, F.col("mean_t") - F.col("mean_c"), se), inference)


def _gap_range() -> Column:
    gap = F.when(F.col("k") > 0, F.col("mean_t") - F.col("mean_c"))
    return (F.max(gap) - F.min(gap)).alias("effect_range")


def time_path(d: Design, method: str = "did", inference: bool = True) -> DataFrame:
    """Per (feature, layer): treated minus control mean with its error."""
    return _gap_path(profile(d), d, method, inference)


def did(d: Design, inference: bool = True) -> tuple[DataFrame, DataFrame]:
    """Difference in differences of group means; (effects, per-layer path)."""
    p, head = profile(d), F.col("k") == 0
    g = _folded(p, _gap_range(), _one("var_t", head).alias("vt"), _one("var_c", head).alias("vc"))
    estimate = (F.col("mean_post_treated") - F.col("mean_pre_treated")) - (F.col("mean_post_control") - F.col("mean_pre_control"))
    se = F.sqrt(F.col("vt") / F.col("n_treated") + F.col("vc") / F.col("n_control"))
    return finish_effects(g.withColumn("estimate", estimate).withColumn("standard_error", se), "did", inference), _gap_path(p, d, "did", inference)


def pooled_ols(d: Design, inference: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two-way fixed effects of treated x post, in closed form.

    The coefficient is a DiD against all observations that are not treated;
    its error comes from the residual sum of squares
    ``SS(demeaned y) - b^2 N p (1-p) T q (1-q)``.  Balanced, so the first term is
    the squares around the series' means less N times those of the layers'
    means around the whole.
    """
    t = d.n_layers
    q = (t - d.t0 + 1) / t
    p, head = profile(d), F.col("k") == 0
    n, share = F.col("n_all"), F.col("n_treated") / F.col("n_all")
    dd = n * share * (1 - share) * F.lit(t * q * (1 - q))
    dof = (n * t - (n + (t - 1)) - 1).cast("double")
    between = (F.var_pop(F.when(~head, F.col("mean_a"))) * t).alias("between")
    g = _folded(p, _gap_range(), between, (_one("mean_t", head) - _one("mean_o", head)).alias("estimate"))
    ss = F.col("within") - n * F.col("between")
    rss = F.greatest(F.lit(0.0), ss - F.col("estimate") * F.col("estimate") * dd)
    g = g.withColumn("standard_error", F.sqrt(rss / F.when(dof > 0, dof) / dd))
    return finish_effects(g, "pooled_ols", inference), _gap_path(p, d, "pooled_ols", inference)


def event_study(d: Design, inference: bool = True) -> tuple[DataFrame, DataFrame]:
    """Treated x relative time with the layer before onset as base, closed form.

    ``b_k`` is the gap of the two groups' means in layer ``t0 + k`` minus their
    gap in the base layer; all share one standard error.  The headline is the
    mean of the coefficients from onset on.
    """
    t = d.n_layers
    p, k = profile(d), F.col("k")
    gap = F.col("mean_t") - F.col("mean_o")
    layer, after, other = k > 0, k >= d.t0, (k > 0) & (k != d.t0 - 1)
    # residuals y_it - mean_i - mean_gt + mean_g: squares around the series' means less those of the groups' layer means
    g = _folded(
        p,
        F.max(F.when(k == d.t0 - 1, gap)).alias("base_gap"),
        (t * F.var_pop(F.when(layer, F.col("mean_t")))).alias("between_t"),
        (t * F.var_pop(F.when(layer, F.col("mean_o")))).alias("between_o"),
        F.avg(F.when(after, gap)).alias("after"),
        (F.max(F.when(other, gap)) - F.min(F.when(other, gap))).alias("effect_range"),
    )
    n1, n0 = F.col("n_treated"), F.col("n_all") - F.col("n_treated")
    left = F.greatest(F.lit(0.0), F.col("within") - n1 * F.col("between_t") - n0 * F.col("between_o"))
    # without spare degrees of freedom there is no error
    dof = ((n1 + n0) * t - (n1 + n0 + (t - 1)) - (t - 1)).cast("double")
    g = g.withColumn("standard_error", F.sqrt(2.0 * (1 / n1 + 1 / n0) * left / F.when(dof > 0, dof)))
    effects = finish_effects(g.withColumn("estimate", F.col("after") - F.col("base_gap")), "event_study", inference)
    path = p.where(other).join(g.select("feature", "base_gap", "standard_error"), "feature")
    path = _layer_rows(path, d, "event_study", gap - F.col("base_gap"), F.col("standard_error"))
    return effects, with_statistic(path, inference)


@dataclasses.dataclass(frozen=True)
class CausalResult:
    """Effects, paths and, where asked for, weights and inference tables."""

    method: str
    formula: Formula
    effects: DataFrame
    time_effects: DataFrame
    design: Design
    weights: DataFrame | None = None
    weight_sum: DataFrame | None = None
    placebo: DataFrame | None = None
    bootstrap: DataFrame | None = None
    pre_fit: DataFrame | None = None

    def summary(self) -> DataFrame:
        """Method, features, share with fdr < 0.05, median absolute effect."""
        return self.effects.agg(
            F.lit(self.method).alias("method"),
            F.count(F.lit(1)).alias("n_features"),
            F.avg((F.col("fdr") < 0.05).cast("double")).alias("share_fdr_05"),
            F.median(F.abs("estimate")).alias("median_abs_estimate"),
        )


def estimate(
    formula: str,
    data: Panel | DataFrame | np.ndarray,
    method: str = "did",
    treatment_level: str | None = None,
    control_level: str | tuple[str, ...] | None = None,
    intervention_index: int | None = None,
    scm_constraint: str = "simplex",
    scm_offset: bool = True,
    placebo: bool = False,
    bootstrap: bool = False,
    bootstrap_samples: int = 500,
    bootstrap_level: float = 0.95,
    pre_fit: bool = False,
    seed: int = 1,
    observation_meta: DataFrame | None = None,
    time_meta: DataFrame | None = None,
) -> CausalResult:
    """The one entry point: parse, bind groups and onset, run, add inference.

    ``data``: a panel, a seven-column long table, or a dense (observation, feature,
    layer) array with both metadata tables in the array's order.  Placebo tests
    need two controls and pre-fit needs synthetic controls; without them a
    warning says so and the result lacks them.
    Fixed effects named in the formula are checked; the two-way estimators
    always use both.  Placebo inference always refits synthetic controls.
    """
    from . import inference, scm

    parsed = parse_formula(formula)
    if method not in METHODS:
        raise PanelError(f"method {method!r} is not one of {', '.join(METHODS)}")
    if pre_fit and method != "scm":
        warnings.warn("pre_fit is defined for scm only; skipped", stacklevel=2)
        pre_fit = False
    panel = as_panel(data, observation_meta, time_meta)
    d = design(panel, treatment_level, control_level, intervention_index)
    if not all(d.sizes):
        raise PanelError("both groups need at least one observation")
    if placebo and d.n_control < 2:
        warnings.warn("placebo needs at least two control observations; skipped", stacklevel=2)
        placebo = False
    weights = weight_sum = None
    if method == "scm":
        effects, path, weights, weight_sum = scm.synthetic_control(d, scm_constraint, scm_offset)
    else:
        effects, path = {"did": did, "pooled_ols": pooled_ols, "event_study": event_study}[method](d)
    names = panel.time_meta.select("time_index", "time_identifier")
    path = path.join(F.broadcast(names), "time_index")
    plc = inference.placebo(d, effects, scm_constraint, scm_offset) if placebo else None
    boot = inference.bootstrap(d, method, bootstrap_samples, bootstrap_level, seed, scm_constraint, scm_offset) if bootstrap else None
    for extra in (plc, boot):
        if extra is not None:
            effects = effects.join(extra, "feature", "left")
    fit = scm.pre_fit(d, weights, scm_offset) if pre_fit else None
    return CausalResult(method, parsed, effects, path, d, weights, weight_sum, plc, boot, fit)
