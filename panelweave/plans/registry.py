"""Registered queries and their ANSI-SQL equivalents.

Doubles are rounded to six places on both sides; ``+ 0.0`` turns a negative
zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bh_adjust, bh_adjust_large
from ..functions.shared import shared_folder
from ..operators import causal, experiments, inference, metrics, panel, preprocess, scm, simulate, smooth, smooth_nb, validate
from ..sources import archive
from . import panels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return f

    return add


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _sql_r(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


KEYS = ["observation", "time_index", "feature"]


def _cells(df: DataFrame, value: str = "abundance_value") -> DataFrame:
    return df.select(*KEYS, _r(value).alias("value"))


# --------------------------------------------------------------------------- #
# panel construction, metadata, checks
# --------------------------------------------------------------------------- #
@_query("panel_densify", f"with {panels.E_SQL} select observation, time_index, feature, raw from p")
def panel_densify(spark, d):
    return panels.e_counts(spark, d).select(*KEYS, "raw")


@_query("panel_closure", f"with {panels.E_SQL} select observation, time_index, feature, {_sql_r('x')} as value from p")
def panel_closure(spark, d):
    return _cells(panels.e_cells(spark, d))


@_query("panel_quantities", f"with {panels.B_SQL} select observation, time_index, feature, {_sql_r('x')} as value from p")
def panel_quantities(spark, d):
    return _cells(panels.b_cells(spark, d))


_T_SQL = """, t as (select observation, printf('time_%03d', time_index) as time_identifier, 5.0::double * (time_index - 1) as elapsed_time,
  feature, x as abundance_value, case when treated then 'treat' else 'ctrl' end as label, post as is_intervention from p)"""


@_query("panel_table", f"with {panels.E_SQL}{_T_SQL} select * replace ({_sql_r('abundance_value')} as abundance_value) from t")
def panel_table(spark, d):
    p = panel.from_long(panels.e_table(spark, d), ("ctrl", "treat"))
    return p.table().withColumn("abundance_value", _r("abundance_value"))


@_query(
    "panel_composition_check",
    f"with {panels.E_SQL}{_T_SQL}, s as (select observation, time_identifier, sum(abundance_value) as total from t group by all) "
    "select observation, time_identifier, abs(total - 1) <= 1e-6 as closed from s",
)
def panel_composition_check(spark, d):
    sums = validate.sample_sums(panels.e_table(spark, d))
    return sums.select("observation", "time_identifier", (F.abs(F.col("total") - 1) <= validate.SUM_TOLERANCE).alias("closed"))


@_query(
    "panel_balance_check",
    f"""with {panels.E_SQL}{_T_SQL} select count(*) as n_rows, count(distinct observation) as n_observations, count(distinct feature) as n_features,
    count(distinct time_identifier) as n_layers, count(distinct (observation, time_identifier)) as n_samples, count(distinct (observation, feature)) as n_series,
    count(distinct observation) * count(distinct feature) * count(distinct time_identifier) as n_expected from t""",
)
def panel_balance_check(spark, d):
    return validate.balance(panels.e_table(spark, d))


@_query("observation_meta", f"with {panels.E_SQL}{_T_SQL} select distinct observation as observation_id, label from t")
def observation_meta(spark, d):
    return panel.observation_meta(panels.e_table(spark, d))


@_query(
    "time_meta_delta_t",
    f"""with {panels.B_SQL}, l as (select distinct time_index, time_index + {panels.B_FIRST_YEAR - 1}::double as elapsed_time from p)
    select printf('time_%03d', time_index) as time_identifier, elapsed_time, coalesce(elapsed_time - lag(elapsed_time) over (order by elapsed_time), 0)::double as delta_t,
    time_index >= {panels.B_ONSET} as is_intervention_timepoint, row_number() over (order by elapsed_time)::integer as time_index from l""",
)
def time_meta_delta_t(spark, d):
    return panel.time_meta(panels.b_table(spark, d))


@_query("feature_index", f"with {panels.B_SQL}, f as (select distinct feature from p) select feature, row_number() over (order by feature) as feature_index from f")
def feature_index(spark, d):
    return panel.feature_index(panels.b_cells(spark, d))


@_query(
    "wide_pivot",
    f"with {panels.E_SQL}, r as (select observation, time_index, feature, {_sql_r('x')} as v from p) pivot r on feature using max(v) group by observation, time_index",
)
def wide_pivot(spark, d):
    cells = panels.e_cells(spark, d)
    names = [r[0] for r in cells.select("feature").distinct().orderBy("feature").collect()]
    wide = panel.long_to_wide(cells, names)
    return wide.select("observation", "time_index", *[_r(F.col(f"`{n}`")).alias(n) for n in names])


@_query(
    "long_unpivot",
    "with s as (select s_name as observation, s_acctbal as acctbal, s_nationkey::double as nationkey from supplier) "
    "select observation, 'acctbal' as feature, acctbal as abundance_value from s union all select observation, 'nationkey', nationkey from s",
)
def long_unpivot(spark, d):
    wide = panels.table(spark, d, "supplier").select(F.col("s_name").alias("observation_id"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nationkey"))
    return panel.wide_to_long(wide)


@_query(
    "unmatched_anti",
    "select distinct cast(user_id as varchar) as observation from events where user_id not in (select s_suppkey from supplier)",
)
def unmatched_anti(spark, d):
    long = panels.table(spark, d, "events").select(F.col("user_id").cast("string").alias("observation"))
    known = panels.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("observation_id"))
    return panel.unmatched_keys(long, known)


@_query(
    "panel_summary",
    f"""with {panels.E_SQL} select count(*) as n_cells, {_sql_r('avg((x = 0)::integer)')} as zero_share, {_sql_r('min(x)')} as min_value, {_sql_r('max(x)')} as max_value,
    count(distinct feature) as n_features, count(distinct observation) as n_observations, count(distinct treated) as n_groups, count(distinct time_index) as n_layers, {panels.E_ONSET} as onset from p""",
)
def panel_summary(spark, d):
    out = panels.e_panel(spark, d).summary()
    return out.withColumns({c: _r(c) for c in ("zero_share", "min_value", "max_value")})


@_query(
    "canonical_order",
    f"with {panels.E_SQL}{_T_SQL} select * replace ({_sql_r('abundance_value')} as abundance_value), row_number() over (order by observation, elapsed_time, time_identifier, feature) as position from t",
)
def canonical_order(spark, d):
    return panel.canonical_position(panels.e_table(spark, d)).withColumn("abundance_value", _r("abundance_value"))


@_query(
    "time_bins",
    """with b as (select o_custkey % 5 as g, cast(floor(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) / 365.0) + 1 as integer) as time_index, o_orderpriority as feature, avg(o_totalprice) as raw
       from orders group by all),
    k as (select time_index from b group by time_index having count(distinct g) = (select count(distinct g) from b))
    select cast(g as varchar) as observation, time_index, feature, """
    + _sql_r("raw / sum(raw) over (partition by g, time_index)")
    + " as value from b where time_index in (select time_index from k)",
)
def time_bins(spark, d):
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("double")
    rows = panels.table(spark, d, "orders").select((F.col("o_custkey") % 5).cast("string").alias("observation"), day.alias("day"), F.col("o_orderpriority").alias("feature"), "o_totalprice")
    return _cells(panel.time_bins(rows, "day", 365.0, "o_totalprice", ("observation", "feature")))


# --------------------------------------------------------------------------- #
# filter
# --------------------------------------------------------------------------- #
_STATS = "avg((x > 0)::integer) as prevalence, avg(x) as mean, sum(x) as total, max(x) as maximum, 1 - avg((x > 0)::integer) as zero_share"


@_query(
    "feature_stats",
    f"with {panels.B_SQL}, s as (select feature, {_STATS} from p group by feature) select feature, "
    + ", ".join(f"{_sql_r(c)} as {c}" for c in ("prevalence", "mean", "total", "maximum", "zero_share"))
    + " from s",
)
def feature_stats(spark, d):
    out = preprocess.feature_stats(panels.b_cells(spark, d))
    return out.select("feature", *[_r(c).alias(c) for c in out.columns[1:]])


def _filter_query(name: str, test: str, **spec):
    @_query(name, f"with {panels.B_SQL}, s as (select feature, {_STATS} from p group by feature having {test}) select observation, time_index, feature, {_sql_r('x')} as value from p join s using (feature)")
    def run(spark, d):
        return _cells(preprocess.filter_features(panels.b_cells(spark, d), **spec))


_filter_query("filter_prevalence", "avg((x > 0.0401)::integer) >= 0.45", min_prevalence=0.45, min_abundance=0.0401)
_filter_query("filter_mean", "avg(x) >= 0.0399", min_mean_abundance=0.0399)
_filter_query("filter_total", "sum(x) >= 6.95", min_total_abundance=6.95)
_filter_query("filter_max", "max(x) >= 0.0601", min_max_abundance=0.0601)
_filter_query("filter_zero_share", "1 - avg((x > 0)::integer) <= 0.0031", max_zero_proportion=0.0031)

# --------------------------------------------------------------------------- #
# zeros and normalization
# --------------------------------------------------------------------------- #
_W = "over (partition by observation, time_index)"
_ZERO = {
    "constant": "case when x = 0 then 0.5 else x end",
    "half_min": f"case when x = 0 then 0.5 * min(case when x > 0 then x end) {_W} else x end",
    "sqrt_min": f"case when x = 0 then 0.5 * sqrt(min(case when x > 0 then x end) {_W}) else x end",
    "multiplicative": f"case when count(*) filter (x = 0) {_W} = 0 then x when x = 0 then 0.0001 else x * (1 - 0.0001 * count(*) filter (x = 0) {_W}) / sum(case when x > 0 then x end) {_W} end",
    "bayesian": f"""case when count(*) filter (x = 0) {_W} = 0 then x
       when x = 0 then sum(x) {_W} * (1 - exp(avg(ln(case when x > 0 then x end)) {_W} - ln(sum(x) {_W}))) / count(*) filter (x = 0) {_W}
       else x * exp(avg(ln(case when x > 0 then x end)) {_W} - ln(sum(x) {_W})) end""",
}


def _zero_query(method: str):
    @_query(f"zero_{method}", f"with {panels.E_SQL} select observation, time_index, feature, {_sql_r(_ZERO[method])} as value from p")
    def run(spark, d):
        return _cells(preprocess.zero_fill(panels.e_cells(spark, d), method))


for _m in _ZERO:
    _zero_query(_m)

_Z = f", z as (select * replace ({_ZERO['half_min']} as x) from p)"
_CLR = f", c as (select *, ln(x) - avg(ln(x)) {_W} as c from z)"
_NORM = {
    "clr": (f"{_Z}{_CLR}", "c", "c"),
    "tss": ("", "raw / sum(raw) over (partition by observation, time_index)", "p"),
    "log1p": ("", "ln(1 + x)", "p"),
    "css": (
        f", k as (select *, row_number() over (partition by observation, time_index order by case when x > 0 then x end nulls last, feature) as r, count(case when x > 0 then 1 end) {_W} as n from p)",
        f"x / sum(case when x > 0 and r <= greatest(1, floor(0.5 * n)) then x end) {_W}",
        "k",
    ),
    "rle": (
        f"{_Z}, g as (select feature, exp(avg(ln(x))) as ref from z group by feature), k as (select observation, time_index, median(x / ref) as s from z join g using (feature) group by all), y as (select z.*, s from z join k using (observation, time_index))",
        "x / s",
        "y",
    ),
    "ilr": (
        f"{_Z}{_CLR}, j as (select *, row_number() over w as j, sum(c) over (w rows unbounded preceding) as run, lead(c) over w as nxt from c window w as (partition by observation, time_index order by feature))",
        "coalesce((j * nxt - run) / sqrt(j * (j + 1)), 0)",
        "j",
    ),
    "rclr": ("", f"case when x > 0 then ln(x) - avg(ln(case when x > 0 then x end)) {_W} else 0 end", "p"),
    "z_score": ("", f"(x - avg(x) {_W}) / case when stddev_samp(x) {_W} = 0 then 1 else stddev_samp(x) {_W} end", "p"),
    "min_max": ("", f"(x - min(x) {_W}) / case when max(x) {_W} = min(x) {_W} then 1 else max(x) {_W} - min(x) {_W} end", "p"),
}


def _norm_query(method: str):
    ctes, expr, source = _NORM[method]

    @_query(f"norm_{method}", f"with {panels.E_SQL}{ctes} select observation, time_index, feature, {_sql_r(expr)} as value from {source}")
    def run(spark, d):
        if method == "tss":
            counts = panels.e_counts(spark, d).withColumnRenamed("raw", "abundance_value")
            return _cells(preprocess.normalize(counts, method))
        return _cells(preprocess.normalize(panels.e_cells(spark, d), method))


for _m in _NORM:
    _norm_query(_m)


_KEPT = ", f as (select feature from p group by feature having avg((x > 0.0401)::integer) >= 0.45)"
_KEPT_Z = f"{_KEPT}, z as (select observation, time_index, feature, {_ZERO['half_min']} as x from p join f using (feature))"


@_query("preprocess_pipeline", f"with {panels.B_SQL}{_KEPT_Z}{_CLR} select observation, time_index, feature, {_sql_r('c')} as value from c")
def preprocess_pipeline(spark, d):
    spec = {"min_prevalence": 0.45, "min_abundance": 0.0401}
    out, _ = preprocess.preprocess(panels.b_cells(spark, d), filter=spec, zero={"method": "half_min"}, normalize_="clr")
    return _cells(out)


# --------------------------------------------------------------------------- #
# smoothing
# --------------------------------------------------------------------------- #
def _clr_cells(spark, d) -> DataFrame:
    return preprocess.normalize(panels.e_cells(spark, d), "clr")


_SERIES = f"{_Z}{_CLR}, s as (select observation, feature, time_index as t, time_index >= {panels.E_ONSET} as seg, c as v from c)"
_PAIR = "from s a join s b on a.observation = b.observation and a.feature = b.feature and a.seg = b.seg"


# Sums over the window of a local fit, offsets from its centre as x; ``loess`` weighs them by
# the tricube of the distance, ``savgol`` takes the nearest two on either side.
_TRICUBE = """, l as (select seg, count(distinct t) as n from s group by seg), h as (select seg, 0.75 * (n - 1) / 2 as half from l),
  j as (select a.observation, a.feature, a.t, (b.t - a.t)::double as x, b.v as y, power(greatest(1 - power(abs(a.t - b.t) / greatest(1.0, half), 3), 0), 3) as w
    from s a join s b on a.observation = b.observation and a.feature = b.feature and a.seg = b.seg join h on h.seg = a.seg where abs(a.t - b.t) <= greatest(1, floor(half))),
  q as (select observation, feature, t, sum(w) as s0, sum(w * x) as s1, sum(w * x * x) as s2, sum(w * y) as t0, sum(w * x * y) as t1 from j group by all)"""
_QUADRATIC = f""", q as (select a.observation, a.feature, a.t, count(*)::double as s0, sum(b.t - a.t)::double as s1, sum((b.t - a.t) ** 2) as s2, sum((b.t - a.t) ** 3) as s3, sum((b.t - a.t) ** 4) as s4,
  sum(b.v) as t0, sum((b.t - a.t) * b.v) as t1, sum((b.t - a.t) ** 2 * b.v) as t2 {_PAIR} where abs(a.t - b.t) <= 2 group by all)"""
_FORWARD = """, k as (select observation, feature, t, v as m, 100.0::double as q from s where t = 1 union all
  select s.observation, s.feature, s.t, k.m + (k.q + 0.1) / (k.q + 1.1) * (s.v - k.m), (1 - (k.q + 0.1) / (k.q + 1.1)) * (k.q + 0.1)
  from k join s on s.observation = k.observation and s.feature = k.feature and s.t = k.t + 1)"""
_BACKWARD = f""", b as (select observation, feature, t, m as y from k where t = {panels.E_LAYERS} union all
  select k.observation, k.feature, k.t, k.m + k.q / (k.q + 0.1) * (b.y - k.m) from b join k on k.observation = b.observation and k.feature = b.feature and k.t = b.t - 1)"""


_SMOOTH_SQL = {
    "moving_average": f"with {panels.E_SQL}{_SERIES} select observation, t as time_index, feature, {_sql_r('avg(v) over (partition by observation, feature, seg order by t rows between 2 preceding and 2 following)')} as value from s",
    "gaussian": f"with {panels.E_SQL}{_SERIES}, g as (select a.observation, a.feature, a.t, sum(exp(-0.5 * ((a.t - b.t) / 2.0) ^ 2) * b.v) / sum(exp(-0.5 * ((a.t - b.t) / 2.0) ^ 2)) as y {_PAIR} where abs(a.t - b.t) <= 6 group by all) "
    f"select observation, t as time_index, feature, {_sql_r('y')} as value from g",
    "ewma": f"with {panels.E_SQL}{_SERIES}, f as (select seg, min(t) as t0 from s group by seg), "
    f"g as (select a.observation, a.feature, a.t, sum(power(0.7, a.t - b.t) * case when b.t = f.t0 then 1 else 0.3 end * b.v) as y {_PAIR} and b.t <= a.t join f on f.seg = a.seg group by all) "
    f"select observation, t as time_index, feature, {_sql_r('y')} as value from g",
    "ekf": f"with recursive {panels.E_SQL}{_SERIES}{_FORWARD} select observation, t as time_index, feature, {_sql_r('m')} as value from k",
    "rts": f"with recursive {panels.E_SQL}{_SERIES}{_FORWARD}{_BACKWARD} select observation, t as time_index, feature, {_sql_r('y')} as value from b",
    "loess": f"with {panels.E_SQL}{_SERIES}{_TRICUBE} select observation, t as time_index, feature, {_sql_r('case when s0 * s2 - s1 * s1 > 1e-9 then (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) else t0 / s0 end')} as value from q",
    "savgol": f"with {panels.E_SQL}{_SERIES}{_QUADRATIC} select observation, t as time_index, feature, "
    + _sql_r("(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))")
    + " as value from q",
    # both segments have three layers, so one second difference d: (I + d d')^-1 = I - d d' / (1 + d'd)
    "spline": f"with {panels.E_SQL}{_SERIES}, c3 as (select *, case when t - min(t) over w = 1 then -2 else 1 end as d from s window w as (partition by seg)) "
    f"select observation, t as time_index, feature, {_sql_r('v - d * sum(d * v) over (partition by observation, feature, seg) / 7.0')} as value from c3",
}


def _smooth_query(method: str):
    breaks = [panels.E_ONSET]

    @_query(f"smooth_{method}", _SMOOTH_SQL[method])
    def run(spark, d):
        return _cells(smooth.smooth(_clr_cells(spark, d), panels.E_LAYERS, method, breaks))


for _m in ("moving_average", "gaussian", "loess", "savgol", "spline", "ekf", "rts", "ewma"):
    _smooth_query(_m)


_NB = f""", x as (select observation, feature, time_index as t, raw as x, sum(raw) over (partition by observation, time_index) as lib from p),
z as (select observation, feature, t, lib, ln((x + 0.5) / lib) as z, 0.1::double as v from x where t = 1 union all
  select observation, feature, t, lib, z + (v + 0.1) * mean / s * (x - mean), (1 - (v + 0.1) * mean / s * mean) * (v + 0.1)
  from (select *, mean * mean * (v + 0.1) + mean + mean * mean as s
    from (select x.*, z.z, z.v, x.lib * exp(greatest(z.z, -16)) as mean from z join x on x.observation = z.observation and x.feature = z.feature and x.t = z.t + 1)))"""
_NB_BACK = f""", b as (select observation, feature, t, lib, z as y from z where t = {panels.E_LAYERS} union all
  select z.observation, z.feature, z.t, z.lib, z.z + z.v / greatest(z.v + 0.1, 1e-30) * (b.y - z.z) from b join z on z.observation = b.observation and z.feature = b.feature and z.t = b.t - 1)"""
_NB_SQL = {
    "ekf": f"with recursive {panels.E_SQL}{_NB} select observation, t as time_index, feature, {_sql_r('lib * exp(greatest(z, -16))')} as value from z",
    "rts": f"with recursive {panels.E_SQL}{_NB}{_NB_BACK} select observation, t as time_index, feature, {_sql_r('lib * exp(greatest(y, -16))')} as value from b",
}


def _nb_query(name: str, method: str, hierarchical: bool):
    @_query(name, None if hierarchical else _NB_SQL[method])
    def run(spark, d):
        counts = panels.e_counts(spark, d).withColumnRenamed("raw", "abundance_value")
        return _cells(smooth_nb.smooth_nb(counts, panels.E_LAYERS, method, hierarchical=hierarchical))


_nb_query("nb_ekf", "ekf", False)
_nb_query("nb_rts", "rts", False)
_nb_query("nb_em", "rts", True)

# --------------------------------------------------------------------------- #
# effects
# --------------------------------------------------------------------------- #
_MEANS = ("mean_pre_treated", "mean_post_treated", "mean_pre_control", "mean_post_control")
_NUMBERS = ("estimate", "standard_error", "statistic", *_MEANS, "effect_range")


def clr_design(spark: SparkSession, d: str) -> causal.Design:
    p = panels.e_panel(spark, d)
    return causal.design(p.with_values(preprocess.normalize(p.long, "clr")), "treat")


def _effects(df: DataFrame) -> DataFrame:
    return df.select("feature", "method", "n_treated", "n_control", *[_r(c).alias(c) for c in _NUMBERS])


def _path(df: DataFrame) -> DataFrame:
    return df.select("feature", "time_index", "relative_time", "method", *[_r(c).alias(c) for c in ("estimate", "standard_error", "statistic")])


_Y = f"""{_Z}{_CLR}, y as (select observation, feature, time_index as t, treated, post, c as v from c),
u as (select feature, observation, treated, avg(v) filter (not post) as pre, avg(v) filter (post) as post, avg(v) filter (post) - avg(v) filter (not post) as delta from y group by all),
m as (select feature, avg(pre) filter (treated) as mean_pre_treated, avg(post) filter (treated) as mean_post_treated, avg(pre) filter (not treated) as mean_pre_control, avg(post) filter (not treated) as mean_post_control,
  var_samp(delta) filter (treated) as vt, var_samp(delta) filter (not treated) as vc, count(*) filter (treated) as n1, count(*) filter (not treated) as n0 from u group by feature),
g as (select feature, t, avg(v) filter (treated) as a1, avg(v) filter (not treated) as a0, var_samp(v) filter (treated) as v1, var_samp(v) filter (not treated) as v0 from y group by all),
r as (select feature, max(a1 - a0) - min(a1 - a0) as effect_range from g group by feature)"""


def _effects_sql(method: str, ctes: str, estimate: str, se: str, source: str, spread: str = "effect_range") -> str:
    cols = ", ".join(f"{_sql_r(c)} as {c}" for c in _MEANS)
    return (
        f"with {panels.E_SQL}{_Y}{ctes} select feature, '{method}' as method, n1::integer as n_treated, n0::integer as n_control, {_sql_r(estimate)} as estimate, {_sql_r(se)} as standard_error, "
        f"{_sql_r(f'({estimate}) / ({se})')} as statistic, {cols}, {_sql_r(spread)} as effect_range from {source}"
    )


_DID = "(mean_post_treated - mean_pre_treated) - (mean_post_control - mean_pre_control)"


@_query("did_effects", _effects_sql("did", "", _DID, "sqrt(vt / n1 + vc / n0)", "m join r using (feature)"))
def did_effects(spark, d):
    return _effects(causal.did(clr_design(spark, d), inference=False)[0])


@_query(
    "did_time_path",
    f"with {panels.E_SQL}{_Y} select feature, t as time_index, t - {panels.E_ONSET} as relative_time, 'did' as method, {_sql_r('a1 - a0')} as estimate, {_sql_r('sqrt(v1 / n1 + v0 / n0)')} as standard_error, "
    f"{_sql_r('(a1 - a0) / sqrt(v1 / n1 + v0 / n0)')} as statistic from g join m using (feature)",
)
def did_time_path(spark, d):
    return _path(causal.did(clr_design(spark, d), inference=False)[1])


_OLS = """, dm as (select feature, v - avg(v) over (partition by feature, observation) - avg(v) over (partition by feature, t) + avg(v) over (partition by feature) as yy,
  z - avg(z) over (partition by feature, observation) - avg(z) over (partition by feature, t) + avg(z) over (partition by feature) as dd from (select *, (treated and post)::integer::double as z from y)),
b as (select feature, sum(dd * yy) / sum(dd * dd) as beta, sum(dd * dd) as d2 from dm group by feature),
q as (select feature, any_value(beta) as beta, any_value(d2) as d2, sum((yy - beta * dd) ^ 2) as rss from dm join b using (feature) group by feature),
k as (select count(distinct observation) as n, count(distinct t) as nt from y)"""


@_query("pooled_effects", _effects_sql("pooled_ols", _OLS, "beta", "sqrt(rss / (n * nt - (n + nt - 1) - 1) / d2)", "m join r using (feature) join q using (feature) cross join k"))
def pooled_effects(spark, d):
    return _effects(causal.pooled_ols(clr_design(spark, d), inference=False)[0])


_EVENT = f""", e as (select feature, a1 - a0 as base from g where t = {panels.E_ONSET - 1}),
rs as (select feature, sum(res * res) as rss from (select feature, v - avg(v) over (partition by feature, observation) - avg(v) over (partition by feature, treated, t) + avg(v) over (partition by feature, treated) as res from y) group by feature),
k as (select count(distinct observation) as n, count(distinct t) as nt from y),
ep as (select feature, t, a1 - a0 - base as beta, sqrt(2 * (1.0 / n1 + 1.0 / n0) * rss / (n * nt - (n + nt - 1) - (nt - 1))) as se
  from g join e using (feature) join rs using (feature) join m using (feature) cross join k where t <> {panels.E_ONSET - 1})"""


@_query(
    "event_path",
    f"with {panels.E_SQL}{_Y}{_EVENT} select feature, t as time_index, t - {panels.E_ONSET} as relative_time, 'event_study' as method, {_sql_r('beta')} as estimate, {_sql_r('se')} as standard_error, {_sql_r('beta / se')} as statistic from ep",
)
def event_path(spark, d):
    return _path(causal.event_study(clr_design(spark, d), inference=False)[1])


_EVENT_HEAD = f", h as (select feature, avg(beta) filter (t >= {panels.E_ONSET}) as est, sqrt(avg(se * se) filter (t >= {panels.E_ONSET})) as hse, max(beta) - min(beta) as spread from ep group by feature)"


@_query("event_effects", _effects_sql("event_study", f"{_EVENT}{_EVENT_HEAD}", "est", "hse", "m join h using (feature)", "spread"))
def event_effects(spark, d):
    return _effects(causal.event_study(clr_design(spark, d), inference=False)[0])


_BH_SQL = f"""with p as (select p_brand as g, p_partkey, ((p_partkey * 7919) % 997)::double / 1000 as p_value from part),
    k as (select *, count(*) over (partition by g order by p_value) as rk, count(*) over (partition by g) as m from p)
    select g, p_partkey, {_sql_r('p_value')} as p_value, {_sql_r('least(1.0, min(p_value * m / rk) over (partition by g order by p_value desc))')} as fdr from k"""


def _bh_query(name: str, adjust):
    @_query(name, _BH_SQL)
    def run(spark, d):
        p = ((F.col("p_partkey") * 7919) % 997).cast("double") / 1000
        out = adjust(panels.table(spark, d, "part").select(F.col("p_brand").alias("g"), "p_partkey", p.alias("p_value")), by=("g",))
        return out.select("g", "p_partkey", _r("p_value").alias("p_value"), _r("fdr").alias("fdr"))


_bh_query("bh_fdr", bh_adjust)
_bh_query("bh_fdr_large", bh_adjust_large)


# Two-sided normal p-value by the positive series of erf; beyond z = 6 it is 0 in the digits compared.
_TERMS = "list_sum(list_transform(range(0, 200), lambda n: exp(n * ln(4.0) + lgamma(n + 1) + (2 * n + 1) * ln(z) - lgamma(2 * n + 2))))"
_P = f"case when z is null then null when z > 6 then 0.0 when z = 0 then 1.0 else greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-z * z) * {_TERMS}) end"


def _inference_sql(method: str, ctes: str, estimate: str, se: str, source: str, spread: str = "effect_range") -> str:
    numbers = (*_NUMBERS, "p_value", "fdr")
    return (
        f"with {panels.E_SQL}{_Y}{ctes}, i as (select feature, n1::integer as n_treated, n0::integer as n_control, ({estimate})::double as estimate, ({se})::double as standard_error, "
        f"({estimate}) / nullif({se}, 0) as statistic, {', '.join(_MEANS)}, {spread} as effect_range from {source}), "
        f"iz as (select *, abs(statistic) / sqrt(2.0) as z from i), ip as (select *, {_P} as p_value from iz), "
        "ir as (select *, count(p_value) over (order by p_value) as rk, count(p_value) over () as m from ip), "
        "io as (select *, case when p_value is not null then least(1.0, min(p_value * m / rk) over (order by p_value desc)) end as fdr from ir) "
        f"select feature, '{method}' as method, n_treated, n_control, {', '.join(f'{_sql_r(c)} as {c}' for c in numbers)} from io"
    )


def _estimate(name: str, sql: str | None = None, **spec):
    @_query(name, sql)
    def run(spark, d):
        p = panels.e_panel(spark, d)
        p = p.with_values(preprocess.normalize(p.long, "clr"))
        effects = causal.estimate("abundance ~ group | unit + time", p, **spec).effects
        return effects.withColumns({c: _r(c) for c in (*_NUMBERS, "p_value", "fdr")})


_estimate("did_inference", _inference_sql("did", "", _DID, "sqrt(vt / n1 + vc / n0)", "m join r using (feature)"), method="did")
_estimate(
    "pooled_inference",
    _inference_sql("pooled_ols", _OLS, "beta", "sqrt(rss / (n * nt - (n + nt - 1) - 1) / d2)", "m join r using (feature) join q using (feature) cross join k"),
    method="pooled_ols",
)
_estimate("event_inference", _inference_sql("event_study", f"{_EVENT}{_EVENT_HEAD}", "est", "hse", "m join h using (feature)", "spread"), method="event_study")
_estimate("did_bootstrap", method="did", bootstrap=True)


def _b_design(spark, d) -> causal.Design:
    p = panels.b_panel(spark, d)
    return causal.design(p.with_values(preprocess.normalize(p.long, "clr")), "treat")


@_query("scm_simplex")
def scm_simplex(spark, d):
    return scm.synthetic_control(_b_design(spark, d), "simplex", True)[0]


@_query("scm_nnls")
def scm_nnls(spark, d):
    return scm.synthetic_control(_b_design(spark, d), "nnls", False)[0]


_WEIGHT_SQL = f"with {panels.B_SQL}, n as (select printf('nation_%02d', n_nationkey) as observation, n_regionkey = 1 as treated from nation), c as (select distinct observation, feature from p) "


def scm_conditions(d: causal.Design, weights: DataFrame, constraint: str, offset: bool) -> DataFrame:
    """Per (feature, treated unit): do the weights meet the conditions of an optimum?

    From the weights and the layers before the onset alone: signs, the sum on the simplex, and
    slopes of the squared error that are equal where a weight is positive and not lower elsewhere.
    """
    pre = d.rows.where(F.col("time_index") < d.t0).select("feature", "observation", "time_index", "value")
    if offset:
        pre = pre.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("feature", "observation")))
    x = pre.select("feature", F.col("observation").alias("donor_unit"), "time_index", F.col("value").alias("x"))
    u = pre.select("feature", F.col("observation").alias("treated_unit"), "time_index", F.col("value").alias("u"))
    both = weights.join(x, ["feature", "donor_unit"])
    made = both.groupBy("feature", "treated_unit", "time_index").agg(F.sum(F.col("weight") * F.col("x")).alias("made"))
    miss = made.join(u, ["feature", "treated_unit", "time_index"]).select("feature", "treated_unit", "time_index", (F.col("made") - F.col("u")).alias("r"))
    slopes = both.join(miss, ["feature", "treated_unit", "time_index"]).groupBy("feature", "treated_unit", "donor_unit").agg(F.first("weight").alias("w"), F.sum(F.col("x") * F.col("r")).alias("s"))
    level = F.sum(F.col("w") * F.col("s")).over(Window.partitionBy("feature", "treated_unit")) if constraint == "simplex" else F.lit(0.0)
    slopes = slopes.withColumn("s", F.col("s") - level)
    sums = (F.abs(F.sum("w") - 1) < 1e-9) if constraint == "simplex" else F.lit(True)
    met = sums & (F.min("w") >= 0) & (F.min("s") > -1e-7) & (F.max(F.abs(F.col("w") * F.col("s"))) < 1e-7)
    return slopes.groupBy("feature", "treated_unit").agg(F.count(F.lit(1)).alias("n_donors"), met.alias("optimal"))


def _conditions_query(name: str, constraint: str, offset: bool):
    sql = _WEIGHT_SQL + (
        "select c.feature, c.observation as treated_unit, (select count(*) from n where not treated and observation in (select observation from c)) as n_donors, true as optimal "
        "from c join n using (observation) where treated"
    )

    @_query(name, sql)
    def run(spark, d):
        dsn = _b_design(spark, d)
        return scm_conditions(dsn, scm.synthetic_control(dsn, constraint, offset)[2], constraint, offset)


_conditions_query("scm_simplex_weights", "simplex", True)
_conditions_query("scm_nnls_weights", "nnls", False)
_conditions_query("scm_nnls_offset_weights", "nnls", True)


@_query("scm_path")
def scm_path(spark, d):
    return _path(scm.synthetic_control(_b_design(spark, d))[1])


@_query("scm_pre_fit")
def scm_pre_fit(spark, d):
    dsn = _b_design(spark, d)
    return scm.pre_fit(dsn, scm.synthetic_control(dsn)[2], True)


@_query("scm_placebo")
def scm_placebo(spark, d):
    dsn = _b_design(spark, d)
    return inference.placebo(dsn, scm.synthetic_control(dsn)[0])


# --------------------------------------------------------------------------- #
# archive, simulation, metrics
# --------------------------------------------------------------------------- #
@_query("archive_round_trip", f"with {panels.E_SQL}{_T_SQL} select * replace ({_sql_r('abundance_value')} as abundance_value) from t")
def archive_round_trip(spark, d):
    path = archive.write_panel_archive(panels.e_table(spark, d), "events", "v1", f"{shared_folder(spark)}/panelweave-archives")
    return archive.read_panel_table(spark, path).withColumn("abundance_value", _r("abundance_value"))


@_query("simulate_probe")
def simulate_probe(spark, d):
    return simulate.probe(simulate.generate(spark))


def simulated_effects(spark: SparkSession, names: list[str], replicates: int) -> DataFrame:
    """DiD on clr values of every (dataset, replicate) in one plan."""
    long = simulate.generate(spark, names, replicates)
    by = ("dataset", "rep")
    cells = preprocess.normalize(long.withColumnRenamed("raw", "abundance_value"), "clr", keys=(*by, "observation", "time_index"))
    x, post = F.col("abundance_value"), F.col("time_index") >= F.col("t0")
    unit = cells.groupBy(*by, "feature", "observation", "is_treated").agg((F.avg(F.when(post, x)) - F.avg(F.when(~post, x))).alias("delta"))
    t = F.col("is_treated")
    out = unit.groupBy(*by, "feature").agg(
        (F.avg(F.when(t, F.col("delta"))) - F.avg(F.when(~t, F.col("delta")))).alias("estimate"),
        F.sqrt(F.var_samp(F.when(t, F.col("delta"))) / F.count_if(t) + F.var_samp(F.when(~t, F.col("delta"))) / F.count_if(~t)).alias("standard_error"),
    )
    return bh_adjust(causal.with_statistic(out), by=by).withColumn("method", F.lit("did"))


@_query("simulate_metrics")
def simulate_metrics(spark, d):
    return metrics.summarize(simulated_effects(spark, list(simulate.SCENARIOS), 30), simulate.truth(spark))


@_query(
    "group_label_counts",
    f"with {panels.E_SQL}{_T_SQL} select label, time_identifier, count(distinct observation) as n_observations, count(*) as n_cells from t group by all",
)
def group_label_counts(spark, d):
    return panels.e_table(spark, d).groupBy("label", "time_identifier").agg(F.count_distinct("observation").alias("n_observations"), F.count(F.lit(1)).alias("n_cells"))


@_query(
    "intervention_flag",
    f"with {panels.E_SQL}{_T_SQL}, l as (select distinct time_identifier, elapsed_time, is_intervention from t) "
    "select time_identifier, is_intervention, coalesce(is_intervention and not lag(is_intervention) over (order by elapsed_time), false) as is_onset from l",
)
def intervention_flag(spark, d):
    layers = panel.time_meta(panels.e_table(spark, d))
    before = F.lag("is_intervention_timepoint").over(Window.orderBy("elapsed_time"))
    on = F.col("is_intervention_timepoint")
    return layers.select("time_identifier", on.alias("is_intervention"), F.coalesce(on & ~before, F.lit(False)).alias("is_onset"))


@_query("simulate_truth")
def simulate_truth(spark, d):
    return simulate.truth_table(spark)


def _grid_query(name: str, configs: dict[str, experiments.Config], method: str, bootstrap: bool = False):
    @_query(name)
    def run(spark, d):
        effects = experiments.run(spark, configs, ["A2"], 1, method, bootstrap)
        truth = simulate.truth(spark, ["A2"], 1)
        return metrics.summarize_bootstrap(effects, truth, ("dataset", "config")) if bootstrap else metrics.summarize(effects, truth, ("dataset", "config"))


_grid_query("ablation_grid", experiments.ABLATIONS, "scm")
_grid_query("sensitivity_zero", experiments.SENSITIVITY["zero"], "scm")
_grid_query("sensitivity_normalize", experiments.SENSITIVITY["normalize"], "scm")
_grid_query("sensitivity_filter", experiments.SENSITIVITY["filter"], "scm")
_grid_query("sensitivity_band", experiments.SENSITIVITY["band"], "scm")
_grid_query("sensitivity_bootstrap", experiments.SENSITIVITY["bootstrap"], "did", bootstrap=True)
