"""Checks that a table, metadata or archive is a valid panel.

Each check runs as one small aggregation on the cluster; only counts and at
most ``REPORT`` offending keys reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .panel import KEY, MAX_GROUPS, MAX_LAYERS, REQUIRED, PanelError, observation_meta, time_meta

REPORT = 10
SUM_TOLERANCE = 1e-6
DELTA_TOLERANCE = 1e-8
TIME_ID = re.compile(r"^time_[0-9]{3}$")


def _report(df: DataFrame, what: str, columns: tuple[str, ...]) -> None:
    """Raise with the first offending keys and their number."""
    head = df.select(*columns).orderBy(*columns).limit(REPORT).collect()
    if head:
        shown = "; ".join(", ".join(map(str, r)) for r in head)
        raise PanelError(f"{what}: {shown} ({df.count()} in all)")


def check_columns(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise PanelError(f"missing columns: {', '.join(missing)}")
    for c in ("elapsed_time", "abundance_value"):
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise PanelError(f"column {c} must be numeric")
    if not isinstance(df.schema["is_intervention"].dataType, T.BooleanType):
        raise PanelError("column is_intervention must be boolean")


def check_missing(df: DataFrame) -> None:
    numeric = ("elapsed_time", "abundance_value")
    bad = [F.count_if(F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False))).alias(c) for c in REQUIRED]
    counts = df.agg(*bad).first().asDict()
    found = [f"{c} ({n})" for c, n in counts.items() if n]
    if found:
        raise PanelError(f"missing values in {', '.join(found)}")


def check_unique(df: DataFrame) -> None:
    _report(df.groupBy(*KEY).count().where("count > 1"), "repeated keys", KEY)


def check_labels(df: DataFrame) -> None:
    n = df.agg(F.count_distinct("label")).first()[0]
    if n > MAX_GROUPS:
        raise PanelError(f"{n} labels; at most {MAX_GROUPS} are allowed")


def balance(df: DataFrame) -> DataFrame:
    """One row: rows, axis sizes, expected rows and the two pair counts.

    Two aggregations reduce the cells to samples and to series; the axes are
    counted on those.
    """
    samples = df.groupBy("observation", "time_identifier").agg(F.count(F.lit(1)).alias("n"))
    series = df.select("observation", "feature").distinct()
    sizes = samples.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_distinct("observation").alias("n_observations"),
        F.count_distinct("time_identifier").alias("n_layers"),
        F.count("observation").alias("n_samples"),
    )
    both = sizes.crossJoin(series.agg(F.count_distinct("feature").alias("n_features"), F.count("feature").alias("n_series")))
    sizes = both.select("n_rows", "n_observations", "n_features", "n_layers", "n_samples", "n_series")
    return sizes.withColumn("n_expected", F.col("n_observations") * F.col("n_features") * F.col("n_layers"))


def check_balance(df: DataFrame) -> None:
    b = balance(df).first()
    if b.n_rows != b.n_expected or b.n_samples != b.n_observations * b.n_layers or b.n_series != b.n_observations * b.n_features:
        raise PanelError(f"not balanced: {b.n_rows} rows, {b.n_expected} expected; {b.n_samples} samples; {b.n_series} series")


def sample_sums(df: DataFrame) -> DataFrame:
    return df.groupBy("observation", "time_identifier").agg(F.sum("abundance_value").alias("total"))


def check_composition(df: DataFrame) -> None:
    off = sample_sums(df).where(F.abs(F.col("total") - 1) > SUM_TOLERANCE)
    _report(off, "samples that do not sum to 1", ("observation", "time_identifier", "total"))


def check_time_ids(layers: DataFrame) -> None:
    ids = [r[0] for r in layers.select("time_identifier").limit(MAX_LAYERS + 1).collect()]
    if len(ids) > MAX_LAYERS:
        raise PanelError(f"more than {MAX_LAYERS} layers")
    bad = [x for x in ids if not TIME_ID.match(x or "")]
    if bad:
        raise PanelError(f"layer names must look like time_001: {', '.join(map(str, bad[:REPORT]))}")


def check_intervention(layers: DataFrame) -> None:
    """First layer untreated, flag never falls; an all-false flag is legal."""
    w = Window.orderBy("elapsed_time", "time_identifier")
    rows = layers.select(
        F.row_number().over(w).alias("i"), F.col("is_intervention_timepoint").alias("on"), F.lag("is_intervention_timepoint").over(w).alias("before")
    )
    bad = rows.agg(F.count_if((F.col("i") == 1) & F.col("on")).alias("first"), F.count_if(F.col("before") & ~F.col("on")).alias("falls")).first()
    if bad["first"]:
        raise PanelError("the earliest layer is an intervention layer")
    if bad["falls"]:
        raise PanelError("the intervention flag falls back to false")


def check_delta_t(layers: DataFrame) -> None:
    w = Window.orderBy("elapsed_time", "time_identifier")
    want = F.coalesce(F.col("elapsed_time") - F.lag("elapsed_time").over(w), F.lit(0.0))
    off = layers.withColumn("want", want).where(F.abs(F.col("delta_t") - F.col("want")) > DELTA_TOLERANCE)
    _report(off, "delta_t does not follow elapsed_time", ("time_identifier", "delta_t", "want"))


def check_metadata(observations: DataFrame, layers: DataFrame) -> None:
    for df, key, what in ((observations, "observation_id", "observation"), (layers, "time_identifier", "time")):
        nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
        r = df.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(key).alias("_d"), *nulls).first().asDict()
        n, d = r.pop("_n"), r.pop("_d")
        if not n:
            raise PanelError(f"{what} metadata is empty")
        if any(r.values()):
            raise PanelError(f"{what} metadata has missing values")
        if d != n:
            raise PanelError(f"{what} metadata has repeated ids")


def sample_facts(df: DataFrame) -> DataFrame:
    """Per (observation, layer): rows, total, incomplete rows, a mark of its feature set.

    The mark is two xors of independent 64-bit hashes of the features.
    """
    incomplete = F.lit(False)
    for c in REQUIRED:
        incomplete = incomplete | F.col(c).isNull()
    for c in ("elapsed_time", "abundance_value"):
        incomplete = incomplete | F.isnan(F.col(c).cast("double"))
    return df.groupBy("observation", "time_identifier").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("abundance_value").alias("total"),
        F.count_if(incomplete).alias("bad"),
        F.bit_xor(F.xxhash64("feature")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "feature")).alias("y"),
        F.min("label").alias("label_low"),
        F.max("label").alias("label_high"),
    )


def is_sound(df: DataFrame, composition: bool = True) -> bool:
    """Complete, balanced, unique, closed, few labels - in one pass over the table.

    Every sample must hold each feature once: as many rows as there are
    features and the same marks as the set of all features.
    """
    facts = sample_facts(df)
    r = facts.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("observation").alias("observations"),
        F.count_distinct("time_identifier").alias("layers"),
        F.sum("bad").alias("bad"),
        F.max(F.abs(F.col("total") - 1)).alias("off"),
        *(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "x", "y") for f in (F.min, F.max)),
    ).first()
    names = df.select("feature").distinct()
    d = names.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("feature")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "feature")).alias("y")).first()
    same = all(r[f"{e}_{c}"] == d[c] for c in ("n", "x", "y") for e in ("min", "max"))
    ends = facts.select(F.explode(F.array("label_low", "label_high")).alias("label")).where("label is not null")
    labels = len(ends.distinct().limit(MAX_GROUPS + 1).collect()) <= MAX_GROUPS
    closed = not composition or (r.off is not None and r.off <= SUM_TOLERANCE)
    return bool(r.samples) and not r.bad and same and labels and closed and r.samples == r.observations * r.layers


def validate_long(df: DataFrame, composition: bool = True) -> None:
    """Every check on a long table; raises :class:`PanelError`.

    One pass decides; only where it finds something do the single checks run,
    to name what and where.
    """
    check_columns(df)
    if not is_sound(df, composition):
        check_missing(df)
        check_unique(df)
        check_labels(df)
        check_balance(df)
        if composition:
            check_composition(df)
        raise PanelError("the table is not a balanced panel")
    layers = time_meta(df)
    check_time_ids(layers)
    check_intervention(layers)
    check_metadata(observation_meta(df), layers)
