"""The panel: a balanced long table of (observation, time layer, feature).

The long DataFrame is the one representation every operator works on; arrays
and wide tables are converted at the boundary.  ``time_index`` follows elapsed
time (1-based) and ``feature_index`` the feature's name (1-based), so no result
depends on row order.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = ("observation", "time_identifier", "elapsed_time", "feature", "abundance_value", "label", "is_intervention")
KEY = ("observation", "time_identifier", "feature")
LONG_SCHEMA = T.StructType(
    [
        T.StructField("observation", T.StringType(), False),
        T.StructField("time_identifier", T.StringType(), False),
        T.StructField("elapsed_time", T.DoubleType(), False),
        T.StructField("feature", T.StringType(), False),
        T.StructField("abundance_value", T.DoubleType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("is_intervention", T.BooleanType(), False),
    ]
)
MAX_LAYERS = 1000
MAX_GROUPS = 4


class PanelError(ValueError):
    """Input that is not a valid panel."""


@dataclasses.dataclass(frozen=True)
class Panel:
    """Long rows (observation, time_index, feature, abundance_value) and metadata.

    ``observation_meta``: observation_id, label.  ``time_meta``:
    time_identifier, elapsed_time, delta_t, is_intervention_timepoint,
    time_index.  ``levels`` is the order of the labels.
    """

    long: DataFrame
    observation_meta: DataFrame
    time_meta: DataFrame
    levels: tuple[str, ...] = ()

    def table(self) -> DataFrame:
        """The seven-column long table."""
        return attach_metadata(self.long, self.observation_meta, self.time_meta)

    def with_values(self, long: DataFrame) -> Panel:
        return dataclasses.replace(self, long=long)

    def dims(self) -> tuple[int, int, int]:
        """(observations, features, layers)."""
        n, t = self.observation_meta.count(), self.time_meta.count()
        return n, self.long.select("feature").distinct().count(), t

    def dimnames(self) -> dict[str, DataFrame]:
        return {
            "observation": self.observation_meta.select("observation_id").orderBy("observation_id"),
            "feature": self.long.select("feature").distinct().orderBy("feature"),
            "time_identifier": self.time_meta.orderBy("time_index").select("time_identifier"),
        }

    def summary(self) -> DataFrame:
        """One row: dims, zero share, range, number of groups, onset."""
        onset = F.min(F.when(F.col("is_intervention_timepoint"), F.col("time_index"))).alias("onset")
        return (
            self.long.agg(
                F.count(F.lit(1)).alias("n_cells"),
                F.avg((F.col("abundance_value") == 0).cast("double")).alias("zero_share"),
                F.min("abundance_value").alias("min_value"),
                F.max("abundance_value").alias("max_value"),
                F.count_distinct("feature").alias("n_features"),
            )
            .crossJoin(self.observation_meta.agg(F.count(F.lit(1)).alias("n_observations"), F.count_distinct("label").alias("n_groups")))
            .crossJoin(self.time_meta.agg(F.count(F.lit(1)).alias("n_layers"), onset))
        )


def select_panel_columns(df: DataFrame) -> DataFrame:
    """The seven columns in their fixed order."""
    return df.select(*REQUIRED)


def sort_panel_table(df: DataFrame) -> DataFrame:
    """Canonical order, for output only."""
    return select_panel_columns(df).orderBy("observation", "elapsed_time", "time_identifier", "feature")


def canonical_position(df: DataFrame) -> DataFrame:
    """The whole table with ``position``, each row's place in the canonical order, from 1.

    Without a global sort: windows over the observations' sizes, dealt by the
    head of their names, give each observation's first place.
    """
    rows = select_panel_columns(df)
    sizes = rows.groupBy("observation").agg(F.count(F.lit(1)).alias("_n")).withColumn("_head", F.substring("observation", 1, 3))
    heads = sizes.groupBy("_head").agg(F.sum("_n").alias("_m"))
    above = F.coalesce(F.sum("_m").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("_head").orderBy("observation").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.join(heads.select("_head", above.alias("_above")), "_head")
    first = first.select("observation", (F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_first"))
    own = F.row_number().over(Window.partitionBy("observation").orderBy("elapsed_time", "time_identifier", "feature"))
    return rows.join(first, "observation").select(*REQUIRED, (F.col("_first") + own).alias("position"))


def time_identifier(index: Column | int) -> Column:
    return F.format_string("time_%03d", index if isinstance(index, Column) else F.lit(index))


def observation_meta(df: DataFrame) -> DataFrame:
    """observation_id, label; the label of the earliest row wins."""
    first = F.min_by("label", F.struct("elapsed_time", "time_identifier", "feature")).alias("label")
    return df.groupBy(F.col("observation").alias("observation_id")).agg(first)


def time_meta(df: DataFrame) -> DataFrame:
    """One row a layer with ``delta_t`` and the 1-based ``time_index``."""
    layers = df.groupBy("time_identifier").agg(
        F.min("elapsed_time").alias("elapsed_time"), F.max("is_intervention").alias("is_intervention_timepoint")
    )
    return index_layers(layers)


def index_layers(layers: DataFrame) -> DataFrame:
    """``delta_t`` and ``time_index`` in order of elapsed time (<= 1000 rows)."""
    w = Window.orderBy("elapsed_time", "time_identifier")
    gap = F.col("elapsed_time") - F.lag("elapsed_time", 1).over(w)
    return layers.select(
        "time_identifier",
        "elapsed_time",
        F.coalesce(gap, F.lit(0.0)).alias("delta_t"),
        "is_intervention_timepoint",
        F.row_number().over(w).alias("time_index"),
    )


def feature_index(long: DataFrame) -> DataFrame:
    """(feature, feature_index): 1-based rank of the name, exact and distributed.

    Names are counted in buckets of their first characters, so only the bucket
    sizes pass through one task, not the names.
    """
    names = long.select("feature").distinct().withColumn("_b", F.substring("feature", 1, 2))
    sizes = names.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("feature"))
    return names.join(before, "_b").select("feature", (F.col("_before") + rank).alias("feature_index"))


def attach_metadata(long: DataFrame, observations: DataFrame, layers: DataFrame) -> DataFrame:
    """Long rows with label, layer name, elapsed time and flag.

    Layers are few by contract (<= 1000) and broadcast; observations grow with
    the data, so how that side is joined is left to the optimizer.
    """
    obs = observations.select(F.col("observation_id").alias("observation"), "label")
    lay = layers.select("time_index", "time_identifier", "elapsed_time", F.col("is_intervention_timepoint").alias("is_intervention"))
    return select_panel_columns(long.join(F.broadcast(lay), "time_index").join(obs, "observation"))


def unmatched_keys(long: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of the long table that the metadata does not know."""
    known = observations.select(F.col("observation_id").alias("observation"))
    return long.select("observation").distinct().join(known, "observation", "left_anti")


def from_long(df: DataFrame, levels: tuple[str, ...] | None = None, validate: bool = False) -> Panel:
    """A panel from the seven-column long table."""
    if validate:
        from .validate import validate_long

        validate_long(df)
    layers, obs = time_meta(df), observation_meta(df)
    long = df.join(F.broadcast(layers.select("time_identifier", "time_index")), "time_identifier")
    if levels is None:
        found = [r[0] for r in obs.select("label").distinct().limit(MAX_GROUPS + 1).collect()]
        if len(found) > MAX_GROUPS:
            raise PanelError(f"more than {MAX_GROUPS} labels")
        levels = tuple(sorted(found))
    return Panel(long.select("observation", "time_index", "feature", "abundance_value"), obs, layers, tuple(levels))


def from_array(spark: SparkSession, array: np.ndarray, observations: list[tuple[str, str]], features: list[str], layers: list[tuple[str, float, bool]]) -> Panel:
    """A panel from a dense (observation, feature, layer) array held by the driver."""
    if array.ndim != 3 or array.shape != (len(observations), len(features), len(layers)):
        raise PanelError("the array's shape does not match its names")
    if not np.isfinite(array).all():
        raise PanelError("the array has missing values")
    n, m, t = array.shape
    cells = {
        "observation": np.repeat([o for o, _ in observations], m * t),
        "time_identifier": np.tile([x[0] for x in layers], n * m),
        "elapsed_time": np.tile([float(x[1]) for x in layers], n * m),
        "feature": np.tile(np.repeat(features, t), n),
        "abundance_value": np.ascontiguousarray(array, float).ravel(),
        "label": np.repeat([x for _, x in observations], m * t),
        "is_intervention": np.tile([bool(x[2]) for x in layers], n * m),
    }
    table = pa.table({k: pa.array(v) for k, v in cells.items()})
    return from_long(spark.createDataFrame(table, LONG_SCHEMA), tuple(dict.fromkeys(lab for _, lab in observations)))


def as_panel(data: Panel | DataFrame | np.ndarray, observation_meta: DataFrame | None = None, time_meta: DataFrame | None = None, features: list[str] | None = None) -> Panel:
    """A panel from a panel, a long table, or a dense array with its metadata.

    For an array the metadata tables (rows in the array's order, kept by an Arrow
    round trip) need observation_id and label; time_identifier, elapsed_time and
    is_intervention_timepoint.
    """
    if isinstance(data, Panel):
        return data
    if isinstance(data, DataFrame):
        from .validate import validate_long

        validate_long(data, composition=False)
        return from_long(data)
    if not isinstance(data, np.ndarray) or data.ndim != 3:
        raise PanelError("data must be a panel, a long table or a three-dimensional array")
    if observation_meta is None or time_meta is None:
        raise PanelError("an array needs observation_meta and time_meta")
    obs = [tuple(r) for r in observation_meta.select("observation_id", "label").limit(data.shape[0] + 1).collect()]
    layers = [tuple(r) for r in time_meta.select("time_identifier", "elapsed_time", "is_intervention_timepoint").limit(data.shape[2] + 1).collect()]
    names = features or [f"feature_{j + 1:03d}" for j in range(data.shape[1])]
    return from_array(observation_meta.sparkSession, data, obs, names, layers)


def to_array(panel: Panel, max_cells: int = 10_000_000) -> tuple[np.ndarray, list[str], list[str], list[str]]:
    """Dense array and names, for panels of at most ``max_cells`` cells."""
    n, d, t = panel.dims()
    if n * d * t > max_cells:
        raise PanelError(f"{n * d * t} cells are more than max_cells")
    names = {k: [r[0] for r in v.collect()] for k, v in panel.dimnames().items()}
    out = np.full((n, d, t), np.nan)
    cells = panel.long.select("observation", "feature", "time_index", "abundance_value").toArrow()
    at = [pc.index_in(cells.column(k), pa.array(names[k])).to_numpy() for k in ("observation", "feature")]
    out[at[0], at[1], cells.column("time_index").to_numpy() - 1] = cells.column("abundance_value").to_numpy()
    return out, names["observation"], names["feature"], names["time_identifier"]


def to_series(long: DataFrame, value: str = "abundance_value", keys: tuple[str, ...] = ("observation", "feature")) -> DataFrame:
    """One row a series: ``xs``, the values in time order (at most 1000)."""
    ordered = F.array_sort(F.collect_list(F.struct("time_index", F.col(value).alias("x"))))
    return long.groupBy(*keys).agg(ordered.alias("_s")).select(*keys, F.expr("transform(_s, s -> s.x)").alias("xs"))


def from_series(series: DataFrame, value: str = "abundance_value", xs: str = "xs", keys: tuple[str, ...] = ("observation", "feature")) -> DataFrame:
    out = series.select(*keys, F.posexplode(xs).alias("_i", value))
    return out.select(*keys, (F.col("_i") + 1).alias("time_index"), value)


def wide_to_long(wide: DataFrame, id_col: str = "observation_id") -> DataFrame:
    """(observation, feature, abundance_value) from one wide layer."""
    features = [c for c in wide.columns if c != id_col]
    long = wide.unpivot([id_col], features, "feature", "abundance_value")
    return long.select(F.col(id_col).alias("observation"), "feature", F.col("abundance_value").cast("double"))


def long_to_wide(long: DataFrame, features: list[str]) -> DataFrame:
    """One wide row per (observation, time_index); ``features`` names the columns."""
    return long.groupBy("observation", "time_index").pivot("feature", features).agg(F.first("abundance_value"))


def densify(raw: DataFrame, features: DataFrame, value: str = "raw") -> DataFrame:
    """Every feature for each (observation, time_index) present, 0 where absent.

    Layers an observation lacks altogether are not invented.
    """
    cells = raw.groupBy("observation", "time_index", "feature").agg(F.sum(value).cast("double").alias(value))
    present = cells.select("observation", "time_index").distinct()
    grid = present.crossJoin(features.select("feature").distinct())
    return grid.join(cells, ["observation", "time_index", "feature"], "left").na.fill(0.0, [value])


def keep_complete(cells: DataFrame, n_layers: int) -> DataFrame:
    """Only observations with all layers."""
    full = cells.groupBy("observation").agg(F.count_distinct("time_index").alias("_n")).where(F.col("_n") == n_layers)
    return cells.join(full.select("observation"), "observation", "left_semi")


def close(cells: DataFrame, value: str = "raw", out: str = "abundance_value") -> DataFrame:
    """Values divided by their sample's sum; rows of empty samples are null."""
    w = Window.partitionBy("observation", "time_index")
    total = F.sum(value).over(w)
    return cells.withColumn(out, F.col(value) / F.when(total != 0, total)).drop(value)


def time_bins(df: DataFrame, elapsed: str, width: float, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Averages inside fixed-width time bins, only bins common to all observations.

    The result is closed again per (observation, bin).
    """
    binned = df.withColumn("time_index", (F.floor(F.col(elapsed) / width) + 1).cast("int"))
    mean = binned.groupBy("time_index", *keys).agg(F.avg(value).alias("raw"))
    n = mean.select(F.count_distinct("observation").alias("_all"))
    common = mean.groupBy("time_index").agg(F.count_distinct("observation").alias("_n")).crossJoin(n).where("_n = _all")
    return close(mean.join(F.broadcast(common.select("time_index")), "time_index"))
