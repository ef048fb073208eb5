"""Normal tail probabilities, false-discovery adjustment, lossless numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import write_table


def erfc(x: Column) -> Column:
    """Complementary error function of ``x >= 0``, in built-in functions.

    Below 2.5 one minus the series of positive terms
    ``2 x exp(-x^2) / sqrt(pi) * sum (2 x^2)^n / (3 5 .. 2n+1)``, beyond it the
    continued fraction ``exp(-x^2) / sqrt(pi) / (x + 1/2/(x + 2/2/(x + ...)))``.
    """
    front = F.exp(-x * x) / math.sqrt(math.pi)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * x * x / (2.0 * n + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = 1.0 - 2.0 * x * front * F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, add)["total"]
    below = F.aggregate(F.sequence(F.lit(60), F.lit(1)), x, lambda acc, n: x + n / 2.0 / acc)
    return F.when(x < 2.5, series).otherwise(front / below)


def normal_p_value(statistic: Column) -> Column:
    """Two-sided normal p-value; null for null or NaN."""
    z = statistic.cast("double")
    return F.when(~F.isnan(z), erfc(F.abs(z) / math.sqrt(2.0)))


def bh_adjust(df: DataFrame, p: str = "p_value", out: str = "fdr", by: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each ``by`` group; nulls stay null.

    One window per group, meant for one row a feature.  For groups too large
    for a task see :func:`bh_adjust_large`.
    """
    tested = F.col(p).isNotNull()
    w = Window.partitionBy(*[F.col(c) for c in by], tested)
    rank = F.count(F.lit(1)).over(w.orderBy(p).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    raw = df.withColumn("_raw", F.col(p) * F.count(F.lit(1)).over(w) / rank)
    low = F.min("_raw").over(w.orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return raw.withColumn(out, F.when(tested, F.least(F.lit(1.0), low))).drop("_raw")


def bh_adjust_large(df: DataFrame, p: str = "p_value", out: str = "fdr", by: tuple[str, ...] = (), cells_per_decade: int = 64) -> DataFrame:
    """:func:`bh_adjust` for groups of any size.

    Exact and without a global sort: p-values fall into cells of equal width
    on a log scale (at most ``324 * cells_per_decade``); the cells' counts give
    each cell's first rank, ranks and running minima are windows inside a
    cell, and one small window over cells carries the minimum across.  These
    read ``df`` several times: it is written once, as a table in the shared
    folder, so that the estimates it comes from are not made anew each time.
    """
    df, _ = write_table(df, "p-values")
    keys = list(by)
    cell = F.when(F.col(p) > 0, F.floor(F.log10(p) * cells_per_decade)).otherwise(F.lit(-400 * cells_per_decade)).cast("int")
    tested = df.where(F.col(p).isNotNull()).withColumn("_cell", cell)
    over = Window.partitionBy(*keys).orderBy("_cell")
    sizes = tested.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("_m", F.sum("_n").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "_cell")
    ranked = tested.join(sizes, [*keys, "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.rank().over(inside.orderBy(p)) + F.count(F.lit(1)).over(Window.partitionBy(*keys, "_cell", p)) - 1)
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    ranked = ranked.withColumn("_low", F.min("_raw").over(inside.orderBy(p).rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    cells = ranked.groupBy(*keys, "_cell").agg(F.min("_raw").alias("_cell_min"))
    later = cells.withColumn("_later", F.min("_cell_min").over(over.rowsBetween(1, Window.unboundedFollowing))).drop("_cell_min")
    done = ranked.join(later, [*keys, "_cell"]).withColumn(out, F.least(F.lit(1.0), F.least("_low", "_later")))
    done = done.select(*df.columns, out)
    rest = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return done.unionByName(rest)


def format_number(value: float) -> str:
    """Shortest text that reads back to the same double; integers get ``.0``."""
    if not math.isfinite(value):
        raise ValueError("only finite numbers can be written")
    return repr(float(value))
