"""Panels over the driver's tables.

E-panel: users x event types x six five-day layers, shares of event counts;
odd users are treated from layer 4 on.  B-panel: nations x brands x years,
shares of ordered quantity; the nations of region 1 are treated from 1998 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import LONG_SCHEMA, Panel, close, densify, keep_complete, time_identifier

E_LAYERS, E_ONSET, E_WIDTH = 6, 4, 5
B_FIRST_YEAR, B_LAYERS, B_ONSET = 1995, 7, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def e_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(observation, time_index, feature, raw): dense counts, complete users."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    rows = events.select(
        F.col("user_id").cast("string").alias("observation"),
        (F.floor(day / E_WIDTH) + 1).cast("int").alias("time_index"),
        F.col("event_type").alias("feature"),
        F.lit(1.0).alias("raw"),
    ).where(F.col("time_index").between(1, E_LAYERS))
    return keep_complete(densify(rows, rows.select("feature").distinct()), E_LAYERS)


def e_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close(e_counts(spark, sf_dir))


def b_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(orders, li.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", "y", "p_brand")
        .agg(F.sum("l_quantity").alias("raw"))
    )
    rows = rows.select(
        F.format_string("nation_%02d", "c_nationkey").alias("observation"), (F.col("y") - (B_FIRST_YEAR - 1)).cast("int").alias("time_index"), F.col("p_brand").alias("feature"), "raw"
    ).where(F.col("time_index").between(1, B_LAYERS))
    return keep_complete(densify(rows, rows.select("feature").distinct()), B_LAYERS)


def b_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close(b_counts(spark, sf_dir))


def e_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The E-panel as a seven-column long table."""
    cells = e_cells(spark, sf_dir)
    treated = F.col("observation").cast("bigint") % 2 == 1
    return cells.select(
        "observation",
        time_identifier(F.col("time_index")).alias("time_identifier"),
        (F.lit(float(E_WIDTH)) * (F.col("time_index") - 1)).alias("elapsed_time"),
        "feature",
        "abundance_value",
        F.when(treated, "treat").otherwise("ctrl").alias("label"),
        (F.col("time_index") >= E_ONSET).alias("is_intervention"),
    ).select(*LONG_SCHEMA.names)


def b_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = b_cells(spark, sf_dir)
    region = table(spark, sf_dir, "nation").select(F.format_string("nation_%02d", "n_nationkey").alias("observation"), F.when(F.col("n_regionkey") == 1, "treat").otherwise("ctrl").alias("label"))
    return cells.join(region, "observation").select(
        "observation",
        time_identifier(F.col("time_index")).alias("time_identifier"),
        (F.col("time_index") + (B_FIRST_YEAR - 1)).cast("double").alias("elapsed_time"),
        "feature",
        "abundance_value",
        "label",
        (F.col("time_index") >= B_ONSET).alias("is_intervention"),
    )


def _layers(spark: SparkSession, n: int, onset: int, elapsed) -> DataFrame:
    rows = [(f"time_{k:03d}", float(elapsed(k)), 0.0 if k == 1 else float(elapsed(k) - elapsed(k - 1)), k >= onset, k) for k in range(1, n + 1)]
    return spark.createDataFrame(rows, "time_identifier string, elapsed_time double, delta_t double, is_intervention_timepoint boolean, time_index int")


def e_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """The E-panel with its metadata known beforehand: no pass over the cells for it."""
    cells = e_cells(spark, sf_dir)
    label = F.when(F.col("user_id") % 2 == 1, "treat").otherwise("ctrl").alias("label")
    users = table(spark, sf_dir, "events").select("user_id").distinct().select(F.col("user_id").cast("string").alias("observation_id"), label)
    users = users.join(cells.select(F.col("observation").alias("observation_id")).distinct(), "observation_id", "left_semi")
    layers = _layers(spark, E_LAYERS, E_ONSET, lambda k: E_WIDTH * (k - 1))
    return Panel(cells.select("observation", "time_index", "feature", "abundance_value"), users, layers, ("ctrl", "treat"))


def b_panel(spark: SparkSession, sf_dir: str) -> Panel:
    cells = b_cells(spark, sf_dir)
    label = F.when(F.col("n_regionkey") == 1, "treat").otherwise("ctrl").alias("label")
    nations = table(spark, sf_dir, "nation").select(F.format_string("nation_%02d", "n_nationkey").alias("observation_id"), label)
    nations = nations.join(cells.select(F.col("observation").alias("observation_id")).distinct(), "observation_id", "left_semi")
    layers = _layers(spark, B_LAYERS, B_ONSET, lambda k: k + B_FIRST_YEAR - 1)
    return Panel(cells.select("observation", "time_index", "feature", "abundance_value"), nations, layers, ("ctrl", "treat"))


#: The same panels for the SQL side; ``x`` is the share.
E_SQL = f"""
ec as (select user_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) // {E_WIDTH} + 1 as integer) as time_index, event_type as feature, count(*) as n
       from events group by all),
eu as (select user_id from ec where time_index between 1 and {E_LAYERS} group by user_id having count(distinct time_index) = {E_LAYERS}),
ef as (select distinct feature from ec where time_index between 1 and {E_LAYERS}),
et as (select distinct time_index from ec where time_index between 1 and {E_LAYERS}),
er as (select cast(eu.user_id as varchar) as observation, et.time_index, ef.feature, coalesce(ec.n, 0)::double as raw, eu.user_id % 2 = 1 as treated
       from eu cross join et cross join ef left join ec on ec.user_id = eu.user_id and ec.time_index = et.time_index and ec.feature = ef.feature),
p as (select observation, time_index, feature, raw, treated, time_index >= {E_ONSET} as post,
             raw / sum(raw) over (partition by observation, time_index) as x from er)"""
B_SQL = f"""
bc as (select c_nationkey, cast(year(o_orderdate) - {B_FIRST_YEAR - 1} as integer) as time_index, p_brand as feature, sum(l_quantity) as q
       from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey group by all),
bu as (select c_nationkey from bc where time_index between 1 and {B_LAYERS} group by c_nationkey having count(distinct time_index) = {B_LAYERS}),
bf as (select distinct feature from bc where time_index between 1 and {B_LAYERS}),
bt as (select distinct time_index from bc where time_index between 1 and {B_LAYERS}),
br as (select printf('nation_%02d', bu.c_nationkey) as observation, bt.time_index, bf.feature, coalesce(bc.q, 0)::double as raw
       from bu cross join bt cross join bf left join bc on bc.c_nationkey = bu.c_nationkey and bc.time_index = bt.time_index and bc.feature = bf.feature),
p as (select observation, time_index, feature, raw, raw / sum(raw) over (partition by observation, time_index) as x from br)"""
