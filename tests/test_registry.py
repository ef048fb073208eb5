import importlib
import math
import os
import re
import sys

import duckdb
import pytest

from panelweave.operators import causal, preprocess, simulate
from panelweave.plans import panels, registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert got == want


def test_wide_pivot_holds_every_cell(spark):
    cells = {(r.observation, r.time_index, r.feature): r.value for r in registry._cells(panels.e_cells(spark, SF)).collect()}
    wide = registry.QUERIES["wide_pivot"](spark, SF)
    features = wide.columns[2:]
    assert features == sorted({k[2] for k in cells}) and len(features) == 5
    got = {(r.observation, r.time_index, f): r[f] for r in wide.collect() for f in features}
    assert got == cells


def test_canonical_order_is_whole(spark):
    table = panels.e_table(spark, SF)
    rows = registry.QUERIES["canonical_order"](spark, SF).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, table.count() + 1)) and len(rows) > 100
    key = lambda r: (r.observation, r.elapsed_time, r.time_identifier, r.feature)
    assert [key(r) for r in rows] == sorted(map(key, table.collect()))


def test_unmatched_anti_knows_the_whole_table(spark):
    users = {str(r[0]) for r in panels.table(spark, SF, "events").select("user_id").collect()}
    known = {str(r[0]) for r in panels.table(spark, SF, "supplier").select("s_suppkey").collect()}
    got = [r.observation for r in registry.QUERIES["unmatched_anti"](spark, SF).collect()]
    assert sorted(got) == sorted(users - known) and users & known and users - known


def test_did_bootstrap_has_the_default_draws(spark):
    p = panels.e_panel(spark, SF)
    p = p.with_values(preprocess.normalize(p.long, "clr"))
    want = causal.estimate("abundance ~ group | unit + time", p, "did", bootstrap=True, bootstrap_samples=500).effects
    bounds = lambda df: {r.feature: pytest.approx((r.bootstrap_lower, r.bootstrap_upper), rel=1e-9) for r in df.collect()}
    got = {r.feature: (r.bootstrap_lower, r.bootstrap_upper) for r in registry.QUERIES["did_bootstrap"](spark, SF).collect()}
    assert got == bounds(want)


def test_preprocess_pipeline_drops_features(spark):
    every = {r.feature for r in panels.b_cells(spark, SF).select("feature").distinct().collect()}
    kept = {r.feature for r in registry.QUERIES["filter_prevalence"](spark, SF).select("feature").distinct().collect()}
    got = {r.feature for r in registry.QUERIES["preprocess_pipeline"](spark, SF).select("feature").distinct().collect()}
    assert got == kept and got < every


@pytest.mark.parametrize("name", ["simulate_probe", "simulate_truth"])
def test_simulations_have_every_scenario_and_replicate(spark, name):
    got = sorted((r.dataset, r.rep) for r in registry.QUERIES[name](spark, SF).select("dataset", "rep").collect())
    assert got == sorted((k, rep) for k in simulate.SCENARIOS for rep in range(1, 31))


def test_simulate_metrics_has_every_scenario(spark):
    assert {r.dataset for r in registry.QUERIES["simulate_metrics"](spark, SF).collect()} == set(simulate.SCENARIOS)


def test_sql_only_for_registered_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_entry_point(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 5
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "panelweave")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as src:
                    assert not re.search(r"\bllm\b", src.read()), f
