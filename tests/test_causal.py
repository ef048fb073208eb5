import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelweave.functions import bh_adjust, bh_adjust_large, format_number, normal_p_value
from panelweave.operators import causal, inference, metrics, panel, scm, simulate
from panelweave.operators.panel import PanelError

from .helpers import causal_array, causal_rows, frame

T0 = 5


@pytest.fixture(scope="module")
def data():
    return causal_array(t0=T0)


@pytest.fixture(scope="module")
def pan(spark, data):
    return panel.from_long(frame(spark, causal_rows(*data, T0)), ("ctrl", "treat"))


@pytest.fixture(scope="module")
def des(pan):
    return causal.design(pan)


def by_feature(df):
    return df.toPandas().set_index("feature").sort_index()


def ols(y, columns):
    """Coefficients, errors and df of y on observation and time dummies and columns."""
    n, t = y.shape
    obs, time = np.repeat(np.arange(n), t), np.tile(np.arange(t), n)
    x = [c.ravel() for c in columns] + [(obs == i).astype(float) for i in range(n)] + [(time == k).astype(float) for k in range(1, t)]
    x = np.stack(x, axis=1)
    beta, *_ = np.linalg.lstsq(x, y.ravel(), rcond=None)
    res = y.ravel() - x @ beta
    dof = n * t - np.linalg.matrix_rank(x)
    cov = np.linalg.pinv(x.T @ x) * (res @ res / dof)
    k = len(columns)
    return beta[:k], np.sqrt(np.diag(cov)[:k])


def test_did_closed_form(des, data):
    x, treated = data
    effects, path = causal.did(des)
    e = by_feature(effects)
    delta = x[:, :, T0 - 1 :].mean(2) - x[:, :, : T0 - 1].mean(2)
    est = delta[treated].mean(0) - delta[~treated].mean(0)
    se = np.sqrt(delta[treated].var(0, ddof=1) / 5 + delta[~treated].var(0, ddof=1) / 15)
    assert np.allclose(e.estimate, est, atol=1e-9) and np.allclose(e.standard_error, se, atol=1e-9)
    assert np.allclose(e.p_value, [math.erfc(abs(z) / math.sqrt(2)) for z in est / se])
    gap = x[treated].mean(0) - x[~treated].mean(0)
    assert np.allclose(e.effect_range, np.ptp(gap, axis=1))
    p = path.toPandas().sort_values(["feature", "time_index"])
    assert np.allclose(p.estimate.to_numpy().reshape(3, -1), gap)
    assert list(effects.columns) == list(causal.EFFECTS)


def test_pooled_against_regression(des, data):
    x, treated = data
    e = by_feature(causal.pooled_ols(des)[0])
    d = np.outer(treated, np.arange(9) >= T0 - 1).astype(float)
    for j in range(3):
        b, s = ols(x[:, j], [d])
        assert e.estimate.iloc[j] == pytest.approx(b[0], abs=1e-9) and e.standard_error.iloc[j] == pytest.approx(s[0], abs=1e-9)


def test_event_study_against_regression(des, data):
    x, treated = data
    effects, path = causal.event_study(des)
    e, p = by_feature(effects), path.toPandas()
    ks = [k for k in range(9) if k != T0 - 2]
    cols = [np.outer(treated, np.arange(9) == k).astype(float) for k in ks]
    for j in range(3):
        b, s = ols(x[:, j], cols)
        got = p[p.feature == f"f{j}"].sort_values("time_index")
        assert np.allclose(got.estimate, b, atol=1e-9) and np.allclose(got.standard_error, s, atol=1e-9)
        post = [i for i, k in enumerate(ks) if k >= T0 - 1]
        assert e.estimate.iloc[j] == pytest.approx(b[post].mean(), abs=1e-9)
        assert e.standard_error.iloc[j] == pytest.approx(np.sqrt((s[post] ** 2).mean()), abs=1e-9)
        assert e.effect_range.iloc[j] == pytest.approx(np.ptp(b), abs=1e-9)


def test_third_label_counts_only_in_regressions(spark, data):
    x, treated = data
    labels = ["treat" if f else ("ctrl" if i % 2 else "other") for i, f in enumerate(treated)]
    p = panel.from_long(frame(spark, causal_rows(x, treated, T0, labels)))
    with pytest.raises(PanelError, match="treatment_level"):
        causal.design(p)
    d = causal.design(p, "treat", "ctrl")
    ctrl = np.array([lab == "ctrl" for lab in labels])
    delta = x[:, :, T0 - 1 :].mean(2) - x[:, :, : T0 - 1].mean(2)
    assert np.allclose(by_feature(causal.did(d)[0]).estimate, delta[treated].mean(0) - delta[ctrl].mean(0))
    pooled = by_feature(causal.pooled_ols(d)[0])
    assert np.allclose(pooled.estimate, delta[treated].mean(0) - delta[~treated].mean(0))
    assert (pooled.n_control == ctrl.sum()).all()
    reg = [ols(x[:, j], [np.outer(treated, np.arange(9) >= T0 - 1).astype(float)])[1][0] for j in range(3)]
    assert np.allclose(pooled.standard_error, reg)


def test_row_order_and_partitions_do_not_matter(spark, data):
    rows = causal_rows(*data, T0)
    one = panel.from_long(spark.createDataFrame(rows[::-1], panel.LONG_SCHEMA).coalesce(1), ("ctrl", "treat"))
    two = panel.from_long(spark.createDataFrame(rows, panel.LONG_SCHEMA).repartition(7), ("ctrl", "treat"))
    for f in (causal.did, causal.pooled_ols, causal.event_study, scm.synthetic_control):
        a, b = (by_feature(f(causal.design(p))[0]) for p in (one, two))
        assert np.allclose(a.estimate, b.estimate, atol=1e-12)


# ---- solvers ---------------------------------------------------------------- #
@pytest.mark.parametrize("seed", range(30))
def test_solvers_reach_the_optimum(seed):
    rng = np.random.default_rng(seed)
    m, n = rng.integers(1, 8), rng.integers(1, 25)
    a, b = rng.normal(size=(m, n)), rng.normal(size=m)
    if seed % 3 == 0:
        a[:, n // 2 :] = a[:, : n - n // 2]  # repeated donors
    if seed % 5 == 0:
        b = a @ rng.dirichlet(np.ones(n))  # attainable
    assert scm.kkt_residual(a, b, scm.nnls(a, b), "nnls") < 1e-8
    w = scm.simplex(a, b)
    assert scm.kkt_residual(a, b, w, "simplex") < 1e-8
    for _ in range(50):  # no other point of the simplex is better
        v = rng.dirichlet(np.ones(n) * 0.3)
        assert np.linalg.norm(a @ w - b) <= np.linalg.norm(a @ v - b) + 1e-9


def test_equal_donors_share_the_weight():
    assert np.allclose(scm.simplex(np.ones((3, 4)), np.zeros(3)), 0.25)


@pytest.mark.parametrize("constraint", scm.CONSTRAINTS)
def test_fit_of_values_that_are_not_finite_or_huge(constraint):
    """Not finite before the onset: NaN all over, no error.  Huge: the weights of the scaled values."""
    rng = np.random.default_rng(5)
    donors, unit = rng.normal(2, 1, (4, 9)), rng.normal(2, 1, 9)
    for bad in (np.nan, np.inf, -np.inf):
        for where in ("unit", "donor"):
            d, u = donors.copy(), unit.copy()
            (u if where == "unit" else d[1])[2] = bad
            w, mu, gaps = scm.fit_unit(d, u, 6, constraint, True)
            assert np.isnan(w).all() and np.isnan(mu) and np.isnan(gaps).all() and gaps.shape == (9,)
    w, mu, gaps = scm.fit_unit(donors, unit, 6, constraint, True)
    big = scm.fit_unit(donors * 2.0**700, unit * 2.0**700, 6, constraint, True)
    assert np.allclose(big[0], w, atol=1e-9) and np.allclose(big[2] / 2.0**700, gaps, atol=1e-8)



@pytest.mark.parametrize(("constraint", "offset"), [("simplex", True), ("simplex", False), ("nnls", False), ("nnls", True)])
def test_synthetic_control(des, data, constraint, offset):
    x, treated = data
    effects, path, weights, sums = scm.synthetic_control(des, constraint, offset)
    gaps = np.array([[scm.fit_unit(x[~treated, j], u, T0, constraint, offset)[2] for u in x[treated, j]] for j in range(3)])[:, :, T0 - 1 :]
    e = by_feature(effects)
    assert np.allclose(e.estimate, gaps.mean((1, 2)))
    assert np.allclose(e.standard_error, np.sqrt(gaps.mean(2).var(1, ddof=1) / 5))
    assert weights.count() == 3 * 5 * 15 and path.count() == 3 * 5
    if constraint == "simplex":
        assert all(abs(r.weight_sum - 1) < 1e-9 for r in sums.collect())
    fit = scm.pre_fit(des, weights, offset).toPandas().sort_values(["feature", "treated_unit"])
    pre = np.array([[scm.fit_unit(x[~treated, j], u, T0, constraint, offset)[2][: T0 - 1] for u in x[treated, j]] for j in range(3)])
    if offset:
        pre = pre - pre.mean(2, keepdims=True)
    rmse = np.sqrt((pre**2).mean(2))
    assert np.allclose(fit.pre_rmse.to_numpy().reshape(3, 5), rmse)
    ok = rmse > 1e-9  # an exact fit has no meaningful ratio
    assert np.allclose(fit.pre_snr.to_numpy().reshape(3, 5)[ok], (np.abs(pre).mean(2) / (rmse + 1e-10))[ok])


def test_many_treated_units_are_dealt_into_blocks(des, monkeypatch):
    want = by_feature(scm.synthetic_control(des)[0])
    monkeypatch.setattr(scm, "BLOCK", 2)
    assert np.allclose(by_feature(scm.synthetic_control(des)[0]).estimate, want.estimate)


# ---- inference -------------------------------------------------------------- #
def test_placebo(des, data, monkeypatch):
    x, treated = data
    real = by_feature(scm.synthetic_control(des)[0]).estimate
    monkeypatch.setattr(scm, "BLOCK", 4)
    got = by_feature(inference.placebo(des, causal.did(des)[0]))
    for j in range(3):
        c = x[~treated, j]
        plc = [scm.fit_unit(np.delete(c, i, 0), c[i], T0, "simplex", True)[2][T0 - 1 :].mean() for i in range(15)]
        assert got.placebo_p_value.iloc[j] == pytest.approx((1 + sum(abs(p) >= abs(real.iloc[j]) for p in plc)) / 16)


@pytest.mark.parametrize("method", ["did", "pooled_ols", "event_study", "scm"])
def test_bootstrap(des, method):
    point = by_feature({"did": causal.did, "pooled_ols": causal.pooled_ols, "event_study": causal.event_study, "scm": scm.synthetic_control}[method](des)[0]).estimate
    n = 400 if method != "scm" else 50
    a, wide = (by_feature(inference.bootstrap(des, method, n, level, seed=3)) for level in (0.5, 0.95))
    again = by_feature(inference.bootstrap(des, method, n, 0.95, seed=3))
    assert (wide.bootstrap_lower <= a.bootstrap_lower).all() and (wide.bootstrap_upper >= a.bootstrap_upper).all()
    assert np.allclose(wide, again)
    assert ((wide.bootstrap_lower < point + 0.3) & (wide.bootstrap_upper > point - 0.3)).all()


@pytest.mark.parametrize("units", [4096, 3])
def test_bootstrap_width_follows_the_error(des, monkeypatch, units):
    monkeypatch.setattr(inference, "UNITS", units)
    e = by_feature(causal.did(des)[0])
    b = by_feature(inference.bootstrap(des, "did", 2000, 0.95))
    assert np.allclose((b.bootstrap_upper - b.bootstrap_lower) / (2 * 1.96 * e.standard_error), 1, atol=0.25)


@pytest.mark.parametrize("adjust", [bh_adjust, bh_adjust_large])
def test_bh(spark, adjust):
    rng = np.random.default_rng(8)
    p = [*rng.random(200).tolist(), 0.0, 0.0, 1.0, 1.0, 1e-300, 0.01, 0.01, None, None]
    df = spark.createDataFrame([(g, i, v) for g in "ab" for i, v in enumerate(p)], "g string, i int, p_value double").repartition(5)
    known = np.array([v for v in p if v is not None])
    order = np.argsort(known)
    ranks = known[order] * len(known) / np.arange(1, len(known) + 1)
    want = np.empty(len(known))
    want[order] = np.minimum(1, np.minimum.accumulate(ranks[::-1])[::-1])
    for r in adjust(df, by=("g",)).collect():
        assert (r.fdr is None) if r.p_value is None else r.fdr == pytest.approx(want[r.i])
    assert adjust(df.where("i < 0")).count() == 0


def test_p_values_and_numbers(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.96,), (-40.0,), (None,)], "z double").select(normal_p_value(F.col("z"))).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.04999579) and 0 <= got[2] < 1e-300 and got[3] is None
    for v in (1 / 3, 1e-300, 0.1, 5.0, math.pi):
        assert float(format_number(v)) == v
    with pytest.raises(ValueError):
        format_number(math.nan)


# ---- entry point ------------------------------------------------------------ #
def test_formula():
    f = causal.parse_formula(" abundance ~ group | unit + time ")
    assert f == causal.Formula("abundance_value", "label", ("observation", "time_identifier"))
    for bad in ("y", "y ~", "y ~ x ~ z", "y ~ group | nothing", "nothing ~ group", "y ~ time"):
        with pytest.raises(PanelError):
            causal.parse_formula(bad)


def test_estimate(pan):
    r = causal.estimate("y ~ group", pan, "scm", bootstrap=True, bootstrap_samples=20, placebo=True, pre_fit=True)
    assert set(causal.EFFECTS) < set(r.effects.columns) and "placebo_fdr" in r.effects.columns and "bootstrap_upper" in r.effects.columns
    assert r.effects.count() == 3 and r.pre_fit.count() == 15 and "time_identifier" in r.time_effects.columns
    assert r.summary().first().n_features == 3
    for bad in ({"method": "nope"}, {"method": "did", "intervention_index": 1}, {"method": "scm", "scm_constraint": "nope"}):
        with pytest.raises(PanelError):
            causal.estimate("y ~ group", pan, **bad)


def test_estimate_skips_what_is_not_defined(pan):
    with pytest.warns(UserWarning, match="pre_fit"):
        r = causal.estimate("y ~ group", pan, "did", pre_fit=True)
    assert r.pre_fit is None
    few = panel.from_long(pan.table().where("label = 'treat' or observation = 's05'"), ("ctrl", "treat"))
    with pytest.warns(UserWarning, match="placebo"):
        assert causal.estimate("y ~ group", few, "did", placebo=True).placebo is None


def test_estimate_from_a_table_or_an_array(spark, pan, data):
    want = by_feature(causal.estimate("y ~ group", pan, "did").effects)
    table = by_feature(causal.estimate("y ~ group", pan.table(), "did", treatment_level="treat").effects)
    x, treated = data
    obs = spark.createDataFrame([(f"s{i:02d}", "treat" if f else "ctrl") for i, f in enumerate(treated)], "observation_id string, label string").coalesce(1)
    layers = spark.createDataFrame([(f"time_{k + 1:03d}", 3.0 * k, k + 1 >= T0) for k in range(x.shape[2])], "time_identifier string, elapsed_time double, is_intervention_timepoint boolean").coalesce(1)
    array = by_feature(causal.estimate("y ~ group", x, "did", treatment_level="treat", observation_meta=obs, time_meta=layers).effects)
    for got in (table, array):
        assert np.allclose(got.estimate, want.estimate) and np.allclose(got.p_value, want.p_value)
    with pytest.raises(PanelError, match="needs"):
        causal.estimate("y ~ group", x, "did")


# ---- simulation and metrics -------------------------------------------------- #
def test_simulate_is_seeded_and_shaped(spark):
    a, b = simulate.simulate(simulate.SCENARIOS["A1"], 7), simulate.simulate(simulate.SCENARIOS["A1"], 7)
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert a["counts"].shape == (40, 50, 5) and (a["effect"] != 0).sum() == 6
    sums = a["relab"].sum(axis=1)
    assert np.allclose(sums, 1)
    probe = {r.dataset: r for r in simulate.probe(simulate.generate(spark, ["A1", "A9"], 2)).collect()}
    assert (probe["A1"].n_observations, probe["A1"].n_features, probe["A1"].n_layers, probe["A1"].n_treated) == (40, 50, 5, 10)
    assert probe["A9"].zero_share > probe["A1"].zero_share


def test_any_subject_can_be_made_by_itself(spark):
    s = simulate.Scenario(n=70, n_treated=20, features=8, trend_diff=0.3, hetero=0.5, twin=True)
    whole = simulate.simulate(s, 11)
    for part in (range(0, 5), range(18, 23), range(69, 70)):
        some = simulate.simulate(s, 11, part)
        for k in ("state", "relab", "depth", "counts", "treated"):
            assert np.array_equal(some[k], whole[k][part.start : part.stop]), k
    long = simulate.generate(spark, ["S"], 1, seed=11 - 100_001, scenarios={"S": s})  # replicate 1 of the first scenario has seed 11
    counts = {(r.observation, r.feature, r.time_index): r.raw for r in long.collect()}
    assert len(counts) == 70 * 8 * 5 and long.rdd.getNumPartitions() > 1
    assert all(counts[f"subject_{i + 1:03d}", f"taxa_{j + 1:03d}", k + 1] == whole["counts"][i, j, k] for i in range(70) for j in range(8) for k in range(5))


def test_noise_is_autoregressive_and_grows_with_the_step():
    s = simulate.Scenario(n=400, n_treated=1, features=30, times=(0, 7, 35), t0=2, effect_size=0.0, baseline_sd=0.0, trend_sd=0.0, innov_sd=0.5, rho=0.6)
    z = simulate.simulate(s, 3)["state"][1:]
    sd = [0.5 * np.sqrt(dt / 7) for dt in (1, 7, 28)]
    want = [sd[0] ** 2]
    for v in sd[1:]:
        want.append(0.36 * want[-1] + v * v)
    assert np.allclose(z.var(axis=(0, 1)), want, rtol=0.06)
    assert (z[..., 1] * z[..., 0]).mean() / want[0] == pytest.approx(0.6, abs=0.1)


def test_simulated_zeros_and_noise_follow_their_parameters():
    s = simulate.Scenario(n=300, n_treated=100, features=30, zero_prob=0.3, effect_size=0.0, innov_sd=0.0, trend_sd=0.0, baseline_sd=1.0)
    out = simulate.simulate(s, 1)
    assert (out["relab"][..., 0] == 0).mean() == pytest.approx(0.3, abs=0.02)
    assert out["state"].std() == pytest.approx(1.0, abs=0.03)
    assert (out["counts"].sum(axis=1).mean() / 12000) == pytest.approx(np.exp(0.3**2 / 2), abs=0.1)


def test_effects_are_recovered_and_the_null_is_calm(spark):
    from panelweave.plans.registry import simulated_effects

    est = simulated_effects(spark, ["A2", "A11"], 8)
    out = {r.dataset: r for r in metrics.summarize(est, simulate.truth(spark, ["A2", "A11"], 8)).collect()}
    assert out["A2"].sign_hit > 0.8 and out["A2"].power_fdr > out["A2"].type1_fdr
    assert out["A11"].sign_hit is None and out["A11"].type1_fdr < 0.06


def test_metric_values(spark):
    est = spark.createDataFrame([("d", 1, "m", "a", 1.0, 0.01), ("d", 1, "m", "b", -2.0, 0.2), ("d", 1, "m", "c", 0.5, 0.04)], "dataset string, rep int, method string, feature string, estimate double, fdr double")
    tru = spark.createDataFrame([("d", 1, "a", 2.0), ("d", 1, "b", 1.0), ("d", 1, "c", 0.0)], "dataset string, rep int, feature string, effect double")
    r = metrics.summarize(est, tru).first()
    assert (r.n_est, r.sign_hit, r.power_fdr, r.signed_power_fdr, r.type1_fdr, r.bias, r.mae, r.recon_null) == (3, 0.5, 0.5, 0.5, 1.0, -2.0, 2.0, 0.5)
    assert r.power_placebo is None
    iv = spark.createDataFrame([("d", 1, "x", "a", 1.0, 3.0), ("d", 1, "x", "b", 2.0, 3.0)], "dataset string, rep int, level string, feature string, bootstrap_lower double, bootstrap_upper double")
    b = metrics.summarize_bootstrap(iv, tru).first()
    assert (b.mean_width, b.coverage) == (1.5, 0.5)
    assert pd.notna(b.implied_error)


def test_truth_table_and_archive_table(spark, tmp_path):
    from panelweave.operators import validate
    from panelweave.sources import archive

    rows = {(r.dataset, r.rep): r for r in simulate.truth_table(spark, ["A1", "A11"], 2).collect()}
    assert set(rows) == {("A1", 1), ("A1", 2), ("A11", 1), ("A11", 2)}
    assert len(rows["A1", 1].effect_features) == len(rows["A1", 1].effect_signs) == 6 and rows["A11", 1].effect_features == []
    assert rows["A1", 1].effect_features != rows["A1", 2].effect_features or rows["A1", 1].effect_signs != rows["A1", 2].effect_signs
    assert (rows["A1", 1].n_donor, rows["A1", 1].n_pre, rows["A1", 1].n_post) == (30, 3, 2)
    table = simulate.panel_table(simulate.generate(spark, ["A1"], 1), "A1", 1)
    validate.validate_long(table)
    path = archive.write_panel_archive(table, "A1_rep01", "v1", str(tmp_path))
    one = rows["A1", 1]
    truth = {"effect_taxa": ";".join(one.effect_features), "effect_signs": ";".join(map(str, one.effect_signs)), "n_effect_taxa": one.n_effect, "effect_size": one.effect_size}
    checks = {r.check: r.result for r in archive.verify_archive(spark, path, table, truth, archive.fingerprint(table)).collect()}
    assert set(checks.values()) == {"PASS"}, checks
    bare = {r.check: r.result for r in archive.verify_archive(spark, path, table).collect()}
    assert {k for k, v in bare.items() if v != "PASS"} == {"effect_taxa", "effect_signs", "effect_size", "fingerprint", "authentic"}


def test_grids_treat_replicates_as_separate_panels(spark):
    from panelweave.operators import experiments, preprocess

    small = {"S": simulate.Scenario(n=10, n_treated=4, features=6, n_effect=2, effect_size=1.0)}
    configs = {"base": experiments.Config(filter=None), "ilr": experiments.Config(filter=None, normalize="ilr"), "spline": experiments.Config(filter=None, smooth={"method": "spline"})}
    got = experiments.run(spark, configs, ["S"], 2, "did", scenarios=small).toPandas()
    assert len(got) == 3 * 2 * 6
    long = simulate.generate(spark, ["S"], 2, scenarios=small)
    one = panel.from_long(simulate.panel_table(long, "S", 2), ("ctrl", "treat"))
    for label, norm in (("base", "clr"), ("ilr", "ilr")):
        d = causal.design(one.with_values(preprocess.normalize(one.long, norm)))
        want = by_feature(causal.did(d)[0])
        sub = got[(got.config == label) & (got.rep == 2)].set_index("feature").sort_index()
        assert np.allclose(sub.estimate, want.estimate) and np.allclose(sub.fdr, want.fdr, equal_nan=True)
    boot = experiments.run(spark, {"b": experiments.Config(filter=None, samples=20)}, ["S"], 1, "scm", bootstrap=True, scenarios=small).toPandas()
    assert (boot.bootstrap_lower <= boot.bootstrap_upper).all() and len(boot) == 6
    nb = experiments.run(spark, {"nb": experiments.ABLATIONS["ab_nb_hier"]}, ["S"], 1, "scm", scenarios=small)
    assert nb.count() > 0 and len(experiments.ABLATIONS) == 11
