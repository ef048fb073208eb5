import numpy as np
import pytest

from panelweave.operators import preprocess
from panelweave.operators.panel import PanelError

N, D, T = 5, 7, 3


@pytest.fixture(scope="module")
def cube():
    rng = np.random.default_rng(4)
    x = rng.gamma(0.5, 1, (N, D, T)) * (rng.random((N, D, T)) > 0.3)
    x[:, 0] += 0.1  # no sample is all zero, except the one below
    x[4, :, 2] = 0.0
    total = x.sum(axis=1, keepdims=True)
    return x / np.where(total == 0, 1, total)


def long(spark, x):
    rows = [(f"o{i}", k + 1, f"f{j}", float(x[i, j, k])) for i in range(N) for j in range(x.shape[1]) for k in range(T)]
    return spark.createDataFrame(rows, "observation string, time_index int, feature string, abundance_value double").repartition(4)


def cube_of(df, d=D):
    out = np.full((N, d, T), np.nan)
    for r in df.collect():
        v = r.abundance_value
        out[int(r.observation[1:]), int(r.feature[1:]), r.time_index - 1] = np.nan if v is None else v
    return out


def each(x, f):
    return np.stack([np.stack([f(x[i, :, k]) for k in range(x.shape[2])], -1) for i in range(x.shape[0])])


def half_min(v):
    return np.where(v == 0, 0.5 * v[v > 0].min(), v) if (v > 0).any() else v


def ref_zero(method):
    def f(v):
        z, pos = (v == 0).sum(), v[v > 0]
        if method == "constant":
            return np.where(v == 0, 0.5, v)
        if method == "half_min":
            return half_min(v)
        if method == "sqrt_min":
            return np.where(v == 0, 0.5 * np.sqrt(pos.min()), v) if len(pos) else v
        if method == "multiplicative":
            return v if z == 0 else np.where(v == 0, 1e-4, v * (1 - z * 1e-4) / (pos.sum() or 1))
        if z == 0 or z == len(v):
            return v
        share = np.exp(np.log(pos / v.sum()).mean())
        return np.where(v == 0, v.sum() * (1 - share) / z, v * share)

    return f


@pytest.mark.parametrize("method", ["constant", "half_min", "sqrt_min", "multiplicative", "bayesian"])
def test_zero_fill(spark, cube, method):
    assert np.allclose(cube_of(preprocess.zero_fill(long(spark, cube), method)), each(cube, ref_zero(method)), atol=1e-12)


def test_bayesian_keeps_the_sum(spark, cube):
    got = cube_of(preprocess.zero_fill(long(spark, cube), "bayesian")).sum(axis=1)
    assert np.allclose(got, cube.sum(axis=1))


def helmert(d):
    h = np.zeros((d, d))
    for j in range(1, d):
        h[:j, j - 1], h[j, j - 1] = -1.0, j
        h[:, j - 1] /= np.linalg.norm(h[:, j - 1])
    return h


def ref_norm(method):
    def f(v):
        if method == "clr":
            return np.log(v) - np.log(v).mean()
        if method == "ilr":
            return (np.log(v) - np.log(v).mean()) @ helmert(len(v))
        if method == "tss":
            return v / (v.sum() or 1)
        if method == "log1p":
            return np.log1p(v)
        if method == "css":
            pos = np.sort(v[v > 0])
            return v / pos[: max(1, int(0.5 * len(pos)))].sum() if len(pos) else v
        if method == "rclr":
            return np.where(v > 0, np.log(np.where(v > 0, v, 1)) - np.log(v[v > 0]).mean(), 0) if (v > 0).any() else v
        if method == "z_score":
            return (v - v.mean()) / (v.std(ddof=1) or 1)
        return (v - v.min()) / (np.ptp(v) or 1)

    return f


@pytest.mark.parametrize("method", ["clr", "ilr", "tss", "log1p", "css", "rclr", "z_score", "min_max"])
def test_normalize(spark, cube, method):
    x = cube.copy()
    if method in ("clr", "ilr"):
        x[4, :, 2] = 1 / D
    want = each(each(x, half_min), ref_norm(method)) if method in ("clr", "ilr") else each(x, ref_norm(method))
    got = cube_of(preprocess.normalize(long(spark, x), method))
    assert np.allclose(got, want, atol=1e-10)
    if method == "clr":
        assert np.allclose(got.sum(axis=1), 0)
    if method == "ilr":  # an isometry of the clr space
        clr = cube_of(preprocess.normalize(long(spark, x), "clr"))
        assert np.allclose((got**2).sum(axis=1), (clr**2).sum(axis=1))
        assert (got[:, -1] == 0).all()


@pytest.mark.parametrize("mode", ["feature", "feature_time"])
def test_rle(spark, cube, mode):
    x = cube + 0.01
    log = np.log(x)
    if mode == "feature":
        ref = np.exp(log.mean(axis=(0, 2)))[:, None] * np.ones((1, T))
    else:
        ref = np.exp(log.mean(axis=0))
    want = x.copy()
    for i in range(N):
        for k in range(T):
            ratios = x[i, :, k][:, None] / (ref if mode == "feature_time" else ref[:, :1])
            want[i, :, k] = x[i, :, k] / np.median(ratios)
    assert np.allclose(cube_of(preprocess.normalize(long(spark, x), "rle", reference_mode=mode)), want)


def test_rle_given_reference(spark, cube):
    x = cube + 0.01
    ref = spark.createDataFrame([(f"f{j}", 0.5) for j in range(D)], "feature string, reference double")
    got = cube_of(preprocess.normalize(long(spark, x), "rle", reference=ref))
    assert np.allclose(got, x / np.median(x / 0.5, axis=1, keepdims=True))


def test_single_feature(spark, cube):
    one = long(spark, cube[:, :1] + 0.1)
    for method in preprocess.NORMALIZE_METHODS:
        assert preprocess.normalize(one, method).count() == N * T


def test_filter(spark, cube):
    x = long(spark, cube)
    stats = {
        "min_prevalence": ((cube > 0.05).mean(axis=(0, 2)), 0.5, 0.05),
        "min_mean_abundance": (cube.mean(axis=(0, 2)), 0.13, 0.0),
        "min_total_abundance": (cube.sum(axis=(0, 2)), 1.9, 0.0),
        "min_max_abundance": (cube.max(axis=(0, 2)), 0.5, 0.0),
    }
    for name, (values, bound, above) in stats.items():
        got = {r[0] for r in preprocess.filter_features(x, min_abundance=above, **{name: bound}).select("feature").distinct().collect()}
        assert got == {f"f{j}" for j in np.flatnonzero(values >= bound)}, name
    zero = 1 - (cube > 0).mean(axis=(0, 2))
    got = {r[0] for r in preprocess.filter_features(x, max_zero_proportion=0.35).select("feature").distinct().collect()}
    assert got == {f"f{j}" for j in np.flatnonzero(zero <= 0.35)}
    assert preprocess.filter_features(x) is x


def test_pipeline_reports_removed_features(spark, cube):
    out, report = preprocess.preprocess(long(spark, cube), filter={"min_mean_abundance": 0.13}, zero={"method": "constant"}, normalize_="clr")
    kept = {r.feature for r in report.where("kept").collect()}
    assert kept == {r.feature for r in out.select("feature").distinct().collect()} and report.count() == D


def test_unknown_methods(spark, cube):
    with pytest.raises(PanelError):
        preprocess.zero_fill(long(spark, cube), "nope")
    with pytest.raises(PanelError):
        preprocess.normalize(long(spark, cube), "nope")


def test_one_shuffle_for_fill_and_normalize(spark, cube):
    df = preprocess.normalize(preprocess.zero_fill(long(spark, cube), "half_min"), "z_score")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(observation") == 1
