import numpy as np
import pytest

from panelweave.operators import panel, validate
from panelweave.operators.panel import PanelError

from .helpers import default_rows, frame


def change(rows, at, **kw):
    names = panel.REQUIRED
    r = list(rows[at])
    for k, v in kw.items():
        r[names.index(k)] = v
    return [*rows[:at], tuple(r), *rows[at + 1 :]]


def test_valid_panel(spark):
    rows = default_rows()
    validate.validate_long(frame(spark, rows))
    p = panel.from_long(frame(spark, rows), validate=True)
    assert p.dims() == (4, 4, 3) and p.levels == ("ctrl", "treat")
    assert sorted(map(tuple, p.table().collect())) == sorted(rows)
    assert p.summary().first().onset == 3
    assert [tuple(r) for r in panel.sort_panel_table(p.table()).limit(2).collect()] == sorted(rows, key=lambda r: (r[0], r[2], r[3]))[:2]


def test_no_intervention_is_legal(spark):
    validate.validate_long(frame(spark, default_rows(onset=99)))


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        (default_rows()[:-1], "balanced"),
        ([*default_rows(), default_rows()[0]], "repeated keys"),
        (change(default_rows(), 0, abundance_value=0.9), "sum to 1"),
        (change(default_rows(), 0, abundance_value=float("nan")), "missing values"),
        (default_rows(n=5, labels=("a", "b", "c", "d", "e")), "at most 4"),
        ([r if r[0] != "sample_001" else (r[0], r[1].replace("time", "t"), *r[2:]) for r in default_rows(n=1)], "time_001"),
        (default_rows(onset=1), "earliest layer"),
        ([(*r[:6], r[1] == "time_002") for r in default_rows()], "falls back"),
    ],
)
def test_rejections(spark, rows, message):
    with pytest.raises(PanelError, match=message):
        validate.validate_long(frame(spark, rows))


def test_column_rejections(spark):
    df = frame(spark, default_rows())
    with pytest.raises(PanelError, match="missing columns: label"):
        validate.validate_long(df.drop("label"))
    with pytest.raises(PanelError, match="must be numeric"):
        validate.validate_long(df.withColumn("abundance_value", df.abundance_value.cast("string")))


def test_delta_t_and_order_follow_elapsed_time(spark):
    rows = default_rows(t=4, elapsed=[0, 3, 7, 21])
    p = panel.from_long(frame(spark, list(reversed(rows))))
    got = [(r.time_index, r.elapsed_time, r.delta_t) for r in p.time_meta.orderBy("time_index").collect()]
    assert got == [(1, 0.0, 0.0), (2, 3.0, 3.0), (3, 7.0, 4.0), (4, 21.0, 14.0)]
    validate.check_delta_t(p.time_meta)
    with pytest.raises(PanelError, match="delta_t"):
        validate.check_delta_t(p.time_meta.withColumn("delta_t", p.time_meta.delta_t + 1))


def test_arrays_round_trip(spark):
    x = np.random.default_rng(1).dirichlet([1, 1, 1], (3, 4)).transpose(0, 2, 1)
    obs, feats = [("a", "y"), ("b", "x"), ("c", "y")], ["f1", "f2", "f3"]
    layers = [(f"time_{k + 1:03d}", float(k), k == 3) for k in range(4)]
    p = panel.from_array(spark, x, obs, feats, layers)
    assert p.levels == ("y", "x")
    got, o, f, t = panel.to_array(p)
    assert np.array_equal(got, x) and (o, f, t) == (["a", "b", "c"], feats, [x[0] for x in layers])
    with pytest.raises(PanelError, match="shape"):
        panel.from_array(spark, x[:, :2], obs, feats, layers)
    with pytest.raises(PanelError, match="max_cells"):
        panel.to_array(p, max_cells=5)


def test_series_and_wide_round_trip(spark):
    p = panel.from_long(frame(spark, default_rows()))
    back = panel.from_series(panel.to_series(p.long))
    cols = ["observation", "time_index", "feature", "abundance_value"]
    assert sorted(map(tuple, back.select(cols).collect())) == sorted(map(tuple, p.long.select(cols).collect()))
    wide = panel.long_to_wide(p.long, [f"feature_{j:03d}" for j in range(1, 5)]).where("time_index = 1").drop("time_index").withColumnRenamed("observation", "observation_id")
    assert panel.wide_to_long(wide).count() == 16


def test_feature_index_is_the_rank_of_the_name(spark):
    names = [f"{c}{i}" for c in "bdace" for i in range(9, -1, -1)] + ["a", "é"]
    df = spark.createDataFrame([(n,) for n in names], "feature string")
    got = {r.feature: r.feature_index for r in panel.feature_index(df).collect()}
    want = {n: i + 1 for i, n in enumerate(sorted(names, key=str.encode))}
    assert got == want


def test_metadata_rejections(spark):
    p = panel.from_long(frame(spark, default_rows()))
    with pytest.raises(PanelError, match="empty"):
        validate.check_metadata(p.observation_meta.where("false"), p.time_meta)
    with pytest.raises(PanelError, match="repeated ids"):
        validate.check_metadata(p.observation_meta.unionAll(p.observation_meta), p.time_meta)
    assert panel.unmatched_keys(p.long, p.observation_meta.where("observation_id <> 'sample_001'")).collect()[0][0] == "sample_001"


def test_time_bins(spark):
    rows = [("a", 0.0, "f", 2.0), ("a", 1.0, "f", 4.0), ("a", 1.5, "g", 1.0), ("b", 0.5, "f", 1.0), ("b", 6.0, "f", 1.0)]
    df = spark.createDataFrame(rows, "observation string, day double, feature string, v double")
    got = sorted(map(tuple, panel.time_bins(df, "day", 5.0, "v", ("observation", "feature")).select("observation", "time_index", "feature", "abundance_value").collect()))
    assert got == [("a", 1, "f", 0.75), ("a", 1, "g", 0.25), ("b", 1, "f", 1.0)]
