import io
import math
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelweave.operators import panel, smooth, smooth_nb
from panelweave.operators.panel import PanelError
from panelweave.sources import archive

from .helpers import default_rows, frame

GOOD = """# manifest.txt machine-parsable
[observation_meta]
observation_id = sample_001; label = ctrl
observation_id = sample_002; label = treat
[time_meta]
time_identifier = time_001; elapsed_time = 0; delta_t = 0; is_intervention_timepoint = FALSE
time_identifier = time_002; elapsed_time = 7; delta_t = 7; is_intervention_timepoint = TRUE
[file_index]
time_001.csv
time_002.csv
"""
LAYERS = {
    "time_001.csv": "observation_id,a,b\nsample_001,0.3333333333333333,0.6666666666666666\nsample_002,0.25,0.75\n",
    "time_002.csv": "observation_id,a,b\nsample_002,0.5,0.5\nsample_001,1,0\n",
}


def build(tmp_path, manifest=GOOD, layers=LAYERS, name="x_v1.tar.gz"):
    path = tmp_path / name
    with tarfile.open(path, "w:gz") as tar:
        for k, v in (({"manifest.txt": manifest} if manifest is not None else {}) | layers).items():
            info = tarfile.TarInfo(k)
            info.size = len(v.encode())
            tar.addfile(info, io.BytesIO(v.encode()))
    return str(path)


def test_hand_built_archive(spark, tmp_path):
    got = {(r.observation, r.time_identifier, r.feature): (r.abundance_value, r.label, r.elapsed_time, r.is_intervention) for r in archive.read_panel_table(spark, build(tmp_path)).collect()}
    assert got[("sample_001", "time_001", "a")] == (1 / 3, "ctrl", 0.0, False)
    assert got[("sample_001", "time_002", "a")] == (1.0, "ctrl", 7.0, True)
    assert got[("sample_002", "time_002", "b")] == (0.5, "treat", 7.0, True)
    assert len(got) == 8
    assert archive.read_panel(spark, build(tmp_path)).levels == ("ctrl", "treat")


def test_layer_pruning(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = archive.read_panel_table(spark, build(tmp_path)).where("time_identifier = 'time_002'")
        assert df.count() == 4 and df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


@pytest.mark.parametrize(
    ("manifest", "layers", "message"),
    [
        (None, LAYERS, "no manifest.txt"),
        (GOOD.replace("[time_meta]", "[other]"), LAYERS, "block"),
        (GOOD + "[file_index]\ntime_001.csv\n", LAYERS, "repeated"),
        (GOOD.replace("time_002.csv\n", ""), LAYERS, "missing from the file index"),
        (GOOD + "time_003.csv\n", LAYERS, "not in the time metadata"),
        (GOOD.replace("; label = treat", ""), LAYERS, "label"),
        (GOOD.replace("elapsed_time = 7", "elapsed_time = soon"), LAYERS, "numeric"),
        (GOOD.replace("= TRUE", "= 1"), LAYERS, "logical"),
        (GOOD.replace("sample_002;", "sample_001;"), LAYERS, "repeated ids"),
        (GOOD.replace("delta_t = 7", "delta_t = 6"), LAYERS, "delta_t"),
        (GOOD, {"time_001.csv": LAYERS["time_001.csv"]}, "missing"),
        (GOOD, LAYERS | {"time_002.csv": LAYERS["time_002.csv"].replace("a,b", "b,a")}, "other columns"),
        (GOOD, {k: v.replace("a,b", "a,a") for k, v in LAYERS.items()}, "unique"),
    ],
)
def test_bad_archives(spark, tmp_path, manifest, layers, message):
    with pytest.raises(PanelError, match=message):
        archive.read_panel_table(spark, build(tmp_path, manifest, layers))


@pytest.mark.parametrize("change", [("sample_002,0.5", "sample_009,0.5"), ("sample_002,0.5,0.5\n", ""), ("sample_001,1,0", "sample_002,1,0")])
def test_bad_layers(spark, tmp_path, change):
    path = build(tmp_path, GOOD, LAYERS | {"time_002.csv": LAYERS["time_002.csv"].replace(*change)})
    with pytest.raises(Exception, match="unknown, repeated|lacks"):
        archive.read_panel_table(spark, path).collect()


def test_missing_file(spark, tmp_path):
    with pytest.raises(PanelError, match="does not exist"):
        archive.read_panel_table(spark, str(tmp_path / "none.tar.gz"))


def test_round_trip_is_exact(spark, tmp_path):
    rows = [("s1", [1 / 3, 2 / 3, 0, 0]), ("s2", [1e-20, 1, 0, 0]), ("s3", [0.1, 0.9, 1e-300, 0]), ("s4", [math.pi / 4, 1 - math.pi / 4, 0, 0])]
    table = [(o, t, e, f"f,{j}\"", float(v), "x y" if o < "s3" else "z", fl) for o, vs in rows for j, v in enumerate(vs) for t, e, fl in (("time_001", 0.0, False), ("time_002", 2.5, True))]
    df = frame(spark, table)
    path = archive.write_panel_archive(df, "p", "v2", str(tmp_path / "new"), ["a comment"])
    assert path.endswith("p_v2.tar.gz")
    back = archive.read_panel_table(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(table)
    truth = {"effect_taxa": "", "effect_signs": "", "n_effect_taxa": 0, "effect_size": 0.0}
    mark = archive.fingerprint(df.repartition(5))
    assert {r.result for r in archive.verify_archive(spark, path, df, truth, mark).collect()} == {"PASS"}
    bare = {r.check: r.result for r in archive.verify_archive(spark, path, df).collect()}
    assert {k for k, v in bare.items() if v == "SKIP"} == {"effect_taxa", "effect_signs", "effect_size", "fingerprint"} and bare["authentic"] == "FAIL"
    wrong = {r.check: r.result for r in archive.verify_archive(spark, path, df, truth | {"effect_taxa": "1;2"}, "x").collect()}
    assert {k for k, v in wrong.items() if v == "FAIL"} == {"effect_taxa", "fingerprint", "authentic"}
    assert (tmp_path / "new").exists() and len(list((tmp_path / "new").iterdir())) == 1
    other = frame(spark, [(*r[:4], r[4] + 1e-12, *r[5:]) for r in table])
    assert "FAIL" in {r.result for r in archive.verify_archive(spark, path, other).collect()}


def test_default_panel_round_trip(spark, tmp_path):
    rows = default_rows(n=6, d=5, t=4)
    path = archive.write_panel_archive(frame(spark, rows), "d", "v1", f"file://{tmp_path}")
    p = archive.read_panel(spark, path)
    assert sorted(map(tuple, p.table().collect())) == sorted(rows)
    got = panel.to_array(p)[0]
    assert np.allclose(got.sum(axis=1), 1)


def test_layers_are_members_of_their_own(spark, tmp_path):
    """A layer's task starts at its own gzip member; other tools read the whole file."""
    rows = default_rows(n=6, d=5, t=4)
    path = archive.write_panel_archive(frame(spark, rows), "d", "v1", str(tmp_path))
    with tarfile.open(path, "r:gz") as tar:
        names = tar.getnames()
        first = tar.extractfile("time_001.csv").read().decode().splitlines()
    assert names == ["manifest.txt", *(f"time_{k:03d}.csv" for k in range(1, 5))]
    assert len(first) == 7 and first[0] == "observation_id," + ",".join(sorted({r[3] for r in rows}))
    observations, layers, files, places = archive.read_metadata(path)
    begins = [places[f][0] for f in files]
    assert begins == sorted(set(begins)) and begins[0] > 0 and all(places[f][1] == 0 for f in files)
    head = tmp_path / "head.tar.gz"
    data = open(path, "rb").read()
    head.write_bytes(bytes(begins[2]) + data[begins[2] :])  # nothing before the third layer is needed
    got = [b.num_rows for b in archive.layer_batches(str(head), layers[2], dict(observations), places[files[2]])]
    assert sum(got) == 30
    cut = tmp_path / "cut.tar.gz"
    cut.write_bytes(data[: begins[3] + 40])
    with pytest.raises(Exception, match="ends|end of"):
        list(archive.layer_batches(str(cut), layers[3], dict(observations), places[files[3]]))
    (tmp_path / "bad.tar.gz").write_bytes(data[:40] + b"xxxx" + data[44:])
    with pytest.raises(PanelError, match="damaged"):
        archive.read_metadata(str(tmp_path / "bad.tar.gz"))


def test_writer_validates(spark, tmp_path):
    with pytest.raises(PanelError):
        archive.write_panel_archive(frame(spark, default_rows()[:-1]), "d", "v1", str(tmp_path))
    with pytest.raises(PanelError, match="';'"):
        archive.write_manifest([("a;b", "x")], [("time_001", 0.0, 0.0, False)])


def test_manifest_grammar():
    obs, layers, files = archive.parse_manifest(GOOD)
    assert obs == [("sample_001", "ctrl"), ("sample_002", "treat")] and files == ["time_001.csv", "time_002.csv"]
    assert layers[1] == ("time_002", 7.0, 7.0, True)
    assert archive.parse_manifest(archive.write_manifest(obs, layers)) == (obs, layers, files)
    assert archive.parse_pairs(["a = 1; b = x=y", "a = 2"]) == [{"a": "1", "b": "x=y"}, {"a": "2", "b": None}]
    assert archive.infer_column(["TRUE", "false", None]) == [True, False, None]
    assert archive.infer_column(["1", "2.5e3"]) == [1.0, 2500.0]
    assert archive.infer_column(["1", "x"]) == ["1", "x"]


def test_metadata_and_tables_from_any_source(spark):
    rows = default_rows(t=3)
    p = panel.from_long(frame(spark, rows), ("ctrl", "treat"))
    obs = [tuple(r) for r in p.observation_meta.orderBy("observation_id").collect()]
    layers = [tuple(r) for r in p.time_meta.orderBy("time_index").collect()]
    text = archive.write_manifest(obs, [x[:4] for x in layers])
    for source in (p, frame(spark, rows), text, text.split("\n")):
        assert sorted(map(tuple, archive.observation_meta_of(spark, source).collect())) == obs
        assert sorted(map(tuple, archive.time_meta_of(spark, source).collect())) == layers
    cube, _, features, _ = panel.to_array(p)
    metas = p.observation_meta.orderBy("observation_id").coalesce(1), p.time_meta.orderBy("time_index").coalesce(1)
    back = archive.as_panel_table(spark, None, cube, *metas, features)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(PanelError, match="layers"):
        archive.as_panel_table(spark, None, cube, metas[0])


def test_counts_through_the_one_smoothing_entry(spark):
    p = panel.from_long(frame(spark, default_rows(t=4)), ("ctrl", "treat"))
    counts = p.with_values(p.long.withColumn("abundance_value", F.round(F.col("abundance_value") * 100)))
    got = smooth.smooth_panel(counts, "rts", model="nb", time_scaling=True).long
    want = smooth_nb.smooth_nb(counts.long, 4, "rts", intervals=smooth_nb.sampling_intervals(counts))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(PanelError):
        smooth.smooth_panel(p, "rts", time_scaling=True)
