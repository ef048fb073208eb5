"""Panel archives: ``{dataset}_{version}.tar.gz`` with a manifest and one CSV a layer.

Read as a Spark data source (one input partition per layer, time filters prune
layers).  Each layer is written and compressed by one task as a gzip member of its
own; the driver only strings the members together.  Readers note where gzip
members begin, so that a layer's task starts at its own; in an archive of a single
member it has to inflate what stands before.
"""

from __future__ import annotations

import bisect
import csv
import gzip
import io
import json
import os
import re
import shutil
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..functions import format_number
from ..operators.panel import LONG_SCHEMA, MAX_GROUPS, MAX_LAYERS, Panel, PanelError, as_panel, from_long, index_layers, observation_meta, time_meta
from ..operators.validate import REPORT, TIME_ID, check_delta_t, check_intervention, check_metadata

MANIFEST = "manifest.txt"
BLOCKS = ("observation_meta", "time_meta", "file_index")
_HEADER = re.compile(r"^\[([A-Za-z0-9_]+)\]$")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: Bytes per read, and cells per batch given to Spark.
_CHUNK, _CELLS = 1 << 20, 1 << 16
_TIME_FIELDS = ("time_identifier", "elapsed_time", "delta_t", "is_intervention_timepoint")


# --------------------------------------------------------------------------- #
# manifest
# --------------------------------------------------------------------------- #
def split_blocks(text: str) -> dict[str, list[str]]:
    """Lines of each block; ``#`` in the first column is a comment."""
    blocks: dict[str, list[str]] = {}
    current = None
    for raw in text.splitlines():
        if raw.startswith("#") or not raw.strip():
            continue
        line = raw.strip()
        m = _HEADER.match(line)
        if m:
            current = m[1]
            if current in blocks:
                raise PanelError(f"manifest block [{current}] is repeated")
            blocks[current] = []
        elif current is None:
            raise PanelError("manifest has lines before its first block")
        else:
            blocks[current].append(line)
    for name in BLOCKS:
        if name not in blocks:
            raise PanelError(f"manifest block [{name}] is missing")
        if not blocks[name]:
            raise PanelError(f"manifest block [{name}] is empty")
    return blocks


def parse_pairs(lines: list[str]) -> list[dict[str, str | None]]:
    """``key = value; key = value`` lines; a key that a line lacks is None."""
    rows = []
    for line in lines:
        row = {}
        for part in line.split(";"):
            if part.strip():
                key, sep, value = part.partition("=")
                if not sep:
                    raise PanelError(f"manifest entry {part.strip()!r} has no '='")
                row[key.strip()] = value.strip()
        rows.append(row)
    names = list(dict.fromkeys(k for r in rows for k in r))
    return [{k: r.get(k) for k in names} for r in rows]


def infer_column(values: list[str | None]) -> list:
    """Booleans if all tokens are TRUE/FALSE, else numbers if all are, else text."""
    known = [v for v in values if v is not None]
    if known and all(v.upper() in ("TRUE", "FALSE") for v in known):
        return [None if v is None else v.upper() == "TRUE" for v in values]
    if known and all(_NUMBER.fullmatch(v) for v in known):
        return [None if v is None else float(v) for v in values]
    return list(values)


def parse_manifest(text: str) -> tuple[list[tuple[str, str]], list[tuple], list[str]]:
    """(observations with labels, time rows, layer files); ids stay text."""
    blocks = split_blocks(text)
    obs, times = parse_pairs(blocks["observation_meta"]), parse_pairs(blocks["time_meta"])
    if any(set(r) < {"observation_id", "label"} for r in obs) or any(not r.get("observation_id") or not r.get("label") for r in obs):
        raise PanelError("observation metadata needs observation_id and label")
    if any(r.get(c) is None for r in times for c in _TIME_FIELDS):
        raise PanelError(f"time metadata needs {', '.join(_TIME_FIELDS)}")
    typed = {c: infer_column([r[c] for r in times]) for c in _TIME_FIELDS[1:]}
    for c, kind in zip(_TIME_FIELDS[1:], (float, float, bool), strict=True):
        if any(type(v) is not kind for v in typed[c]):
            raise PanelError(f"time metadata column {c} must be {'logical' if kind is bool else 'numeric'}")
    observations = [(r["observation_id"], r["label"]) for r in obs]
    layers = list(zip((r["time_identifier"] for r in times), *(typed[c] for c in _TIME_FIELDS[1:]), strict=True))
    for what, ids in (("observation", [o for o, _ in observations]), ("time", [x[0] for x in layers])):
        if len(set(ids)) != len(ids):
            raise PanelError(f"{what} metadata has repeated ids")
    bad = [x[0] for x in layers if not TIME_ID.match(x[0])]
    if bad or len(layers) > MAX_LAYERS:
        raise PanelError(f"layer names must look like time_001: {', '.join(bad[:REPORT])}")
    return observations, layers, blocks["file_index"]


def write_manifest(observations: list[tuple[str, str]], layers: list[tuple], comments: list[str] | tuple[str, ...] = ()) -> str:
    for o, lab in observations:
        if any(c in f"{o}{lab}" for c in ";\n"):
            raise PanelError("ids and labels in a manifest must not hold ';' or line breaks")
    out = ["# manifest.txt machine-parsable", *(f"# {c}" for c in comments), "[observation_meta]"]
    out += [f"observation_id = {o}; label = {lab}" for o, lab in observations]
    out.append("[time_meta]")
    for t, e, dt, flag in layers:
        out.append(f"time_identifier = {t}; elapsed_time = {format_number(e)}; delta_t = {format_number(dt)}; is_intervention_timepoint = {str(bool(flag)).upper()}")
    out += ["[file_index]", *(f"{x[0]}.csv" for x in layers)]
    return "\n".join(out) + "\n"


def check_index(layers: list[tuple], files: list[str]) -> None:
    want, got = {f"{x[0]}.csv" for x in layers}, set(files)
    for what, names in (("missing from the file index", want - got), ("in the file index but not in the time metadata", got - want)):
        if names:
            raise PanelError(f"layers {what}: {', '.join(sorted(names)[:REPORT])} ({len(names)} in all)")


# --------------------------------------------------------------------------- #
# files
# --------------------------------------------------------------------------- #
def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Inflated(io.RawIOBase):
    """What a gzip file of one or many members holds, from a member's beginning at ``at``.

    ``starts``: where each member met so far begins, in the inflated bytes and in the file.
    """

    def __init__(self, stream, at: int):
        self.stream, self.at, self.out = stream, at, 0
        self.raw, self.inflate, self.starts = b"", None, []

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            ended = not self.raw
            if ended:
                self.raw = self.stream.read(_CHUNK)
                ended = not self.raw
            if self.inflate is None:
                kept = self.raw.lstrip(b"\0")  # padding may stand between and after members
                self.at += len(self.raw) - len(kept)
                self.raw = kept
                if ended:
                    return 0
                if not kept:
                    continue
                self.starts.append((self.out, self.at))
                self.inflate = zlib.decompressobj(31)
            try:
                data = self.inflate.decompress(self.raw, len(buffer))
            except zlib.error as e:
                raise PanelError(f"the archive is damaged: {e}") from e
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += len(self.raw) - len(rest)
            self.raw = rest
            if self.inflate.eof:
                self.inflate = None
            elif ended and not data:
                raise PanelError("the archive ends inside a file")
            if data:
                buffer[: len(data)] = data
                self.out += len(data)
                return len(data)


def _members(path: str, place: tuple[int, int] = (0, 0)) -> Iterator[tuple[str, io.BufferedIOBase, tuple[int, int]]]:
    """(name without folders, content, place) of a tar.gz's files, streamed from a place on.

    A place is where a gzip member begins, and how many inflated bytes stand
    between it and the file's header.
    """
    fs, where = filesystem(path)
    try:
        stream = fs.open_input_file(where)
    except FileNotFoundError as e:
        raise PanelError(f"archive {path} does not exist") from e
    first, skip = place
    with stream:
        stream.seek(first)
        inflated = _Inflated(stream, first)
        plain = io.BufferedReader(inflated, _CHUNK)
        left = skip
        while left:
            got = len(plain.read(min(left, _CHUNK)))
            if not got:
                raise PanelError("the archive ends inside a file")
            left -= got
        with tarfile.open(fileobj=plain, mode="r|") as tar:
            for m in tar:
                if m.isfile():
                    at = m.offset + skip
                    out, begin = inflated.starts[bisect.bisect_right(inflated.starts, at, key=lambda x: x[0]) - 1]
                    yield m.name.rsplit("/", 1)[-1], tar.extractfile(m), (begin, at - out)


def read_metadata(path: str) -> tuple[list[tuple[str, str]], list[tuple], list[str], dict[str, tuple[int, int]]]:
    """Manifest, checked headers and place of every layer (one streaming pass)."""
    text, heads, places = None, {}, {}
    for name, f, place in _members(path):
        if name == MANIFEST:
            text = f.read().decode("utf-8")
        elif name.endswith(".csv"):
            heads[name], places[name] = next(csv.reader([f.readline().decode("utf-8")]), []), place
    if text is None:
        raise PanelError(f"archive {path} has no {MANIFEST}")
    observations, layers, files = parse_manifest(text)
    check_index(layers, files)
    absent = [f for f in files if f not in heads]
    if absent:
        raise PanelError(f"layer files are missing: {', '.join(absent[:REPORT])}")
    first = heads[f"{layers[0][0]}.csv"]
    if len(set(first)) != len(first) or not all(first) or len(first) < 2:
        raise PanelError("column names must be unique and not empty")
    for f in files:
        if heads[f] != first:
            raise PanelError(f"{f} has other columns, or another order, than the first layer")
    return observations, layers, files, places


def layer_batches(path: str, layer: tuple, labels: dict[str, str], place: tuple[int, int] = (0, 0)) -> Iterator[pa.RecordBatch]:
    """Long rows of one layer; the observation set must equal the manifest's."""
    time, elapsed, _, flag = layer

    def melt(rows: list[list[str]], features: list[str]) -> pa.RecordBatch:
        n, d = len(rows), len(features)
        each, many = np.repeat(np.arange(n, dtype=np.int32), d), n * d
        names = [r[0] for r in rows]
        values = np.array([list(map(float, r[1:])) for r in rows]).ravel()
        cols = [
            pa.array(names, pa.string()).take(pa.array(each)),
            pa.repeat(pa.scalar(time, pa.string()), many),
            pa.repeat(pa.scalar(float(elapsed), pa.float64()), many),
            pa.array(features, pa.string()).take(pa.array(np.tile(np.arange(d, dtype=np.int32), n))),
            pa.array(values, pa.float64()),
            pa.array([labels[o] for o in names], pa.string()).take(pa.array(each)),
            pa.repeat(pa.scalar(bool(flag)), many),
        ]
        return pa.RecordBatch.from_arrays(cols, LONG_SCHEMA.names)

    for name, f, _ in _members(path, place):
        if name != f"{time}.csv":
            continue
        rows = csv.reader(line.decode("utf-8") for line in f)
        features = next(rows)[1:]
        seen, held = set(), []
        for row in rows:
            if not row:
                continue
            obs = row[0]
            if obs not in labels or obs in seen or len(row) != len(features) + 1:
                raise PanelError(f"{name}: observation {obs!r} is unknown, repeated or incomplete")
            seen.add(obs)
            held.append(row)
            if len(held) * len(features) >= _CELLS:
                yield melt(held, features)
                held = []
        if held:
            yield melt(held, features)
        if len(seen) != len(labels):
            raise PanelError(f"{name} lacks {len(labels) - len(seen)} observations")
        return


class _Layer(InputPartition):
    def __init__(self, layer: tuple, place: tuple[int, int]):
        super().__init__(layer)
        self.layer, self.place = layer, place


class _Reader(DataSourceReader):
    """``manifest`` and ``places``: where the caller has checked the archive already."""

    def __init__(self, path: str, manifest: str | None = None, places: str | None = None):
        self.path = path
        if manifest:
            observations, self.layers, _ = parse_manifest(manifest)
            self.places = json.loads(places or "{}")
        else:
            observations, self.layers, _, self.places = read_metadata(path)
        self.labels = dict(observations)
        self.wanted: set[str] | None = None

    def partitions(self):
        return [_Layer(x, tuple(self.places.get(f"{x[0]}.csv", (0, 0)))) for x in self.layers if self.wanted is None or x[0] in self.wanted]

    def read(self, partition):
        if isinstance(partition, _Layer):
            yield from layer_batches(self.path, partition.layer, self.labels, partition.place)


class _PruningReader(_Reader):
    """Takes filters on the layer's name; needs filter pushdown to be enabled."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("time_identifier",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


class PanelArchiveSource(DataSource):
    """``spark.read.format("panel_archive").load(path)`` gives the long table."""

    @classmethod
    def name(cls) -> str:
        return "panel_archive"

    def schema(self) -> T.StructType:
        return LONG_SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        prune = self.options.get("prune", "false") == "true"
        return (_PruningReader if prune else _Reader)(self.options["path"], self.options.get("manifest"), self.options.get("places"))


def _checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, tuple[str, ...]]:
    """(long table, observation metadata, time metadata, labels in order)."""
    observations, layers, _, places = read_metadata(path)
    obs = spark.createDataFrame(observations, "observation_id string, label string")
    times = spark.createDataFrame(layers, "time_identifier string, elapsed_time double, delta_t double, is_intervention_timepoint boolean")
    check_metadata(obs, times)
    check_intervention(times)
    check_delta_t(times)
    spark.dataSource.register(PanelArchiveSource)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    source = spark.read.format("panel_archive").option("prune", prune).option("manifest", write_manifest(observations, layers))
    source = source.option("places", json.dumps(places))
    return source.load(path), obs, times, tuple(dict.fromkeys(lab for _, lab in observations))


def read_panel_table(spark: SparkSession, path: str) -> DataFrame:
    """The archive's long table; metadata is validated first."""
    return _checked(spark, path)[0]


def read_panel(spark: SparkSession, path: str) -> Panel:
    """The archive as a panel; labels keep the order of the manifest."""
    table, obs, times, levels = _checked(spark, path)
    layers = index_layers(times)
    long = table.join(F.broadcast(layers.select("time_identifier", "time_index")), "time_identifier")
    return Panel(long.select("observation", "time_index", "feature", "abundance_value"), obs, layers, levels)


class _LayerFile:
    """A layer's CSV as one gzip member, padded to whole tar blocks."""

    def __init__(self, fs: pafs.FileSystem, path: str, features: list[str]):
        self.path, self.sink = path, fs.open_output_stream(path, compression=None)
        self.gz = gzip.GzipFile(filename="", mode="wb", fileobj=self.sink, mtime=0)
        self.text = io.TextIOWrapper(self.gz, encoding="utf-8", newline="")
        self.write = csv.writer(self.text, lineterminator="\n").writerow
        self.write(["observation_id", *features])

    def close(self) -> int:
        """The CSV's size without padding."""
        self.text.flush()
        size = self.gz.tell()
        self.gz.write(bytes(-size % tarfile.BLOCKSIZE))
        self.text.close()
        self.sink.close()
        return size


def _tar_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf()


def write_panel_archive(table: DataFrame, dataset: str, version: str, out_dir: str, comments: list[str] | tuple[str, ...] = (), validate: bool = True) -> str:
    """Write the seven-column long table; returns the archive's path.

    Each layer's CSV is written and compressed by one task from rows sorted by
    observation, in bounded memory, into a folder beside the archive, where the
    table itself is kept meanwhile; the driver then copies the files, as they are,
    between the tar's headers.
    """
    fs, root = filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    name = f".layers-{uuid.uuid4().hex}"
    folder = f"{root}/{name}"
    fs.create_dir(folder, recursive=True)
    where = out_dir if re.match("[a-z0-9]+:", out_dir) else "file://" + os.path.abspath(out_dir)
    try:
        _write(table, dataset, version, f"{where.rstrip('/')}/{name}/table", out_dir, folder, comments, validate)
    finally:
        fs.delete_dir(folder)
    target = f"{dataset}_{version}.tar.gz"
    return f"{out_dir.rstrip('/')}/{target}" if "://" in out_dir else f"{root}/{target}"


def _write(table: DataFrame, dataset: str, version: str, staged: str, out_dir: str, folder: str, comments: list[str] | tuple[str, ...], validate: bool) -> None:
    """Checks, metadata and layers read the table as ``staged``, so that its plan runs once."""
    table.write.parquet(staged)
    table = table.sparkSession.read.schema(table.schema).parquet(staged)
    if validate:
        from ..operators.validate import validate_long

        validate_long(table)
    panel = from_long(table)
    features = [r[0] for r in table.select("feature").distinct().orderBy("feature").collect()]
    layers = [tuple(r) for r in panel.time_meta.orderBy("time_index").select(*_TIME_FIELDS).collect()]
    observations = [tuple(r) for r in panel.observation_meta.orderBy("observation_id").collect()]
    fs, root = filesystem(out_dir)
    cells = table.groupBy("time_identifier", "observation").agg(F.sort_array(F.collect_list(F.struct("feature", "abundance_value"))).alias("cells"))
    wide = cells.selectExpr("time_identifier", "observation", "transform(cells, c -> c.abundance_value) xs")
    wide = wide.repartition(len(layers), "time_identifier").sortWithinPartitions("time_identifier", "observation")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(out_dir)
        name = out = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": [name], "size": [out.close()], "path": [out.path]})

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for r in b.slice(at, 256).to_pylist():
                    if r["time_identifier"] != name:
                        if out is not None:
                            yield done()
                        name, out = r["time_identifier"], _LayerFile(fs, f"{folder}/{uuid.uuid4().hex}", features)
                    out.write([r["observation"], *map(format_number, r["xs"])])
        if out is not None:
            yield done()

    written = {r.name: r for r in wide.mapInArrow(run, "name string, size bigint, path string").collect()}  # one row a layer
    target = f"{root}/{dataset}_{version}.tar.gz"
    with fs.open_output_stream(target, compression=None) as sink:
        text = write_manifest(observations, layers, comments).encode()
        sink.write(gzip.compress(_tar_header(MANIFEST, len(text)) + text + bytes(-len(text) % tarfile.BLOCKSIZE), mtime=0))
        for layer in layers:
            done = written[layer[0]]
            sink.write(gzip.compress(_tar_header(f"{layer[0]}.csv", done.size), mtime=0))
            with fs.open_input_stream(done.path, compression=None) as f:
                shutil.copyfileobj(f, sink, _CHUNK)
        sink.write(gzip.compress(bytes(2 * tarfile.BLOCKSIZE), mtime=0))


def observation_meta_of(spark: SparkSession, x: Panel | DataFrame | str | list[str]) -> DataFrame:
    """observation_id, label of a panel, a long table or a manifest's text (or lines)."""
    if isinstance(x, Panel):
        return x.observation_meta
    if isinstance(x, DataFrame):
        return observation_meta(x)
    observations, _, _ = parse_manifest(x if isinstance(x, str) else "\n".join(x))
    return spark.createDataFrame(observations, "observation_id string, label string")


def time_meta_of(spark: SparkSession, x: Panel | DataFrame | str | list[str]) -> DataFrame:
    """The layers of a panel, a long table or a manifest's text (or lines)."""
    if isinstance(x, Panel):
        return x.time_meta
    if isinstance(x, DataFrame):
        return time_meta(x)
    _, layers, _ = parse_manifest(x if isinstance(x, str) else "\n".join(x))
    return index_layers(spark.createDataFrame(layers, "time_identifier string, elapsed_time double, delta_t double, is_intervention_timepoint boolean"))


def as_panel_table(spark: SparkSession, path: str | None = None, array=None, observations: DataFrame | None = None, layers: DataFrame | None = None, features: list[str] | None = None) -> DataFrame:
    """The long table of an archive, or of an array with both metadata tables."""
    if path is not None:
        return read_panel_table(spark, path)
    missing = [k for k, v in (("array", array), ("observations", observations), ("layers", layers)) if v is None]
    if missing:
        raise PanelError(f"without a path these are needed: {', '.join(missing)}")
    return as_panel(array, observations, layers, features).table()


def fingerprint(table: DataFrame) -> str:
    """A mark of a long table's rows, whatever their order."""
    row = F.xxhash64(*LONG_SCHEMA.names), F.xxhash64(F.lit(1), *LONG_SCHEMA.names)
    r = table.agg(F.count(F.lit(1)), *(F.bit_xor(x) for x in row), F.sum(F.shiftrightunsigned(row[0], 40))).first()
    return ":".join(map(str, r))


def verify_archive(spark: SparkSession, path: str, table: DataFrame, truth: dict | None = None, mark: str | None = None) -> DataFrame:
    """PASS, FAIL or SKIP per check of an archive against the table it should hold.

    ``truth``: a row of the truth table (effect_taxa and effect_signs as text
    joined by ``;``, n_effect_taxa, effect_size); ``mark``: the source's
    :func:`fingerprint`.  Checks whose source is not given are skipped, and then
    the archive does not count as authentic.
    """
    got = read_panel_table(spark, path)
    columns = [f.name for f in LONG_SCHEMA.fields]
    a, b = got.select(*columns), table.select(*columns)

    def sizes(df: DataFrame) -> DataFrame:
        return df.agg(*(F.count_distinct(c).alias(c) for c in ("observation", "feature", "time_identifier", "label")), F.count(F.lit(1)).alias("rows")).first()

    x, y = sizes(a).asDict(), sizes(b).asDict()
    checks = [(f"n_{k}", x[k] == y[k]) for k in x]
    onset = [d.where("is_intervention").agg(F.min("elapsed_time")).first()[0] for d in (a, b)]
    checks += [("onset", onset[0] == onset[1]), ("nothing_missing", b.exceptAll(a).isEmpty()), ("nothing_added", a.exceptAll(b).isEmpty())]
    flags = {k: sorted((r[0], r[1]) for r in d.select("elapsed_time", "is_intervention").distinct().collect()) for k, d in (("a", a), ("b", b))}
    on = [f for _, f in flags["a"]]
    checks += [("times", [t for t, _ in flags["a"]] == [t for t, _ in flags["b"]]), ("one_breakpoint", on == sorted(on) and not on[0])]
    labels = [{r[0] for r in d.select("label").distinct().limit(MAX_GROUPS + 1).collect()} for d in (a, b)]
    checks.append(("label_groups", labels[0] == labels[1]))
    if truth is None:
        checks += [(k, None) for k in ("effect_taxa", "effect_signs", "effect_size")]
    else:
        taxa, signs = ([p for p in str(truth[k] or "").split(";") if p] for k in ("effect_taxa", "effect_signs"))
        n = int(truth["n_effect_taxa"])
        checks += [("effect_taxa", len(taxa) == n), ("effect_signs", len(signs) == n), ("effect_size", (float(truth["effect_size"]) != 0) == (n > 0))]
    checks.append(("fingerprint", None if mark is None else fingerprint(a) == mark))
    checks.append(("authentic", all(ok for _, ok in checks)))
    named = {True: "PASS", False: "FAIL", None: "SKIP"}
    return spark.createDataFrame([(c, named[ok]) for c, ok in checks], "check string, result string")
